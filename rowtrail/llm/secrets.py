"""Secret scan with corpus-wide ownership of each candidate; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtrail.llm.common import stored, text_or_empty

# Base patterns.
KEYWORD = ("[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
           "[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
SIGN, VALUE = "[\"']?\\x20*[:=]", "[A-Za-z0-9+/_.=-]"
ASSIGN = f"({KEYWORD}){SIGN}\\x20*[\"']?({VALUE}+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
# An assignment may begin inside the match of another, kept or dropped: each value ends where the next assignment begins.
SIGNED = f"(?:{KEYWORD}){SIGN}"
INNER = f"{SIGNED}\\x20*[\"']?((?:(?!{SIGNED}){VALUE})++)"
NESTED = f"{SIGNED}\\x20*[\"']?(?:(?!{SIGNED}){VALUE})*+{SIGNED}"
# A private key: BEGIN line, headers, then the body and the END line, or, where that is missing, the long lines of the
# body and its shorter last line; the BEGIN line alone without a body.  Line breaks may be escaped, and lines quoted.
GAP, BODY, LABEL = "\\s\\\\\"',", "A-Za-z0-9+/=", "[A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)? ?-{4,5}"
BEGIN, END = "-{4,5} ?BEGIN ", f"-{{4,5}} ?END {LABEL}"
HEADERS = (f"(?:[{GAP}n]*+(?:(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]++|"
           "[A-Za-z][A-Za-z0-9-]*+: (?:(?!----)[^\\r\\n\\\\])*+(?=[\\r\\n\\\\])))*+")
BREAK = "(?:[\\s\"',]|\\\\[nrt])++"
LAST = (f"(?:[ \\t\"',]*+(?:\\r?\\n|(?:\\\\r)?+\\\\n)[ \\t\"',]*+"
        f"(?:(?:[{BODY}]{{4}}){{1,9}}+(?=[ \\t\"',]*+(?:[\\r\\n]|\\\\[nr]|\\z))|[{BODY}]{{1,39}}+\\z))?+")
KEY = f"{LABEL}({HEADERS}(?:[{GAP}]*+[{BODY}][{BODY}{GAP}]*+{END}|(?:{BREAK}[{BODY}]{{40,}}+)++{LAST}))?"
# Further candidate kinds, each as what its pattern begins with and the rest; ownership labels them.
MORE = [
    ("github", "gh[pousr]_", "[A-Za-z0-9]{36,}"), ("slack", "xox[abprs]-", "[A-Za-z0-9-]{10,}"), ("google", "AIza", "[A-Za-z0-9_-]{35}"),
    ("stripe", "[sr]k_live_", "[A-Za-z0-9]{16,}"),
    ("jwt", "eyJ", "[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]*+\\.[A-Za-z0-9_-]{8,}+(?:\\.[A-Za-z0-9_-]++\\.[A-Za-z0-9_-]{16,}+)?"),  # three parts or five
    ("pem", BEGIN, KEY),
    ("opaque", "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+", "={0,2}"),  # with a letter and a digit, see scan_secrets
]
SPAN = "array<struct<start:long,rank:int,kind:string,stop:long,value:string>>"


def _spans(text: Column, kind: str, rank: int, pattern: str, value_group: int = 0) -> Column:
    """All matches with their code point positions: pieces between matches give the starts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    lengths = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), values.alias("value")),
                          lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), x["hit"].alias("hit"), x["value"].alias("value")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state, x):
        first = state["at"] + x["gap"]
        last = first + F.length(x["hit"])
        one = F.struct(first.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), last.alias("stop"), x["value"].alias("value"))
        return F.when(x["hit"].isNull(), state).otherwise(F.struct(last.alias("at"), F.concat(state["out"], F.array(one)).alias("out")))

    return F.when(F.size(found) > 0, F.aggregate(lengths, start, step)["out"]).otherwise(F.array().cast(SPAN))


def _key_bodies(spans: Column) -> Column:
    """Keys by the characters of their bodies, however these are broken into lines; a BEGIN line alone by itself."""
    body = lambda s: F.regexp_replace(F.regexp_replace(s["value"], f"^{BEGIN}{LABEL}{HEADERS}", ""), f"{END}|\\\\[nrt]|[^{BODY}]", "")
    return F.transform(spans, lambda s: s.withField("value", F.when(body(s) == "", s["value"]).otherwise(body(s))))


def _inner(text: Column, assigned: Column, rank: int) -> Column:
    """Assignments that begin or end inside the match of another, so without a place in ``assigned``."""
    every = F.filter(_spans(text, "inner", rank, INNER, 1), lambda s: F.length(s["value"]) >= 6)
    place = lambda s: F.struct(s["start"], s["stop"])
    # of two with one place, the base span comes first
    alone = lambda a: F.filter(a, lambda s, i: (s["rank"] == rank) & ~place(s).eqNullSafe(place(F.get(a, i - 1))))
    hidden = F.transform(F.array(F.sort_array(F.concat(assigned, every))), alone)[0]
    return F.when(text.rlike(NESTED), hidden).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(documents: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 1,
                 max_repos: int = 3) -> DataFrame:
    """Secrets per document, with the ownership of their values over the whole corpus.

    Every candidate is reported in ``spans``; ownership only labels it.  A value that few owners and
    repositories hold (``max_owners``, ``max_repos``) looks live; one that more hold may be an
    example, and its spans, those of the base kinds (assign, access, hex) too, are repeated in
    ``copied_spans``.  ``n_live`` and ``n_copied`` count a document's spans by label.  Rows of equal text count as
    one repository and owner (the smallest of theirs): to copy a document is not to spread its
    values.  A null owner or repository is one of its own kind.  A null or empty text has no
    spans.  Every input row, repeated ones too, gives a row.

    A private key is one span from its BEGIN to its END line, and its body is its value, so that
    keys of one type have an ownership of their own.  Matches of the base kinds do not overlap; an
    assignment that begins inside another (``secret: password: abcdef``) has the kind inner.

    Spans are (kind, start, stop) in code points, of the whole match.  A candidate with the place
    of a base span stands beside it under its own kind.  Only values travel: they are hashed, counted by (hash, text
    hash), by (hash, owner, repository), by (hash, owner), then by hash, so a value that a third of
    the rows hold is combined map-side; rows without candidates are never shuffled.
    """
    text = text_or_empty()
    assigned = F.filter(_spans(text, "assign", 0, ASSIGN, 2), lambda s: F.length(s["value"]) >= 6)
    base = F.array_sort(F.concat(assigned, _spans(text, "access", 1, ACCESS), _spans(text, "hex", 2, HEX)))
    rest = [_spans(text, kind, 3 + i, first + more) for i, (kind, first, more) in enumerate(MORE)]
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    rest = [_key_bodies(spans) if kind == "pem" else F.filter(spans, mixed) if kind == "opaque" else spans for spans, (kind, *_) in zip(rest, MORE)]
    suspicious = text.rlike("|".join(first for _, first, _ in MORE))  # exact: every pattern begins with one of these
    added = F.concat(F.when(suspicious, F.concat(*rest)).otherwise(F.array().cast(SPAN)), _inner(text, assigned, 3 + len(MORE)))
    found = documents.select(F.col("doc_id"), F.col(repo_col).cast("string").alias("repo"),
                             F.col(owner_col).cast("string").alias("owner"), F.sha2(text.cast("binary"), 256).alias("copy"),
                             base.alias("base"), added.alias("added"))
    rows = stored(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    busy = (rows.where("size(base) + size(added) > 0")
            .select("row", "repo", "owner", "copy", F.explode(F.concat("base", "added")).alias("span"))
            .withColumn("hash", F.sha2("span.value", 256)))
    owners = (busy.groupBy("hash", "copy").agg(F.min("owner").alias("owner"), F.min("repo").alias("repo"))
              .groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
              .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
              .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")))
    live = stored(owners.where((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).select("hash", F.lit(True).alias("live")), "owned")
    judged = busy.select("row", "hash", "span").join(live, "hash", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    per_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list("span")).alias("all"), F.sort_array(F.collect_list(F.when(~F.col("live"), F.col("span")))).alias("copied"),
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_copied"))
    none, zero = F.array().cast(SPAN), F.lit(0).cast("long")
    both = rows.where("size(base) + size(added) > 0").join(per_row, "row").select("doc_id", "base", "all", "copied", "n_live", "n_copied").unionByName(
        rows.where("size(base) + size(added) = 0").select("doc_id", "base", none.alias("all"), none.alias("copied"), zero.alias("n_live"),
                                                          zero.alias("n_copied")))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return both.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       _joined(F.col("all")).alias("spans"), _joined(F.col("copied")).alias("copied_spans"), "n_live", "n_copied")
