"""URL verdicts: rules first, then exact membership by a cascade of Bloom filters; no Python on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from rowtrail.llm.common import stored

# Rules by host suffix and path prefix.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


#: 64-bit words of a filter in one row of a level.
SHARD_WORDS = 8192


def _probe(level: int, turn: int, within: int, key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(turn), F.col(key)), F.lit(within))


class Cascade:
    """Levels of Bloom filters.  A level is a stored table ``(shard, words)``: a key's shard comes from its hash, and
    its bits stand in that shard's words, an array of bounded length."""

    def __init__(self, levels: list[tuple[int, int, int, DataFrame]]):
        self.levels = levels

    def hits(self, rows: DataFrame, n: int, key: str, name: str) -> DataFrame:
        """Adds whether level ``n`` holds the key; a small level is broadcast by Catalyst, a large one joined by shard."""
        shards, bits, turns, words = self.levels[n]
        held = words.select(F.col("shard").alias("__shard"), F.col("words").alias("__words"))
        joined = rows.withColumn("__at", _probe(n, -1, shards, key)).join(held, F.col("__at") == F.col("__shard"), "left")
        hit = F.col("__words").isNotNull()
        for turn in range(turns):
            at = _probe(n, turn, bits, key)
            word = F.get(F.col("__words"), F.shiftright(at, 6).cast("int"))
            hit = hit & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__at", "__shard", "__words")

    def judged(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """Adds whether the key is listed; exact for every key of the universe that the cascade was built over."""
        columns, answer = rows.columns, F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels)):
            rows = self.hits(rows, n, key, f"__hit{n}")
        for n in reversed(range(len(self.levels))):
            answer = F.when(F.col(f"__hit{n}"), answer).otherwise(F.lit(n % 2 == 1))
        return rows.select(*[F.col(f"`{c}`") for c in columns if c != name], answer.alias(name))


def build_cascade(universe: DataFrame, key: str, listed: str, rate: float = 0.02, shard_words: int = SHARD_WORDS) -> Cascade:
    """Encode which keys of ``universe`` (distinct keys with a boolean ``listed``) are listed.

    Level 0 holds the listed keys, each further level the false positives that the level before
    has among the keys of the other class.  Ends when there are none: every level has hashes of its
    own and holds about ``rate`` of the keys of the level two before.  A level has as many shards as its
    keys need, each one row of ``shard_words`` words built by itself, so no level is too large.
    """
    spark = universe.sparkSession
    left = stored(universe.select(F.col(key), F.col(listed).alias("inside")), "universe")
    levels: list[tuple[int, int, int, DataFrame]] = []
    while True:
        n = len(levels)
        inside = F.col("inside") == F.lit(n % 2 == 0)
        size = left.where(inside).count()
        if not size:
            return Cascade(levels)
        needed = max(1, math.ceil(size * -math.log(rate) / math.log(2) ** 2 / 64))
        shards = -(-needed // shard_words)
        words = -(-needed // shards)
        turns = max(1, min(16, round(64 * words * shards / size * math.log(2))))
        spots = left.where(inside).select(_probe(n, -1, shards, key).alias("shard"), F.explode(F.array(*[_probe(n, t, 64 * words, key) for t in range(turns)])).alias("at"))
        filled = (spots.groupBy("shard", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
                  .unionByName(spark.range(shards * words).select((F.col("id") % shards).alias("shard"), F.expr(f"id div {shards}L").alias("word"), F.lit(0).cast("long").alias("bits")))
                  .groupBy("shard", "word").agg(F.bit_or("bits").alias("bits")))
        table = filled.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
        levels.append((shards, 64 * words, turns, stored(table, "bloom")))
        # keys of this class are settled below; those of the other class stay if they are false positives
        left = stored(Cascade(levels).hits(left, n, key, "__hit").where(inside | F.col("__hit")).drop("__hit"), "cascade")


def judge_urls(pages: DataFrame, cascade: Cascade, key: str = "key", rules=RULES) -> DataFrame:
    """``host, path, rule, verdict`` for every row; without a rule the cascade blocks listed keys."""
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return (cascade.judged(pages, key, "listed").withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))))


def thin_pages(pages: DataFrame, min_words: int = 100) -> DataFrame:
    """Distinct keys (host and path) of the pages, listed if one of its pages has few words outside tags."""
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ")
    few = F.regexp_count(visible, F.lit("[^\\x20\\x09-\\x0D]+")) < min_words
    return pages.select("key", few.alias("few")).groupBy("key").agg(F.bool_or("few").alias("listed"))


def filter_urls(pages: DataFrame) -> DataFrame:
    """Verdicts for pages; the listed keys are those of thin pages.

    Null urls, and urls without ``://``, have empty host and path and share one key.  Null html
    has no words.  Repeated rows give repeated results; an empty table gives an empty result.
    Only ``page_id``, ``url`` and ``html`` are read.
    """
    host, path = split_url(F.col("url").cast("string"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("key", F.concat_ws("", "host", "path"))
    cascade = build_cascade(thin_pages(keyed), "key", "listed")
    return judge_urls(keyed.drop("html"), cascade).select("page_id", "host", "path", "rule", "verdict", "listed")
