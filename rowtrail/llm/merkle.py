"""Merkle manifest of a dataset: bitmap ranks give leaf coordinates, slot arrays reduce the levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtrail.llm.common import stored
from rowtrail.sources.ids import with_position

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FANOUT, ROUND_LEVELS = 3, 3
#: Nodes of a slot array: one round reduces three levels.
SLOTS = FANOUT ** ROUND_LEVELS
#: A directory page covers at most 2 ** 16 entries of the level below; 58 bits of word number give four levels.
PAGE_BITS, PAGES = 16, 3
#: Word number of rows without id: below those of all ids.
NO_ID = -(1 << 58)


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf_of(text: Column | None = None) -> Column:
    """Digest of a row: each field with its byte count, a null field as ``-``."""
    parts = []
    for name in FIELDS:
        value = text if text is not None and name == "text" else F.col(name)
        value = value.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return digest(F.concat(*parts))


def _directory(leaves: DataFrame) -> DataFrame:
    """(grp, word, bits, n, base, total): the merged bitmap of each group with the ranks where words begin.

    A word holds the presence of 64 ids; words without an id are not stored.  Counts are summed
    over pages of pages, and each page is scanned on its own, so no window sees more than 2 ** 16
    rows, however many ids a group has and however far they lie apart.
    """
    words = stored(leaves.groupBy("grp", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, cast(coalesce(doc_id, 0L) & 63L as int))")).alias("bits"), F.count(F.lit(1)).alias("n")), "words")
    levels = [words.withColumnRenamed("word", "at")]
    for _ in range(PAGES):
        levels.append(levels[-1].groupBy("grp", F.shiftright("at", PAGE_BITS).alias("at")).agg(F.sum("n").alias("n")))
    upper = levels[-1].groupBy("grp").agg(F.sum("n").alias("total")).select("grp", F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("start"), "total")
    for k in range(PAGES, -1, -1):
        page = F.shiftright("at", PAGE_BITS) if k < PAGES else F.lit(0).cast("long")
        before = Window.partitionBy("grp", "page").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        placed = levels[k].withColumn("page", page).join(upper, ["grp", "page"]).withColumn(
            "start", F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        upper = placed.select("grp", F.col("at").alias("page"), "start", "total")
    return stored(placed.select("grp", F.col("at").alias("word"), "bits", "n", F.col("start").alias("base"), "total"), "ranks")


def _ranked(leaves: DataFrame) -> DataFrame:
    """The leaves with ``pos``, the number of leaves of the group before them, and ``total``.

    An id held once has the rank that its bitmap gives: the base of its word and the bits below its own.
    Words in which an id repeats are rare and ranked apart: equal ids stand by leaf digest, equal
    rows are one row with a count until the end.
    """
    found = leaves.join(_directory(leaves), ["grp", "word"])
    crowded = F.col("n") > F.bit_count("bits")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, cast(coalesce(doc_id, 0L) & 63L as int)))")
    columns = ["grp", "doc_id", "leaf", "probe", "total"]
    single = found.where(~crowded).select(*columns, (F.col("base") + below).alias("pos"))
    rows = stored(found.where(crowded).groupBy(*columns, "word", "base").agg(F.count(F.lit(1)).alias("copies"))
                  .withColumn("head", F.substring("leaf", 1, 4)).withColumn("id_key", F.coalesce("doc_id", F.lit(0))), "crowded")
    heads = rows.groupBy("grp", "word", "id_key", "head").agg(F.sum("copies").alias("m"))
    before = Window.partitionBy("grp", "word").orderBy("id_key", "head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    inside = Window.partitionBy("grp", "word", "id_key", "head").orderBy("leaf", "probe").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(heads, ["grp", "word", "id_key", "head"]).withColumn(
        "first", F.col("base") + F.col("start") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    run = 1 << PAGE_BITS
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(run).cast("long"))))
    many = runs.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + run, F.col("copies")) - 1)))
    return stored(single.unionByName(many.select(*columns, (F.col("first") + F.col("copy")).alias("pos"))), "leaves")


def _reduce(nodes: Column) -> Column:
    """Every three consecutive nodes become the digest of their concatenation."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")))


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Slot arrays (grp, block, total, slots, l0, l1, l2, top); levels beyond the group's root repeat the one below."""
    slot = F.struct(F.col("pos"), F.col("h"), *[F.col(c) for c in carried])
    filled = nodes.groupBy("grp", F.floor(F.col("pos") / SLOTS).alias("block")).agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(slot)).alias("slots"))
    out = filled.withColumn("l0", F.col("slots.h"))
    for j in range(ROUND_LEVELS):
        out = out.withColumn(f"l{j + 1}", F.when(F.col("total") > FANOUT ** j, _reduce(F.col(f"l{j}"))).otherwise(F.col(f"l{j}")))
    return stored(out.withColumn("top", F.col(f"l{ROUND_LEVELS}")[0]).drop(f"l{ROUND_LEVELS}"), "blocks")


def _own_path(slot: Column) -> Column:
    """Siblings left and right of a slot's node, level by level, inside its block."""
    steps = []
    for j in range(ROUND_LEVELS):
        i, level = F.floor(slot / FANOUT ** j).cast("int"), F.col(f"l{j}")
        at = i % FANOUT
        steps.append(F.struct(F.array_join(F.slice(level, i - at + 1, at), "").alias("left"),
                              F.array_join(F.slice(level, i + 2, F.lit(FANOUT - 1) - at), "").alias("right")))
    applied = sum(F.when(F.col("total") > FANOUT ** j, 1).otherwise(0) for j in range(ROUND_LEVELS))
    return F.slice(F.array(*steps), F.lit(1), applied)


def _rounds(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Rounds of slot arrays, until every group is one node; the rows shrink by 27 a round."""
    out = [_blocks(nodes, carried)]
    largest = out[0].agg(F.max("total")).first()[0] or 0
    while largest > SLOTS:
        largest = -(-largest // SLOTS)
        out.append(_blocks(out[-1].select("grp", F.col("block").alias("pos"), F.ceil(F.col("total") / SLOTS).alias("total"), F.col("top").alias("h")), []))
    return out


def _paths(rounds: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """(grp, h, subroot, *carried, path) of all nodes of the first round; ``above`` has (grp, block, subroot, path) over the last one."""
    for k in range(len(rounds) - 1, -1, -1):
        down = (rounds[k].join(above, ["grp", "block"])
                .select("grp", "block", "subroot", "path", "total", *[f"l{j}" for j in range(ROUND_LEVELS)], F.posexplode("slots").alias("slot", "node"))
                .withColumn("path", F.concat(_own_path(F.col("slot")), F.col("path"))))
        if k:
            above = stored(down.select("grp", F.col("node.pos").alias("block"), "subroot", "path"), "paths")
    return down.select("grp", F.col("node.h").alias("h"), "subroot", *[F.col(f"node.{c}").alias(c) for c in carried], "path")


def dataset_manifest(documents: DataFrame, probe: Column | None = None) -> DataFrame:
    """``source, doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per document.

    A leaf is the digest of doc_id, source, lang, n_chars and text.  Per source, leaves stand by
    ascending id; every three consecutive nodes become their digest until one remains, the subroot;
    subroots, ordered by source (null first, then by bytes), likewise give the root.  The proof is
    the digest of all siblings from the leaf to the root.  ``probe`` is the text to verify in place of
    the stored one (an expression over the columns): its leaf is folded with the siblings, and the
    document is verified if that gives the root.

    Bitmaps of each source's ids (``_directory``) give a leaf its coordinate by a rank query, so
    leaves are never sorted; levels are reduced by (group, block) slot arrays, three levels a shuffle.

    Null fields are ``-``; rows without id come first in their source; rows of one id stand by leaf
    digest, equal rows one after the other, each a leaf of its own.  An empty table gives no rows.
    Columns other than the five are not read.
    """
    leaf = leaf_of()
    scanned = documents.select(
        F.concat(F.lit("s"), F.col("source")).alias("grp"), F.col("doc_id").cast("long"), leaf.alias("leaf"),
        (leaf if probe is None else leaf_of(probe)).alias("probe"))
    scanned = scanned.withColumn("grp", F.coalesce("grp", F.lit(""))).withColumn(
        "word", F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_ID).cast("long")))
    leaves = _ranked(stored(scanned, "leaf-rows"))
    carried = ["doc_id", "probe"]
    rounds = _rounds(leaves.withColumnRenamed("leaf", "h"), carried)
    tops = stored(rounds[-1].select(F.col("grp").alias("name"), F.col("top").alias("h")), "subroots")
    count = tops.count()
    ordered = with_position(tops, ["name"]).select(F.lit("").alias("grp"), "pos", F.lit(count).cast("long").alias("total"), "h", "name")
    upper = _rounds(ordered, ["name"])
    no_path = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    start = upper[-1].select("grp", "block", F.lit("").alias("subroot"), no_path.alias("path"))
    over = _paths(upper, start, ["name"]).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("block"), F.col("h").alias("subroot"), "path")
    root = F.lit(upper[-1].select("top").first()["top"] if count else None)
    out = _paths(rounds, over, carried)
    fold = F.aggregate("path", F.col("probe"), lambda held, step: digest(F.concat(step["left"], held, step["right"])))
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    return out.select(
        F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("source"), "doc_id", F.col("h").alias("leaf"), "subroot",
        root.cast("string").alias("root"), digest(siblings).alias("proof_sha256"), fold.alias("folded_root"),
        (fold == root).alias("verified"))
