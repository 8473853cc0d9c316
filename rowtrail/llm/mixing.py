"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from rowtrail.llm.common import stored, text_or_empty
from rowtrail.sources.ids import with_position

#: Equal parts into which a round of ``_walk`` cuts the range of values that is left.
PARTS = 4096


def _walk(rows: DataFrame, by: str, sums: list[str], reached: Callable) -> tuple[list[float], float | None]:
    """Sums over the rows below the first value of ``by`` at which ``reached(sums up to it, value)`` holds, and the last value below it.

    ``reached`` must stay true for larger values.  Each round looks at one row of sums per part and goes
    on in the part in which it becomes true, until that part holds a single value; so no task or
    driver sees more than ``PARTS`` rows, however many rows share a part or a value.
    """
    passed, last = [0] * len(sums), None
    low, high = rows.agg(F.min(by), F.max(by)).first()
    while low is not None:
        part = F.least(F.floor((F.col(by) - low) / ((high - low) / PARTS)), F.lit(PARTS - 1)) if high > low else F.lit(0)
        parts = rows.groupBy(part.alias("part")).agg(F.min(by), F.max(by), *[F.sum(c) for c in sums]).collect()
        for _, first, end, *more in sorted(parts):
            through = [x + y for x, y in zip(passed, more)]
            if reached(through, end):
                break
            passed, last = through, end
        else:
            break
        if first == end:
            break
        low, high = first, end
        rows = stored(rows.where(F.col(by).between(low, high)), "walk")
    return passed, last


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """Add ``target``: shares of the budget by weight, at most ``repeats`` times the source's size.

    A source is capped when the level of tokens per unit of weight is above its cap by weight; the
    level at which all targets meet the budget is found by walking these values.
    """
    ranked = with_position(sources.withColumn("__null", F.col("source").isNull()), ["__null", "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(repeats)
    ranked = stored(ranked.select("source", "source_size", "n_docs", weight.alias("weight"), cap.alias("cap"),
                                  (cap / weight).alias("full")), "targets")
    total, weights_sum = (x or 0 for x in ranked.agg(F.sum("source_size"), F.sum("weight")).first())
    budget = share * float(total)
    (used, gone), last = _walk(ranked, "full", ["cap", "weight"], lambda s, full: s[0] + full * (weights_sum - s[1]) >= budget)
    level = (budget - used) / (weights_sum - gone) if weights_sum > gone else last or 0.0
    return ranked.drop("full").withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)))


def _cut(items: DataFrame, budget: float) -> float:
    """The largest finish time up to which all items fit the budget; 0 if there is none."""
    return _walk(items, "finish", ["size"], lambda s, _: s[0] > budget)[1] or 0.0


def mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
        repeats: int = 2, rows_per_bucket: int = 20_000, seed: int = 7) -> DataFrame:
    """How often each document enters a mix whose sources get tokens by weight.

    Sources in code point order (null last) take the weights in turn.  A source's documents are
    shuffled by a hash; a document's virtual finish time is the cumulative size of its source
    divided by the source's target, and a second pass goes on where the first ended.  All passes
    are sorted by finish time and cut at the budget, ``share`` of all sizes.  The cumulative sums
    come from sums of hash ranges, so a source of any size is spread over many tasks.

    Size is the number of words between blanks.  A null text has size 0 and is never taken; rows
    with equal ids are separate documents; equal finish times are taken together or not at all;
    an empty table gives an empty result.  Only ``doc_id``, ``text`` and ``source`` are read.
    """
    words = F.regexp_count(text_or_empty(), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    sizes = stored(documents.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"))
                   .withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(1 << 52))
                               / F.lit(float(1 << 52))), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = stored(_targets(sources, weights, share, repeats), "targets")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    joined = (sizes.alias("d").join(targets.withColumnRenamed("source", "s"), F.col("d.source").eqNullSafe(F.col("s")))
              .withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("n_docs") / rows_per_bucket)))
              .select("doc_id", "source", "size", "u", "bucket", "source_size", "target"))
    spread = stored(joined, "spread")
    sums = spread.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                          F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    within = (Window.partitionBy("source", "bucket").orderBy("u", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = spread.withColumn("run", F.sum("size").over(within))
    timed = stored(run.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
                   .select("doc_id", "source", "size", "source_size", "target",
                           (F.col("base") + F.col("run")).alias("reached")), "timed")

    def finish(turn):
        return (F.col("reached") + F.col("source_size") * turn) / F.col("target")

    items = (timed.where("size > 0 and target > 0").select("size", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
             .alias("turn"), "reached", "source_size", "target").select("size", finish(F.col("turn")).alias("finish")))
    cut = _cut(items, budget * (1 + 1e-12))
    copies = sum((F.when(finish(F.lit(k)) <= cut, 1).otherwise(0) for k in range(repeats)), F.lit(0))
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(0)
    return timed.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"),
                        "source", F.when(F.col("target") > 0, finish(F.lit(0))).alias("finish"))
