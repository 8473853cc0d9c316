"""Benchmark items inside documents: size-partitioned MinHash containment, exact check; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtrail.llm.common import stored, text_or_empty

WIDTH = 5


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, width: int) -> Column:
    """All runs of ``width`` words; empty for shorter texts."""
    return F.when(F.size(words) >= width, F.transform(
        F.sequence(F.lit(0), F.size(words) - width),
        lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)]))).otherwise(F.array().cast("array<string>"))


def _hashes(words: Column, width: int) -> Column:
    return F.when(F.size(words) >= width, F.transform(
        F.sequence(F.lit(0), F.size(words) - width),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))).otherwise(F.array().cast("array<long>"))


def benchmark_sketches(items: DataFrame, threshold: float, width: int = WIDTH) -> DataFrame:
    """(item_id, item, size, width, shingles, sketch) of the items that have words.

    Items are partitioned by the power of two of their size; the MinHash sketch of a partition
    keeps the k smallest shingle hashes, k = u - ceil(threshold * u) + 1 for its upper size u.  A
    document that holds at least ``threshold`` of an item misses fewer than k of its shingles, so
    it holds one of the sketch: no contained item is lost.
    """
    words = items.select("item_id", _words(text_or_empty()).alias("words")).where("size(words) > 0")
    narrow = F.least(F.lit(width), F.size("words"))
    shingled = words.withColumn("width", narrow).withColumn(
        "shingles", F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("width")),
                                                 lambda i: F.array_join(F.slice("words", i + 1, F.col("width")), " "))))
    sized = shingled.withColumn("size", F.size("shingles"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size").cast("double"))))
    keep = (upper - F.ceil(upper * threshold) + 1).cast("int")
    hashed = F.transform("shingles", lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s")))
    ranked = F.transform(F.slice(F.array_sort(hashed), F.lit(1), keep), lambda x: x["s"])
    return sized.withColumn("sketch", ranked).withColumn("item", F.monotonically_increasing_id()).drop("words")


def contained_items(documents: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = WIDTH) -> DataFrame:
    """``(doc_id, item_id, item_size, shared, containment)`` where a document holds enough of an item.

    Sets of five-word shingles, words being lower-cased runs of letters and digits; an item of
    fewer words is one shingle of all its words.  ``containment`` is the shared part of the item's
    set, at least ``threshold``.  Null and empty texts and items match nothing; repeated rows of
    either side are one row of the result per pair of ids.

    The sketches are stored, so Catalyst broadcasts them by their measured size and shuffles when
    they are large.  Candidates are kept per distinct text hash, which folds groups of copies;
    only documents with a candidate take part in the exact check.
    """
    known = stored(benchmark_sketches(items, threshold, width), "items")
    widths = sorted(r[0] for r in known.select("width").distinct().collect())  # at most five values
    sketch = stored(known.select("item", "width", "size", F.explode("sketch").alias("s"))
                    .select("item", "width", "size", F.split("s", " ").alias("w"))
                    .select("item", "size", F.col("width").alias("k"), _by_width("w", "width", widths).alias("h")), "sketch")
    docs = documents.select("doc_id", text_or_empty().alias("text"))
    hashed = docs.select(F.xxhash64("text").alias("content"), _words(F.col("text")).alias("words"))
    found = None
    for k in widths:
        part = (hashed.select("content", F.size("words").alias("n"), F.explode(_hashes(F.col("words"), k)).alias("h"))
                .join(sketch.where(F.col("k") == k).drop("k"), "h").where(F.col("n") - (k - 1) >= F.ceil(F.col("size") * threshold))
                .select("content", "item"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, item_size int, shared int, containment double")
    pairs = stored(found.distinct(), "pairs")
    near = docs.withColumn("content", F.xxhash64("text")).join(pairs.select("content").distinct(), "content", "left_semi")
    sets = near.select("doc_id", "content", _words(F.col("text")).alias("words"))
    sets = sets.select("doc_id", "content", *[F.array_distinct(_shingles(F.col("words"), k)).alias(f"s{k}") for k in widths])
    checked = (sets.join(pairs, "content").join(known.select("item", "item_id", "size", "width", "shingles"), "item"))
    shared = F.lit(0)
    for k in widths:
        shared = F.when(F.col("width") == k, F.size(F.array_intersect("shingles", f"s{k}"))).otherwise(shared)
    return (checked.select("doc_id", "item_id", F.col("size").alias("item_size"), shared.alias("shared"))
            .where(F.col("shared") >= F.ceil(F.col("item_size") * threshold))
            .groupBy("doc_id", "item_id").agg(F.max("item_size").alias("item_size"), F.max("shared").alias("shared"))
            .withColumn("containment", F.col("shared") / F.col("item_size")))


def _by_width(words: str, width: str, widths: list[int]) -> Column:
    out = F.lit(None).cast("long")
    for k in widths:
        out = F.when(F.col(width) == k, F.xxhash64(*[F.get(F.col(words), i) for i in range(k)])).otherwise(out)
    return out


def drop_contaminated(documents: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents that hold no item; all columns stay."""
    bad = contained_items(documents, items, threshold).select(F.col("doc_id").alias("__bad")).distinct()
    return documents.join(stored(bad, "contaminated"), F.col("doc_id").eqNullSafe(F.col("__bad")), "left_anti")
