"""Reversible line dedup: exact line postings, and sharded cuckoo filters of the repeated lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtrail.llm.common import stored, text_or_empty, texts
from rowtrail.llm.cuckoo import CuckooFilter

KEY_BYTES = 16


def _keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """A 128-bit key per line; None for lines that are too short to count."""
    out = []
    for line in text.split(b"\n"):
        line = line.strip().lower()
        long = len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(line) if long else None)
    return out


def _half(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2]


#: Repeated lines of a shard: the number of shards follows their count.
SHARD_LINES = 200_000
LEAST_SHARDS = 16


class LineStore:
    """Which lines repeat across documents; documents can be inserted and deleted again.

    ``postings`` has a row per document and distinct line of at least ``min_chars`` code points:
    (key, doc_id, n), n counting insertions less deletions of rows.  ``heavy`` sums it to exact
    reference counts and keepers (the largest doc_id) of the keys that at least ``min_docs`` rows hold.
    ``filters`` has one cuckoo filter per shard of these keys; it decides only which lines are looked
    up in the exact table, so its false positives never change a result.  Beyond ``max_filter_bytes``
    the filters are not sent to the tasks and every line is looked up: the same rows, more of them
    shuffled.  There are as many shards as keep ``SHARD_LINES`` keys in each.

    Each row is a document of its own, also where ids repeat: a line counts once per row, and all
    rows with the keeper's id keep it.  Null texts are one empty line.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 5, min_chars: int = 40, max_filter_bytes: int = 256 << 20):
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.shards, self.max_filter_bytes = LEAST_SHARDS, max_filter_bytes
        self.postings: DataFrame | None = None
        self.heavy: DataFrame | None = None
        self.filters: DataFrame | None = None

    def _postings(self, documents: DataFrame) -> DataFrame:
        min_chars = self.min_chars

        def run(batches):
            for batch in batches:
                keys, ids = [], []
                for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                    own = set(_keys(text, min_chars))
                    own.discard(None)
                    keys.extend(own)
                    ids.extend([doc] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())],
                                                 ["key", "doc_id"])

        rows = documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
        return rows.mapInArrow(run, "key binary, doc_id long")

    def insert(self, documents: DataFrame) -> "LineStore":
        return self._change(self._postings(documents).withColumn("n", F.lit(1).cast("long")))

    def delete(self, documents: DataFrame) -> "LineStore":
        """Take back documents that were inserted with these ids and texts."""
        return self._change(self._postings(documents).withColumn("n", F.lit(-1).cast("long")))

    def _change(self, delta: DataFrame) -> "LineStore":
        if self.postings is None:
            self.postings = stored(delta, "postings")
            live = self.postings
        else:
            rows = self.postings.unionByName(delta)
            self.postings = stored(rows.groupBy("key", "doc_id").agg(F.sum("n").alias("n")).where("n <> 0"), "postings")
            live = self.postings
        heavy = stored(live.groupBy("key").agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("keeper"))
                       .where(F.col("n_docs") >= self.min_docs), "heavy")
        shards = max(LEAST_SHARDS, -(-heavy.count() // SHARD_LINES))
        if self.filters is not None and shards > 2 * self.shards:
            self.filters = None  # too few shards by now: all are built anew
        if self.filters is None:
            self.shards, self.heavy = shards, None
        self.filters = self._filters(self.heavy, heavy)
        self.heavy = heavy
        return self

    def _filters(self, old: DataFrame | None, new: DataFrame) -> DataFrame:
        shards = self.shards
        schema = "shard int, room long, filter binary"
        if old is None:
            changes = new.select("key", F.lit(1).alias("sign"))
        else:
            changes = (old.select("key", F.lit(-1).alias("sign")).unionByName(new.select("key", F.lit(1).alias("sign")))
                       .groupBy("key").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0"))
        tail = F.conv(F.hex(F.substring("key", KEY_BYTES - 3, 4)), 16, 10).cast("long")
        changes = changes.select((tail % shards).cast("int").alias("shard"), "key", "sign")
        known = self.filters

        def build(state, rows):
            add = _half([k for k, s in zip(rows["key"], rows["sign"]) if s > 0])
            drop = _half([k for k, s in zip(rows["key"], rows["sign"]) if s < 0])
            made = CuckooFilter.from_bytes(state) if state is not None else None
            if made is not None:
                for h in drop:
                    made.delete(h)
                return made if made.insert_all(add) else None
            return CuckooFilter.of(add)

        def fresh(rows):
            import pandas as pd

            made = build(None, rows)
            return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "room": [len(rows)], "filter": [made.to_bytes()]})

        def update(key, states, rows):
            import pandas as pd

            state = states["filter"].iloc[0] if len(states) else None
            made = build(state, rows) if len(rows) or state is None else CuckooFilter.from_bytes(state)
            return pd.DataFrame({"shard": [int(key[0])], "room": [len(rows)],
                                 "filter": [made.to_bytes() if made is not None else None]})

        if known is None:
            return stored(changes.groupBy("shard").applyInPandas(fresh, schema), "filters")
        made = stored(known.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(update, schema), "filters")
        full = [r[0] for r in made.where("filter is null").select("shard").collect()]
        if not full:
            return made
        # a full filter is built anew, larger, from the exact table
        again = (new.select((tail % shards).cast("int").alias("shard"), "key", F.lit(1).alias("sign"))
                 .where(F.col("shard").isin(full)).groupBy("shard").applyInPandas(fresh, schema))
        return stored(made.where("filter is not null").unionByName(again), "filters")

    def _shared_filters(self):
        """The filters as a broadcast value, or None beyond the size bound (then all keys are looked up)."""
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size > self.max_filter_bytes:
            return None
        return self.spark.sparkContext.broadcast({r[0]: r[1] for r in self.filters.select("shard", "filter").collect()})

    def _drops(self, shared) -> DataFrame:
        """(doc_id, key) of the lines that go, by the exact table."""
        keys, shards = self.postings.select("key", "doc_id"), self.shards

        def near(batches):
            held = {s: CuckooFilter.from_bytes(f) for s, f in shared.value.items()}
            for batch in batches:
                yield batch.filter(pa.array(_hits(b"".join(batch.column(0).to_pylist()), held, shards)))

        if shared is not None:
            keys = keys.mapInArrow(near, "key binary, doc_id long")
        return (keys.join(self.heavy, "key").where(F.col("keeper").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
                .select("doc_id", "key"))

    def apply(self, documents: DataFrame) -> DataFrame:
        """The documents with repeated lines taken out, and ``n_lines``, ``n_dropped``.

        A null text stays null and counts as one empty line.  Rows with equal ids lose the same lines.
        Lines that only rows without id hold stay.  All other columns stay, but for those of
        these two names, which are replaced.

        The lines that go are known from the postings, so only documents that lose some are taken
        apart again.  Their keys are joined by id, which shuffles the texts once at every size.
        """
        min_chars = self.min_chars
        documents = documents.drop("n_lines", "n_dropped")
        gone = stored(self._drops(self._shared_filters()).groupBy("doc_id").agg(F.collect_set("key").alias("gone")), "gone")

        def rewrite(batches):
            for batch in batches:
                text, drops = batch.column(0), batch.column(1)
                n_lines = pc.add(pc.fill_null(pc.count_substring(text, "\n"), 0).cast(pa.int64()), 1)
                n_dropped, made = np.zeros(batch.num_rows, np.int64), []
                hit = np.flatnonzero(np.asarray(drops.is_valid()) & np.asarray(text.is_valid()))
                for i, raw, gone in zip(hit.tolist(), texts(text.take(pa.array(hit))), drops.take(pa.array(hit)).to_pylist()):
                    gone, rows = set(gone), raw.split(b"\n")
                    kept = [r for r, k in zip(rows, _keys(raw, min_chars)) if k is None or k not in gone]
                    made.append(b"\n".join(kept).decode("utf-8", "surrogateescape"))
                    n_dropped[i] = len(rows) - len(kept)
                mask = np.zeros(batch.num_rows, bool)
                mask[hit] = True
                text = pc.replace_with_mask(text, pa.array(mask), pa.array(made, text.type))
                yield pa.RecordBatch.from_arrays([text, n_lines, pa.array(n_dropped), *batch.columns[2:]],
                                                 ["__text", "n_lines", "n_dropped", *batch.schema.names[2:]])

        rest = [f for f in documents.schema.fields if f.name != "text"]
        named = {f.name: f"__c{i}" for i, f in enumerate(rest)}
        tail = ", ".join(f"{named[f.name]} {f.dataType.simpleString()}" for f in rest)
        flat = documents.select(F.col("text").cast("string").alias("__t"), *[F.col(f"`{f.name}`").alias(named[f.name]) for f in rest])
        held = flat.join(gone.hint("merge"), F.col(named["doc_id"]).cast("long").eqNullSafe(F.col("doc_id")), "left")
        out = held.select("__t", "gone", *named.values()).mapInArrow(rewrite, f"__text string, n_lines long, n_dropped long, {tail}")
        return out.select(*[F.col("__text").alias("text") if c == "text" else F.col(named[c]).alias(c) for c in documents.columns],
                          "n_lines", "n_dropped")


def _hits(keys: bytes, held: dict[int, CuckooFilter], shards: int) -> np.ndarray:
    """Which of the joined keys are in the filter of their shard."""
    low = np.frombuffer(keys, np.uint64)[::2]
    shard = np.frombuffer(keys, ">u4")[3::4].astype(np.int64) % shards
    hit = np.zeros(len(low), bool)
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for s, one in held.items():
        at = order[bounds[s]:bounds[s + 1]]
        if len(at):
            hit[at] = one.contains(low[at])
    return hit


def line_dedup(documents: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """Insert all documents and take the repeated lines out of them; see ``LineStore``."""
    return LineStore(documents.sparkSession, min_docs, min_chars).insert(documents).apply(documents)
