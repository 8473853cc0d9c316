"""Near-duplicate embeddings by spherical-cap filters from random product codes."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowtrail.llm.common import sorted_groups, stored
from rowtrail.llm.components import connected_components
from rowtrail.llm.ngram_join import forest

#: Vectors of a block of a filter that are compared at once.
BLOCK = 1024


class ProductCode:
    """Filter directions (c_i, c_j) of two random codebooks on the halves of a rotated vector."""

    def __init__(self, dims: int, words: int, cap: float, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.half = (dims + 1) // 2
        self.words, self.cap = words, cap
        self.turn = np.linalg.qr(draw.standard_normal((2 * self.half, 2 * self.half)))[0][:dims]
        books = draw.standard_normal((2, words, self.half))
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True) / math.sqrt(2)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List decoding: (row, filter) of all filters whose direction exceeds the cap height.

        The best direction counts even below the cap, so every vector has a filter.
        """
        turned = unit @ self.turn
        left, right = turned[:, :self.half] @ self.books[0].T, turned[:, self.half:] @ self.books[1].T
        best = right.max(axis=1)
        rows, filters = [], []
        for i in range(self.words):  # a first word is followed only where the best second word can exceed the cap
            near = np.flatnonzero(left[:, i] + best > self.cap)
            r, j = np.nonzero(left[near, i][:, None] + right[near] > self.cap)
            rows.append(near[r])
            filters.append(i * self.words + j)
        rows.append(np.arange(len(unit)))
        filters.append(left.argmax(axis=1) * self.words + right.argmax(axis=1))
        return np.concatenate(rows), np.concatenate(filters)


class Codes:
    """Several product codes with their own rotation; a pair is lost only if all of them lose it."""

    def __init__(self, codes: list[ProductCode]):
        self.codes = codes

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [code.decode(unit) for code in self.codes]
        step = self.codes[0].words ** 2
        return (np.concatenate([r for r, _ in found]), np.concatenate([f + k * step for k, (_, f) in enumerate(found)]))


@lru_cache(maxsize=16)
def code_for(dims: int, vectors: int, per_filter: int = 1024, filters_each: float = 8.0, turns: int = 5) -> Codes:
    """More vectors get more and smaller caps: the expected members of a filter stay the same."""
    total = max(256, vectors * filters_each / per_filter)
    words = math.ceil(math.sqrt(total))
    share = min(0.5, filters_each / words ** 2)
    low, high = 0.0, 8.0
    for _ in range(60):  # height of a cap with this share of a Gaussian
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(mid / math.sqrt(2)) > share else (low, mid)
    return Codes([ProductCode(dims, words, low / math.sqrt(max(1, dims)), seed=5 + k) for k in range(turns)])


def _unit(values: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Double precision unit vectors and which rows have one (right length, finite, not zero)."""
    sizes = np.asarray(values.value_lengths().fill_null(0))
    flat = values.flatten()
    valid = np.asarray(flat.is_valid())
    data = np.where(valid, flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), np.nan)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    good = sizes == dims
    out = np.zeros((len(values), dims))
    at = np.flatnonzero(good)
    if len(at):
        out[at] = data[ends[at][:, None] + np.arange(dims)]
    top = np.abs(out).max(axis=1, initial=0.0)
    good &= np.isfinite(top) & np.isfinite(out).all(axis=1) & (top > 0)
    out[~good] = 0.0
    out /= np.where(good, top, 1.0)[:, None]  # else squares of very large or small values leave the range
    norm = np.linalg.norm(out, axis=1)
    return out / np.where(good, norm, 1.0)[:, None], good


def near_vectors(embeddings: DataFrame, least_cosine: float = 0.95) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of equal length are compared by cosine in double precision, whatever their labels.
    Vectors that are null or zero, or that hold null or non-finite components, link with nothing.  ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id that links reach, ``kept`` marks it.  Repeated rows
    are separate vectors; rows with a null id link, but their id is never the smallest.

    Equal vectors are compared once.  Every length has codes of its own, sized by its number
    of vectors.  Every vector is listed for all filter directions of its length that it exceeds; the members of a filter are cut into blocks, and block pairs are multiplied in tasks
    of bounded size.  A pair is counted in the smallest filter that it shares, and a task gives
    link counts and a spanning forest, never pairs.
    """
    single = embeddings.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if single else "array<double>")).withColumn("size", F.size("embedding"))
    rows = rows.withColumn("hash", F.sha2(F.array_join(F.transform("embedding", lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ","), 256))
    rows = stored(rows, "vectors")
    distinct = stored(rows.where(F.col("embedding").isNotNull()).groupBy("hash").agg(
        F.first("embedding").alias("embedding"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")), "distinct")
    lengths = dict(distinct.where("size > 0").groupBy("size").count().collect())  # one number per length

    def decode(batches):
        for mixed in batches:
            sizes = mixed.column(3).to_numpy()
            for dims in np.unique(sizes[sizes > 0]).tolist():
                batch = mixed.filter(pa.array(sizes == dims))
                unit, good = _unit(batch.column(1), dims)
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                r, f = code_for(dims, lengths[dims]).decode(unit[at])
                both = np.unique(np.stack([at[r], f], axis=1), axis=0)
                cuts = np.searchsorted(both[:, 0], at, side="left")
                lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(both)), pa.int32()), pa.array(both[:, 1].astype(np.int32)))
                own = batch.take(pa.array(at))
                raw = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)
                packed = both[:, 1].astype(np.int32).tobytes()
                packed = [packed[4 * a:4 * b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(both)])]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(raw.view(f"V{dims * kind().itemsize}")[:, 0].tolist(), pa.binary()), own.column(2), own.column(3), lists, pa.array(packed, pa.binary())],
                    ["hash", "unit", "copies", "size", "filters", "packed"])

    # the lists travel packed: only those of linked vectors are looked at again
    listed = stored(distinct.select("hash", "embedding", "copies", "size").mapInArrow(
        decode, "hash string, unit binary, copies long, size int, filters array<int>, packed binary").withColumn("id", F.monotonically_increasing_id()), "listed")
    entries = listed.select("size", F.explode("filters").alias("f"))
    sizes = entries.groupBy("size", "f").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = stored(sizes.select("size", "f", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "filtersizes")
    placed = listed.select("id", "unit", "copies", "size", "packed", F.explode("filters").alias("f")).join(parts, ["size", "f"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", "f"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")
    spread = placed.select("*", other).select("size", "f", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"),
                                              (F.col("block") > F.col("o")).cast("int").alias("side"), "id", "unit", "copies", "packed")
    arranged = spread.repartition("size", "f", "bi", "bj").sortWithinPartitions("size", "f", "bi", "bj", "side", "id")

    def multiply(batches):
        for rows_ in sorted_groups(batches, ["size", "f", "bi", "bj"]):
            dims, f = rows_.column("size")[0].as_py(), rows_.column("f")[0].as_py()
            side = rows_.column("side").to_numpy()
            ids, copies = rows_.column("id").to_numpy(), rows_.column("copies").to_numpy()
            raw = np.frombuffer(b"".join(rows_.column("unit").to_pylist()), kind).astype(np.float64)
            unit, _ = _unit(pa.FixedSizeListArray.from_arrays(pa.array(raw), dims).cast(pa.list_(pa.float64())), dims)
            packed = rows_.column("packed")
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            same = rows_.column("bi")[0].as_py() == rows_.column("bj")[0].as_py()
            y = x if same else y
            if not len(x) or not len(y) or same and len(x) == 1:
                continue
            hits = unit[x] @ unit[y].T >= least_cosine
            if same:
                np.fill_diagonal(hits, False)
            i, j = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
            if not len(i):
                continue
            hits[np.ix_(i, j)] &= ~_shares_smaller(_unpacked(packed, x[i]), _unpacked(packed, y[j]), f)
            a, b, n = [], [], []
            for own, table, weight in ((x, hits, copies[y]), (y, hits.T, copies[x])):
                count = table.astype(np.int64) @ weight
                at = np.flatnonzero(count)
                a += ids[own[at]].tolist()
                b += [None] * len(at)
                n += count[at].tolist()
                if same:
                    break
            for i, j in forest(hits):
                a.append(int(ids[x[i]])), b.append(int(ids[y[j]])), n.append(0)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    links = stored(arranged.mapInArrow(multiply, "a long, b long, n long"), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    joined = stored(connected_components(links.where("b is not null")), "joined")
    named = (listed.select("id", "hash", "copies").join(joined.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
             .join(distinct.select("hash", "least"), "hash").withColumn("component", F.coalesce("component", "id")))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = stored(named.join(smallest, "component").select("hash", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "final")
    out = rows.select("vec_id", "hash").join(final, "hash", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _unpacked(packed: pa.ChunkedArray, rows: np.ndarray) -> list[np.ndarray]:
    return [np.frombuffer(raw, np.int32) for raw in packed.take(pa.array(rows)).to_pylist()]


def _shares_smaller(left: list[np.ndarray], right: list[np.ndarray], f: int) -> np.ndarray:
    """Which pairs of filter lists share a filter below ``f``: such a pair is counted there."""
    out = np.zeros((len(left), len(right)), bool)
    sides = []
    for lists in (left, right):
        rows, filters = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
        rows, filters = rows[filters < f], filters[filters < f]
        order = np.argsort(filters, kind="stable")
        sides.append((rows[order], filters[order]))
    (a, fa), (b, fb) = sides
    for g in np.intersect1d(fa, fb).tolist():
        out[np.ix_(a[np.searchsorted(fa, g):np.searchsorted(fa, g, "right")], b[np.searchsorted(fb, g):np.searchsorted(fb, g, "right")])] = True
    return out
