"""Ranked lexical search by norm buckets: inner products with impact vectors, longest vectors first."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rowtrail.llm.common import stored, text_or_empty, texts

#: Bytes that become a blank before a text is split: everything in ASCII but letters and digits.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Vectors of a bucket; query texts held by a task at once (further ones take another pass).
BUCKET, BLOCK_BYTES = 512, 32 << 20
ONE = 10 ** 9


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of other than ASCII characters, A-Z lower-cased."""
    return text.translate(_FOLD).split()


@dataclass
class Queries:
    """A block of queries as sparse rows over their own vocabulary; ``weights`` and ``norms`` follow from the corpus."""

    items: list
    vocabulary: dict[bytes, int]
    columns: np.ndarray
    starts: np.ndarray
    weights: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list[tuple[object, bytes]]) -> "Queries":
        """Texts of one item count as one; items without terms find nothing and are left out."""
        sets: dict[object, set[bytes]] = {}
        for item, text in rows:
            sets.setdefault(item, set()).update(terms(text))
        items = [i for i, own in sets.items() if own]
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*sets.values())))} if sets else {}
        columns = [sorted(vocabulary[t] for t in sets[i]) for i in items]
        starts = np.cumsum([0, *map(len, columns)])
        return cls(items, vocabulary, np.array([c for own in columns for c in own], np.int64), starts)


def _counted(vocabulary: dict[bytes, int]):
    """(doc_id, n, cols, tfs): the number of terms of each text, and its counts over the vocabulary as packed int32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary.value
        for batch in batches:
            sizes, cols, counts = [], [], []
            for text in texts(batch.column(1)):
                own = terms(text)
                known = np.array([k for k in map(held.get, own) if k is not None], np.int32)
                here, tf = np.unique(known, return_counts=True)
                sizes.append(len(own))
                cols.append(here.tobytes())
                counts.append(tf.astype(np.int32).tobytes())
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(cols, pa.binary()), pa.array(counts, pa.binary())],
                                              ["doc_id", "n", "cols", "tfs"])
            yield made.filter(pa.array(np.array(sizes, np.int64) > 0))
    return run


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All packed int32 values of a binary column and the number in each row."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.int32), np.array([len(v) // 4 for v in column.to_pylist()], np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(col, df), one row per term of the vocabulary that the task has seen."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        counts = np.bincount(_unpacked(batch.column(0))[0])
        if len(counts) > len(seen):
            seen, counts = counts.astype(np.int64), seen
        seen[:len(counts)] += counts
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["col", "df"])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Best:
    """The best rows so far of each query: scores downwards, equal ones by ascending id (null first)."""

    def __init__(self, queries: int, top: int, floors: np.ndarray):
        self.top = top
        self.rows: list[list[tuple[int, int, object]]] = [[] for _ in range(queries)]
        self.floors = floors.copy()

    def offer(self, query: int, scores: np.ndarray, ids: list) -> None:
        rows = self.rows[query] + [(-s, i is not None, i) for s, i in zip(scores.tolist(), ids)]
        rows.sort(key=lambda r: (r[0], r[1], r[2] if r[1] else 0))
        self.rows[query] = rows[:self.top]
        if len(rows) >= self.top:
            self.floors[query] = max(self.floors[query], -rows[self.top - 1][0])


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    lengths = ends - starts
    shift = np.repeat(starts - np.append(0, np.cumsum(lengths)[:-1]), lengths)
    return np.arange(lengths.sum()) + shift


def search_bucket(q: Queries, best: _Best, ids: list, rows: np.ndarray, cols: np.ndarray, impacts: np.ndarray, longest: float) -> int:
    """Offer the vectors of one bucket to every query; returns how many (query, vector) pairs were scored.

    1. Cauchy-Schwarz: no vector of the bucket scores more than the query's norm times the longest vector's.
    2. Coordinate bounds: nor more than the sum of weights times the bucket's largest coordinates.
    3. Inside: the least telling coordinates that cannot reach the floor even together are put off.
       Only vectors with a nonzero coordinate among the others are looked at; those whose partial score and
       the bound of the rest (by coordinates, and by Cauchy-Schwarz on what is left of the norms) stay
       below the floor go.
    4. The others are scored exactly in integers.

    A bound is compared with a margin of 1e-9 for its rounding; products of weights and impacts are exact.
    """
    n_docs, n_cols = len(ids), len(q.vocabulary)
    order = np.argsort(cols, kind="stable")
    by_rows, by_impacts = rows[order], impacts[order]
    at = np.searchsorted(cols[order], np.arange(n_cols + 1))
    peak = np.zeros(n_cols, np.int64)
    np.maximum.at(peak, cols, impacts)
    squares = np.bincount(rows, impacts.astype(float) ** 2, n_docs)
    bounds = q.weights * peak[q.columns]
    totals = np.add.reduceat(bounds, q.starts[:-1])
    norms = np.sqrt(np.add.reduceat(q.weights.astype(float) ** 2, q.starts[:-1]))
    slack = 1 + 1e-9
    alive = np.flatnonzero((totals > 0) & (norms * longest * slack >= best.floors) & (totals >= best.floors))
    scored = 0
    for i in alive.tolist():
        own = slice(q.starts[i], q.starts[i + 1])
        floor = max(int(best.floors[i]), 1)
        bound, w, columns = bounds[own], q.weights[own], q.columns[own]
        rank = np.argsort(bound)
        late = rank[:np.searchsorted(np.cumsum(bound[rank]), floor)]
        early = rank[len(late):]
        pick = _spread(at[columns[early]], at[columns[early] + 1])
        counts = at[columns[early] + 1] - at[columns[early]]
        partial = np.bincount(by_rows[pick], by_impacts[pick] * np.repeat(w[early], counts).astype(float), n_docs)
        if len(late):
            used = np.bincount(by_rows[pick], by_impacts[pick].astype(float) ** 2, n_docs)
            rest = np.sqrt((w[late].astype(float) ** 2).sum() * np.maximum(squares - used, 0) * slack)
            upper = partial + np.minimum(rest, bound[late].sum())
        else:
            upper = partial
        left = (partial > 0) & (upper * slack >= floor)
        if not left.any():
            continue
        pick = _spread(at[columns], at[columns + 1])
        whose, factor = by_rows[pick], np.repeat(w, at[columns + 1] - at[columns])
        mine = left[whose]
        score = np.zeros(n_docs, np.int64)
        np.add.at(score, whose[mine], by_impacts[pick][mine] * factor[mine])
        hit = np.flatnonzero(left & (score >= floor))
        scored += int(left.sum())
        best.offer(i, score[hit], [ids[k] for k in hit.tolist()])
    return scored


def _ranked(shared, top: int, n_docs: int, n_terms: int, first_only: bool):
    """(item, doc_id, score): the best rows of a task; or with ``first_only`` (item, floor) from its longest vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floors = shared.value
        best = _Best(len(q.items), top, floors)
        for number, batch in enumerate(batches):
            if first_only and number:
                continue
            cols, lengths = _unpacked(batch.column(2))
            tfs, _ = _unpacked(batch.column(3))
            n = batch.column(1).to_pylist()
            m = np.array([50 + 50 * own * n_docs // n_terms for own in n], np.int64)  # the product may leave 64 bits
            rows = np.repeat(np.arange(len(n)), lengths)
            tfs = tfs.astype(np.int64)
            impacts = ONE * tfs // (1000 * tfs + 20 * m[rows])
            length = np.sqrt(np.bincount(rows, impacts.astype(float) ** 2, len(n)))
            starts = np.append(0, np.cumsum(lengths))
            by_length = np.argsort(-length, kind="stable")
            ids = batch.column(0).to_pylist()
            for k in range(0, BUCKET if first_only else len(by_length), BUCKET):
                chosen = by_length[k:k + BUCKET]
                pick = _spread(starts[chosen], starts[chosen + 1])
                if not len(pick):
                    break
                search_bucket(q, best, [ids[j] for j in chosen.tolist()], np.repeat(np.arange(len(chosen)), lengths[chosen]),
                              cols[pick], impacts[pick], float(length[chosen[0]]))
        if first_only:
            at = np.flatnonzero(best.floors > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(best.floors[at])], ["query", "floor"])
            return
        for i, own in enumerate(best.rows):
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int32()), pa.array([r[2] for r in own], pa.int64()),
                                                  pa.array([-r[0] for r in own], pa.int64())], ["query", "doc_id", "score"])
    return run


def _search_block(documents: DataFrame, q: Queries, top: int) -> DataFrame | None:
    spark = documents.sparkSession
    context = spark.sparkContext
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    counted = stored(rows.mapInArrow(_counted(context.broadcast(q.vocabulary)), "doc_id long, n long, cols binary, tfs binary"), "term-counts")
    n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(q.vocabulary), np.int64)
    for col, seen in counted.select("cols").mapInArrow(_frequencies, "col int, df long").groupBy("col").agg(F.sum("df")).collect():
        df[col] = seen  # one number per term of the block
    of_term = np.array([weight(n_docs, int(f)) for f in df], np.int64)
    q.weights = of_term[q.columns]
    no_floor = np.zeros(len(q.items), np.int64)
    shared = context.broadcast((q, no_floor))
    floors = no_floor.copy()
    for query, floor in counted.mapInArrow(_ranked(shared, top, n_docs, n_terms, True), "query int, floor long").groupBy("query").agg(F.max("floor")).collect():
        floors[query] = floor  # one number per query of the block
    shared = context.broadcast((q, floors))
    found = counted.mapInArrow(_ranked(shared, top, n_docs, n_terms, False), "query int, doc_id long, score long")
    items = spark.createDataFrame(list(enumerate(q.items)), "query int, item_id long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, top: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with the highest positive scores for every item.

    With N documents that have a term, L terms in all, a document of n terms has m = 50 + 50 n N div L,
    and scores for an item the sum over its distinct terms of w * (10^9 tf div (1000 tf + 20 m)),
    w = floor(1000 ln((2 N + 2) / (2 df + 1))).  So a score is the inner product of the item's
    weights and the document's vector of impacts.

    Each task orders its vectors by length and cuts them into buckets (``search_bucket``).  A floor per
    item, the score that ``top`` documents reach for certain, comes from the longest vectors of every task
    first and rises as a task goes on; bounds only skip what stays below it, so the result is exact.
    Items are taken in blocks of ``block_bytes`` of text; only a block's terms and floors are
    sent to the tasks, and a task returns at most ``top`` rows per item.

    Null texts have no terms; an item without terms finds nothing; rows of one item_id count as one
    item; repeated documents are ranked each; a null doc_id comes before others of equal score.  An
    empty table on either side gives no rows.  Further columns are not read.
    """
    spark = documents.sparkSession
    texts_of = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).distinct()
    size = texts_of.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    dealt = texts_of.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))))
    for b in range(blocks):
        q = Queries.of([(r["item_id"], r["text"].encode()) for r in dealt.where(F.col("block") == b).collect()])
        found = _search_block(documents, q, top) if q.items else None
        if found is not None:
            out = out.unionByName(found)
    return out
