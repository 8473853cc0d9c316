"""Toxicity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowtrail.llm.common import stored, text_or_empty, texts

PREFIXES = (4, 5, 6)
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
GRADES = 3


def distinct_words(text: bytes) -> set[bytes]:
    """Words of letters, A-Z lower-cased; all other ASCII characters part words."""
    return set(text.translate(_CLEAN).split())


def word_features(word: bytes) -> list[bytes]:
    """The word itself and its first bytes, so that unseen forms of a stem count too."""
    return [b"=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """P(grade > j) = sigmoid(w.x - theta_j): one weight vector, ordered thresholds."""

    def __init__(self, weights: dict[bytes, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, docs: list[set[bytes]], toxic: np.ndarray, features: int = 20_000, min_docs: int = 5,
            steps: int = 400, l1: float = 2e-4) -> "OrdinalModel":
        """Proximal gradient descent in numpy.

        The labels are binary, so the upper grades come from the toxic rows themselves: those with
        at least the median number of words that are typical of toxic rows have the top grade.
        """
        counts: dict[bytes, list[int]] = {}
        for words, y in zip(docs, toxic):
            for f in {f for w in words for f in word_features(w)}:
                counts.setdefault(f, [0, 0])[int(y)] += 1
        n = np.array([max(1, (toxic == 0).sum()), max(1, (toxic == 1).sum())], float)
        names = [f for f, c in counts.items() if sum(c) >= min_docs]
        rate = np.array([counts[f] for f in names], float).reshape(-1, 2) / n
        pooled = rate.mean(axis=1)
        gain = (rate[:, 1] - rate[:, 0]) / np.sqrt(pooled * (1 - pooled) * (1 / n).sum() + 1e-12)
        best = np.argsort(-np.abs(gain), kind="stable")[:features]
        names, gain = [names[i] for i in best], gain[best]
        index = {f: i for i, f in enumerate(names)}
        rows, cols = [], []
        for r, words in enumerate(docs):
            for w in words:
                own = [index[f] for f in word_features(w) if f in index]
                cols += own
                rows += [r] * len(own)
        rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
        typical = gain > 0.5 * max(1.0, gain.max(initial=1.0))
        hits = np.bincount(rows[typical[cols]], minlength=len(docs)) if len(rows) else np.zeros(len(docs))
        grade = np.where(toxic == 1, 1, 0)
        if (toxic == 1).any():
            grade = np.where((toxic == 1) & (hits >= np.median(hits[toxic == 1])), GRADES - 1, grade)
        share = np.where(toxic == 1, 0.5 / n[1], 0.5 / n[0])
        w, theta = np.zeros(len(names)), np.array([0.0, 1.0])
        rate_w = 2.0 / np.sqrt(np.maximum(np.bincount(cols, minlength=len(names)), 1))  # frequent features move slowly
        for _ in range(steps):
            z = np.bincount(rows, w[cols], minlength=len(docs)) if len(rows) else np.zeros(len(docs))
            p = _sigmoid(z[:, None] - theta[None, :])  # P(grade > j)
            above = np.concatenate([np.ones((len(docs), 1)), p, np.zeros((len(docs), 1))], axis=1)
            at = np.arange(len(docs))
            mass = np.maximum(above[at, grade] - above[at, grade + 1], 1e-9)
            slope = above * (1 - above)
            dz = -share * (slope[at, grade] - slope[at, grade + 1]) / mass
            dtheta = np.zeros(GRADES - 1)
            for j in range(GRADES - 1):
                up, down = grade == j + 1, grade == j
                dtheta[j] = (share * slope[:, j + 1] / mass)[up].sum() - (share * slope[:, j + 1] / mass)[down].sum()
            g = np.bincount(cols, dz[rows], minlength=len(names)) if len(rows) else np.zeros(len(names))
            w = w - 10 * rate_w * g
            w = np.sign(w) * np.maximum(np.abs(w) - 10 * rate_w * l1, 0.0)
            theta = np.sort(theta - 2.0 * dtheta)
        return cls({f: float(x) for f, x in zip(names, w) if x}, theta)

    def word_weight(self, word: bytes) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def above(self, scores: np.ndarray) -> np.ndarray:
        return _sigmoid(np.asarray(scores)[:, None] - self.thresholds[None, :])


def fit_toxicity(documents: DataFrame, labels: DataFrame, rows_per_label: int = 3000, seed: int = 11) -> OrdinalModel | None:
    """Fit on at most about ``rows_per_label`` labelled documents of each label, picked by a hash of the id.

    An id with several labels counts as toxic if one says so; null ids and labels are left out.  Of
    rows that repeat an id one is taken, so the sample stays within its bound.  None if either label
    is missing.  The picked ids are written, so that Catalyst sees how few they are and no text is
    shuffled to find theirs.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, rows_per_label / sizes[1])).otherwise(min(1.0, rows_per_label / sizes[0]))
    picked = stored(known.where(draw < share), "picked-labels")

    def run(batches):
        for batch in batches:
            words = [b" ".join(sorted(distinct_words(t))).decode() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.string())],
                                             ["doc_id", "toxic", "words"])

    rows = (documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).join(picked, "doc_id")
            .select("doc_id", "text", F.col("toxic").cast("int")).mapInArrow(run, "doc_id long, toxic int, words string").groupBy("doc_id", "toxic").agg(F.min("words").alias("words")).collect())
    rows.sort(key=lambda r: (r[0], r[2]))
    if len({r[1] for r in rows}) < 2:
        return None
    return OrdinalModel.fit([set(r[2].encode().split()) for r in rows], np.array([r[1] for r in rows]))


def grade_toxicity(documents: DataFrame, model: OrdinalModel | None, memory: int = 400_000) -> DataFrame:
    """``severity`` (expected grade), ``grade``, ``p_toxic`` and ``toxic`` for every whole text.

    All other columns stay, but for those of these four names, which are replaced.  A null or empty
    text, and every text where there is no model, has severity 0.  A document is toxic when
    P(grade > 0) is at least one half.
    """
    documents = documents.drop("severity", "grade", "p_toxic", "toxic")
    columns = documents.columns
    named = {c: f"__c{i}" for i, c in enumerate(columns)}
    tail = ", ".join(f"{named[f.name]} {f.dataType.simpleString()}" for f in documents.schema.fields)

    def run(batches):
        known: dict[bytes, float] = {}
        for batch in batches:
            scores = np.full(batch.num_rows, -1e9)
            if model is not None:
                for i, text in enumerate(texts(batch.column(0))):
                    words = distinct_words(text)
                    total = 0.0
                    for w in words:
                        x = known.get(w)
                        if x is None:
                            if len(known) >= memory:
                                known.clear()
                            x = known[w] = model.word_weight(w)
                        if x:
                            total += x
                    if words:
                        scores[i] = total
                above = model.above(scores)
                above[scores <= -1e9] = 0.0
            else:
                above = np.zeros((batch.num_rows, GRADES - 1))
            severity = above.sum(axis=1)
            grade = (above >= 0.5).sum(axis=1)
            made = [pa.array(severity), pa.array(grade.astype(np.int32)), pa.array(above[:, 0].copy())]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[1:]], ["severity", "grade", "p_toxic", *named.values()])

    flat = documents.select(text_or_empty().alias("__text"), *[F.col(f"`{c}`").alias(named[c]) for c in columns])
    out = flat.mapInArrow(run, f"severity double, grade int, p_toxic double, {tail}")
    return out.select(*[F.col(named[c]).alias(c) for c in columns], "severity", "grade", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))
