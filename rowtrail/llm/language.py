"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowtrail.llm.common import batch_bytes, text_or_empty

WINDOW = 256
WIDTHS = (2, 3, 4)
#: Letters in lower case and bytes of other scripts count as they are, all else as a blank.
_MAP = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
UNKNOWN = "und"


def windows(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows over all bytes of all rows: bytes, row of each window, letters in it."""
    sizes = np.diff(ends)
    each = (sizes + WINDOW - 1) // WINDOW
    row = np.repeat(np.arange(len(sizes)), each)
    first = np.repeat(ends[:-1], each) + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each))
    clean = np.append(_MAP[data], np.full(WINDOW, 32, np.uint8))
    block = clean[first[:, None] + np.arange(WINDOW)]
    left = ends[row + 1] - first if len(row) else first
    block[np.arange(WINDOW) >= left[:, None]] = 32
    return block, row, (block != 32).sum(axis=1)


class ByteCNN:
    """Filters of several widths over bytes, maximum over the window, softmax over the languages."""

    def __init__(self, languages: list[str], tables: dict[int, np.ndarray], bias: np.ndarray, out: np.ndarray, out_bias: np.ndarray):
        self.languages, self.tables, self.bias, self.out, self.out_bias = languages, tables, bias, out, out_bias

    @classmethod
    def fit(cls, block: np.ndarray, label: np.ndarray, languages: list[str], filters: int = 12, epochs: int = 6, batch: int = 64,
            rate: float = 0.01, seed: int = 3) -> "ByteCNN":
        """Adam on cross entropy; a filter's gradient goes to the bytes at its maximum."""
        draw = np.random.default_rng(seed)
        value = {w: (draw.standard_normal((w, 256, filters)) * 0.3).astype(np.float32) for w in WIDTHS}
        value["bias"] = np.zeros(filters * len(WIDTHS), np.float32)
        value["out"] = (draw.standard_normal((filters * len(WIDTHS), len(languages))) * 0.1).astype(np.float32)
        value["out_bias"] = np.zeros(len(languages), np.float32)
        first, second, step = {k: np.zeros_like(v) for k, v in value.items()}, {k: np.zeros_like(v) for k, v in value.items()}, 0
        for _ in range(epochs):
            for at in np.array_split(draw.permutation(len(block)), max(1, len(block) // batch)):
                x, y = block[at], label[at]
                tops, places = [], []
                for w in WIDTHS:
                    z = value[w][0][x[:, :WINDOW - w + 1]]
                    for k in range(1, w):
                        z = z + value[w][k][x[:, k:WINDOW - w + 1 + k]]
                    places.append(z.argmax(axis=1))
                    tops.append(np.take_along_axis(z, places[-1][:, None], axis=1)[:, 0])
                pooled = np.concatenate(tops, axis=1) + value["bias"]
                active = np.maximum(pooled, 0)
                logits = active @ value["out"] + value["out_bias"]
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(at)), y] -= 1
                p /= len(at)
                grad = {"out": active.T @ p, "out_bias": p.sum(axis=0)}
                back = (p @ value["out"].T) * (pooled > 0)
                grad["bias"] = back.sum(axis=0)
                for n, w in enumerate(WIDTHS):
                    g = np.zeros_like(value[w])
                    own = back[:, n * filters:(n + 1) * filters]
                    for k in range(w):
                        np.add.at(g[k], (np.take_along_axis(x, places[n] + k, axis=1), np.arange(filters)[None, :]), own)
                    grad[w] = g
                step += 1
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    value[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        return cls(languages, {w: value[w] for w in WIDTHS}, value["bias"], value["out"], value["out_bias"])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filters as tables over pairs of bytes, so that a position takes few lookups."""
        def both(a, b):
            return (a[:, None, :] + b[None, :, :]).reshape(65536, -1)

        two, three, four = (self.tables[w] for w in WIDTHS)
        return np.concatenate([both(*two), both(*three[:2]), both(*four[:2])], axis=1), three[2], both(*four[2:])

    def log_scores(self, block: np.ndarray, tables, rows: int = 512) -> np.ndarray:
        """Log probabilities of the languages for each window."""
        lead, third, last = tables
        f = third.shape[1]
        out = []
        for start in range(0, len(block), rows):
            x = block[start:start + rows]
            pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            z = lead.take(pair, axis=0)
            z[:, :-1, f:2 * f] += third.take(x[:, 2:], axis=0)
            z[:, :-2, 2 * f:] += last.take(pair[:, 2:], axis=0)
            pooled = np.concatenate([z[:, :, :f].max(axis=1), z[:, :-1, f:2 * f].max(axis=1), z[:, :-2, 2 * f:].max(axis=1)], axis=1)
            logits = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))


def fold(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(0))


def fit_language(documents: DataFrame, rows_per_language: int = 600, windows_per_row: int = 3, seed: int = 13) -> ByteCNN | None:
    """Fit on up to about ``rows_per_language`` documents of each language, three windows of each.

    The documents are picked by a hash of the id, among those with an id, a language and a text; of
    rows that repeat an id one window is kept for each place, so the sample stays within its bound.
    Only text and language are used.  None if no language is known.
    """
    known = documents.where("doc_id is not null and lang is not null and text is not null and length(text) > 0")
    sizes = dict(tuple(r) for r in known.groupBy("lang").count().collect())
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, rows_per_language / n)).otherwise(share)

    def run(batches):
        for batch in batches:
            data, ends = batch_bytes(batch.column(2))
            block, row, letters = windows(data, ends)
            size = np.bincount(row, minlength=len(ends) - 1)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            step = np.maximum(1, size[row] // windows_per_row)
            keep = np.flatnonzero((place % step == 0) & (place // step < windows_per_row) & (letters > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[keep])), pa.array(place[keep]), batch.column(1).take(pa.array(row[keep])),
                                              pa.array([b.tobytes() for b in block[keep]], pa.binary())], ["doc_id", "place", "lang", "bytes"])

    rows = (known.where(draw < share).select(F.col("doc_id").cast("long"), "lang", "text")
            .mapInArrow(run, "doc_id long, place long, lang string, bytes binary")
            .groupBy("doc_id", "place").agg(F.min(F.struct("lang", "bytes")).alias("w"))
            .select("doc_id", "place", "w.lang", "w.bytes").collect())
    rows.sort(key=lambda r: (r[0], r[1]))
    languages = sorted({r[2] for r in rows})
    if not languages:
        return None
    index = {x: i for i, x in enumerate(languages)}
    block = np.frombuffer(b"".join(bytes(r[3]) for r in rows), np.uint8).reshape(-1, WINDOW)
    return ByteCNN.fit(block, np.array([index[r[2]] for r in rows]), languages)


def predict_language(documents: DataFrame, model: ByteCNN | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every whole text: the mean log probability over all windows, by letters.

    ``und`` with score 0 if the text is null or has no letter, or if there is no model.  Rows are
    judged one by one from their text alone.
    """
    def run(batches):
        tables = model.pairs() if model is not None else None
        for batch in batches:
            data, ends = batch_bytes(batch.column(1))
            n = batch.num_rows
            lettered = np.asarray(batch.column(2).fill_null(False))
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if model is not None:
                total, weight = np.zeros((n, len(model.languages))), np.zeros(n)
                lo = 0
                while lo < n:  # rows whose texts have a few MB together
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (4 << 20), side="right")) - 1)
                    block, row, letters = windows(data[ends[lo]:ends[hi]], ends[lo:hi + 1] - ends[lo])
                    logs = model.log_scores(block, tables) * letters[:, None]
                    np.add.at(total, row + lo, logs)
                    np.add.at(weight, row + lo, letters)
                    lo = hi
                ok = lettered & (weight > 0)
                mean = total[ok] / weight[ok][:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True)) if len(mean) else mean
                p = p / p.sum(axis=1, keepdims=True)
                if len(p):
                    names[ok] = np.array(model.languages, object)[p.argmax(axis=1)]
                    score[ok] = p.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("lettered", F.col("text").rlike("\\p{L}"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
