"""Document fingerprints by content-defined chunking with a normalised gear hash."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rowtrail.llm.common import batch_bytes, mix64, text_or_empty
from rowtrail.scratch import shuffle_width
from rowtrail.sources.ids import ordered_chunks

#: Bytes of a chunk: at least, the size around which chunks gather, at most.  A cut looks at the
#: last 16 bytes, which never reach back beyond the start of the chunk.
LEAST, NORMAL, MOST = 16, 48, 192
#: Bits of the hash that must be zero: before the normal size more (cuts are rarer), after it fewer.
STRICT, LOOSE = np.uint32(0x7F << 25), np.uint32(0x1F << 27)
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: Texts that are chunked together: at most so many rows, and no further row beyond so many bytes.
TOGETHER, TOGETHER_BYTES = 512, 4 << 20

Fingerprint = dict[int, int]  # digest -> bytes of the chunk, in order of first occurrence


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: h = (h << 2) + GEAR[byte], which 16 bytes shift out."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(2 * k)
    return h


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """For each text the ends of its chunks.  All texts are hashed in one pass."""
    data = b"".join(texts)
    h = gear_hashes(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero(h & LOOSE == 0)
    strict = loose[h[loose] & STRICT == 0].tolist()
    loose = loose.tolist()
    out, begin, s, l = [], 0, 0, 0
    n_strict, n_loose = len(strict), len(loose)
    for text in texts:
        end, at, ends = begin + len(text), begin, []
        while at < end:
            s = bisect_left(strict, at + LEAST - 1, s)
            if s < n_strict and strict[s] < at + NORMAL - 1:
                cut = strict[s] + 1
            else:
                l = bisect_left(loose, at + NORMAL - 1, l)
                cut = loose[l] + 1 if l < n_loose and loose[l] < at + MOST - 1 else at + MOST
            at = min(cut, end)
            ends.append(at - begin)
        out.append(ends)
        begin = end
    return out


def fingerprints(texts: list[bytes]) -> list[Fingerprint]:
    """The distinct chunks of each text by digest, with their lengths."""
    made = []
    for text, ends in zip(texts, chunk_ends(texts)):
        own, at = {}, 0
        for end in ends:
            own[xxhash.xxh3_64_intdigest(text[at:end])] = end - at
            at = end
        made.append(own)
    return made


def shown(fingerprint: Fingerprint) -> str:
    return ",".join([f"{d:016x}:{n}" for d, n in fingerprint.items()])


def containment(a: Fingerprint, b: Fingerprint) -> float:
    """The share of ``a``, by bytes, that stands in ``b``; an empty text is contained in an empty one only."""
    if not a:
        return float(not b)
    return sum([n for d, n in a.items() if d in b]) / sum(a.values())


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) gives way to as much of the beginning of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


LOWEST = -(1 << 63)


def with_neighbours(documents: DataFrame) -> DataFrame:
    """The documents dealt to runs of the order by descending id: (part, guest, doc_id, text), sorted.

    The first documents of a run also go to the run before it, as guests, and those of the first
    run to the last: so each document's follower is the next row.  The order comes from the ids
    alone; texts are shuffled once.
    """
    ids = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"))
    runs = ordered_chunks(ids, ["id"]).groupBy("__chunk").agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("__chunk").collect()  # one row per range partition
    lows = np.array([r["low"] for r in runs], np.int64)
    highs = np.array([r["high"] for r in runs], np.int64)
    host = np.roll(np.arange(len(runs)), -1)  # the run above; the lowest run is followed by the highest one's first

    def place(ids: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(lows, ids.to_numpy(), "right") - 1).astype(np.int32))

    def hosted(ids: pd.Series) -> pd.Series:
        values = ids.to_numpy()
        at = np.searchsorted(highs, values)
        first = (at < len(highs)) & (highs[np.minimum(at, len(highs) - 1)] == values)
        return pd.Series(np.where(first, host[np.minimum(at, len(highs) - 1)], -1).astype(np.int32))

    id_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
                            F.pandas_udf(place, "int")(id_key).alias("part"), F.pandas_udf(hosted, "int")(id_key).alias("host"))
    here, there = F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))
    dealt = rows.select(F.explode(F.when(F.col("host") >= 0, F.array(here, there)).otherwise(F.array(here))).alias("to"), "doc_id", "text")
    return (dealt.select("to.part", "to.guest", "doc_id", "text").repartition(max(1, shuffle_width(documents.sparkSession)), "part")
            .sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text"))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, ends = batch_bytes(batch.column(3))
    whole = data.tobytes()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield whole[a:b]


def _together(texts: Iterator[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of bounded size, with the number of their first one."""
    start, some, size = 0, [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if len(some) == TOGETHER or size >= TOGETHER_BYTES:
            yield start, some
            start, some, size = start + len(some), [], 0
    if some:
        yield start, some


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # the row that waits for its follower: (part, doc_id, bytes, text, fingerprint)
    for batch in batches:
        parts, guests, ids = (batch.column(k).to_pylist() for k in range(3))
        for start, some in _together(_texts(batch)):
            pairs = []
            for i, (raw, own) in enumerate(zip(some, fingerprints(some)), start):
                text = raw.decode("utf-8", "surrogateescape")
                if held is not None and held[0] == parts[i]:
                    pairs.append((held[1:], (text, own)))
                held = None if guests[i] else (parts[i], ids[i], text, own)
            made = [edited(a[1], b[0]).encode("utf-8", "surrogateescape") for a, b in pairs]
            out = []
            for (doc_id, text, own), (_, following), change, changed in zip(
                    [p[0] for p in pairs], [p[1] for p in pairs], made, fingerprints(made)):
                out.append((doc_id, len(text), hashlib.sha256(change).hexdigest(), shown(own), shown(changed),
                            containment(own, changed), containment(own, following)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how much of it either shares.

    Texts are cut where a gear hash over 16 bytes has enough zero bits, more of them before the normal
    chunk size than after it, so chunk sizes gather around that size and boundaries move with the
    text.  A fingerprint is the set of chunk digests with their lengths in bytes, in order of first
    occurrence (``digest:bytes,...``); ``near_*`` is the share of the document's chunks, by bytes,
    that the other text has.  The edited text has its last half replaced by the beginning of the
    next document, by descending id (the first follows the last).

    Null texts are empty; an empty text has an empty fingerprint, contained in empty ones only.  Rows
    without id come last; rows of equal id stand by text hash, and each is a document; a single
    document follows itself.  At most 512 texts, or 4 MB and one text, are chunked together.  Only
    ``doc_id`` and ``text`` are read.
    """
    return with_neighbours(documents).mapInArrow(_fingerprinted, SCHEMA)
