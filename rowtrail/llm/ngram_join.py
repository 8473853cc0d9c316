"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rowtrail.llm.common import batch_bytes, mix64, sorted_groups, stored, text_or_empty
from rowtrail.llm.components import connected_components

#: Growth of the size bands, rows and n-grams of a block of the product, columns multiplied at once.  A block
#: pair needs about 40 bytes per pair of rows and 100 per n-gram: 100 MB.
BAND, BLOCK_ROWS, BLOCK_CELLS, CHUNK = 1.4, 1024, 1 << 19, 2048
#: Hashes of words, and groups of documents or documents, that a task remembers.
KNOWN_WORDS, REMEMBERED = 100_000, 1 << 19


class _Hashes(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def ngram_set(text: bytes, width: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams; shorter texts are one n-gram of all words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > KNOWN_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for k in range(min(width, len(words))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(out)


def class_of(cells: np.ndarray) -> bytes:
    return hashlib.blake2b(cells.tobytes(), digest_size=16).digest()


def _bands(threshold: float, largest: int = 1 << 40) -> np.ndarray:
    edges = [1]
    while edges[-1] < largest:
        edges.append(max(int(math.floor(edges[-1] / threshold)) + 1, int(edges[-1] * BAND)))
    return np.array(edges)


def column_keys(cells: np.ndarray, threshold: float, edges: np.ndarray) -> np.ndarray:
    """Keys such that two sets with at least this Jaccard similarity share one.

    Sets of a size band differ in at most k n-grams, k from the sizes; the n-grams are dealt by
    hash into p > k column groups, so p - k of them hold the same n-grams in both sets.  A key
    covers one group's n-grams.  Groups of few n-grams say little and are skipped; a set where
    that could lose a pair adds the n-grams of its prefix as keys.
    """
    n, out = len(cells), []
    band = int(np.searchsorted(edges, n, side="right")) - 1
    bands = [band] if band == 0 or math.ceil(n * threshold) >= edges[band] else [band, band - 1]
    for b in bands:
        # in the lower of two bands the largest partner is n itself or smaller than the next edge / threshold
        top = int(edges[b + 1]) - 1
        pair = top + math.floor(top / threshold)
        k = math.floor((1 - threshold) / (1 + threshold) * pair + 1e-9)
        if k == 0:
            continue  # only equal sets can link
        p = math.ceil((1.25 if threshold >= 0.85 else 1.35) * k) + 2
        least = 3 if threshold >= 0.85 else 2
        group = (mix64(cells) % np.uint64(p)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        at = np.flatnonzero(np.diff(group[order], prepend=-1))
        total = np.add.reduceat(mix64(cells[order] ^ np.uint64(0x51ED)), at)
        count = np.diff(np.append(at, n))
        big = count >= least
        tag = np.uint64(b * 2654435761 + 17)
        out.append(mix64(total[big] + mix64(group[order][at][big].astype(np.uint64) + (tag << np.uint64(20)))))
        if p - big.sum() >= p - k:
            out.append(mix64(cells[:n - math.ceil(threshold * n) + 1] ^ tag))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketch_of(cells: np.ndarray) -> bytes:
    """The set as parities: a bit per column of a hashed row of n to 2 n bits, set if it holds an odd number of n-grams.

    Two sets differ in at least as many n-grams as their sketches differ in bits.  A longer sketch
    folds onto a shorter one (halves are added without carry).
    """
    bits = 1 << max(6, int(max(1, len(cells)) - 1).bit_length())
    counts = np.bincount((mix64(cells) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1 == 1).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of any lengths as rows of words, all of the shortest length."""
    shortest = min(map(len, sketches))
    out = np.zeros((len(sketches), shortest // 8), np.uint64)
    for row, sketch in zip(out, sketches):
        row[:] = np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, shortest // 8), axis=0)
    return out


def may_link(left: list[bytes], left_n: np.ndarray, right: list[bytes], right_n: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets can have the similarity, by their sizes and the bits in which the sketches differ."""
    words = _folded([*left, *right])
    a, b = words[:len(left)], words[len(left):]
    hits = np.zeros((len(a), len(b)), bool)
    for i, row in enumerate(a):
        apart = np.bitwise_count(b ^ row).sum(axis=1, dtype=np.int64)
        both = left_n[i] + right_n
        hits[i] = (apart <= (1 - threshold) / (1 + threshold) * both + 1e-9) & (np.minimum(left_n[i], right_n) >= threshold * np.maximum(left_n[i], right_n) - 1e-9)
    return hits


def document_classes(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, class, node, n, content, sketch): documents with equal n-gram sets have the same class; stored."""
    def run(batches):
        known = _Hashes()
        for batch in batches:
            data, ends = batch_bytes(batch.column(1))
            view = memoryview(data) if len(data) else memoryview(b"")
            sets = [ngram_set(bytes(view[a:b]), width, known) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            classes = [class_of(s) if len(s) else None for s in sets]
            nodes = [int.from_bytes(c[:8], "little", signed=True) if c else None for c in classes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(classes, pa.binary()), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 batch.column(2), pa.array([sketch_of(s) if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "class", "node", "n", "content", "sketch"])

    rows = documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return stored(rows.withColumn("content", F.xxhash64("text")).mapInArrow(run, "doc_id long, class binary, node long, n long, content long, sketch binary"), "classes")


def candidate_groups(documents: DataFrame, width: int, threshold: float) -> DataFrame:
    """(grp, node): the different groups of two or more nodes that share a column key.

    Near copies share nearly all of their keys, and a group is named by its members, so that keys with the same
    members give one group.  A group of more than ``REMEMBERED`` nodes passes through and is named by its key.
    """
    edges = _bands(threshold)

    def keys(batches):
        known = _Hashes()
        for batch in batches:
            data, ends = batch_bytes(batch.column(0))
            view = memoryview(data) if len(data) else memoryview(b"")
            all_keys, all_nodes, seen = [], [], set()
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                cells = ngram_set(bytes(view[a:b]), width, known)
                if not len(cells):
                    continue
                node = int.from_bytes(class_of(cells)[:8], "little", signed=True)
                if node not in seen:
                    seen.add(node)
                    all_keys.append(column_keys(cells, threshold, edges))
                    all_nodes.append(np.full(len(all_keys[-1]), node, np.int64))
            if all_keys:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(all_keys)), pa.array(np.concatenate(all_nodes))], ["key", "node"])

    def groups(batches):
        held_key, held_node, passing, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), None, set()
        for batch in _with_end(batches):
            last = batch is None
            key, node = (held_key, held_node) if last else (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in ((0, held_key), (1, held_node)))
            if not len(key):
                continue
            fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))  # a node repeats if batches hold equal sets
            key, node = key[fresh], node[fresh]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            keep = len(key) if last else int(starts[-1])  # the last run may go on
            if not last and len(key) - keep > REMEMBERED:
                passing = int(key[-1])
                keep = len(key)
            held_key, held_node = key[keep:], node[keep:]
            key, node = key[:keep], node[:keep]
            if not keep:
                continue
            starts = starts[starts < keep]
            sizes = np.diff(np.append(starts, keep))
            names = mix64(np.add.reduceat(mix64(node.view(np.uint64)), starts)).view(np.int64).copy()
            whole = key[starts] == passing if passing is not None else np.zeros(len(starts), bool)
            names[whole] = key[starts][whole]
            wanted = sizes > 1
            for i in np.flatnonzero(wanted & ~whole).tolist():
                name = int(names[i])
                wanted[i] = name not in seen
                seen.add(name)
            wanted |= whole
            if len(seen) > REMEMBERED:
                seen.clear()
            rows = np.repeat(wanted, sizes)
            if rows.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, sizes)[rows]), pa.array(node[rows])], ["grp", "node"])

    rows = documents.select(text_or_empty().alias("text")).mapInArrow(keys, "key long, node long")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(groups, "grp long, node long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def candidate_edges(documents: DataFrame, known: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of the nodes of every group whose sketches allow a link.

    Sharing a key alone joins nothing: a common n-gram is in many sets that have little else in
    common.  All pairs of a group are compared by sketch, block by block; ``known`` has a node's
    size and sketch.
    """
    members = stored(candidate_groups(documents, width, threshold).join(
        known.select("node", "n", "sketch"), "node"), "candidates")
    blocks, pairs = _blocks(members, threshold, BLOCK_ROWS, None)
    rows = _sides(blocks.select("grp", "block", "node", "n", "sketch"), pairs, ["node", "n", "sketch"])

    def compare(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for group in sorted_groups(batches, ["grp", "bi", "bj"]):
            side, node, n = (group.column(c).to_numpy() for c in ("side", "node", "n"))
            sketch = group.column("sketch").to_pylist()
            if len(root) > REMEMBERED:
                root.clear()
            if len(node) < 2 or len({find(x) for x in node.tolist()}) == 1:
                continue  # joined already
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            right = right if len(right) else left
            hits = may_link([sketch[i] for i in left], n[left], [sketch[i] for i in right], n[right], threshold)
            a, b = [], []
            for i, j in forest(hits):
                x, y = int(node[left[i]]), int(node[right[j]])
                if find(x) != find(y):
                    root[find(x)] = find(y)
                    a.append(x), b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _incidence(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of two blocks of n-gram sets, summed over chunks of shared columns."""
    la, ra = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    cells = np.concatenate([*left, *right])
    rows = np.repeat(np.arange(len(left) + len(right)), np.concatenate([la, ra]))
    _, column = np.unique(cells, return_inverse=True)
    here = np.zeros((column.max() + 1, 2), bool)
    side = (rows >= len(left)).astype(int)
    here[column, side] = True
    keep = here.all(axis=1)
    renumber = np.cumsum(keep) - 1
    use = keep[column]
    rows, column = rows[use], renumber[column[use]]
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for start in range(0, int(keep.sum()), CHUNK):
        x, y = np.searchsorted(column, [start, start + CHUNK])
        block = np.zeros((len(left) + len(right), min(CHUNK, int(keep.sum()) - start)), np.float32)
        block[rows[x:y], column[x:y] - start] = 1.0
        total += block[:len(left)] @ block[len(left):].T
    return total


def linked(left: list[np.ndarray], right: list[np.ndarray], hundredths: int) -> np.ndarray:
    """Which pairs have 100 * overlap >= hundredths * union; tiny blocks are intersected directly."""
    la, ra = np.array([len(s) for s in left], np.int64), np.array([len(s) for s in right], np.int64)
    if len(left) * len(right) <= 16:
        overlap = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64)
    else:
        overlap = _incidence(left, right).astype(np.int64)
    return 100 * overlap >= hundredths * (la[:, None] + ra[None, :] - overlap)


def forest(hits: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) of a boolean matrix that connect what it connects: at most rows + columns of them."""
    n, m = hits.shape
    free = np.ones(m, bool)
    todo, out = set(range(n)), []
    while todo:
        stack = [todo.pop()]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(hits[i] & free).tolist():
                free[j] = False
                out.append((i, j))
                more = [x for x in np.flatnonzero(hits[:, j]).tolist() if x in todo]
                for x in more:
                    out.append((x, j))
                    todo.discard(x)
                stack += more
    return out


def ngram_classes(documents: DataFrame, width: int = 3, hundredths: int = 90) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, n_links, component_id``.

    The set of a document has the distinct n-grams of ``width`` words (A-Z lower-cased, parted by
    blanks); with fewer words, the whole sequence as one; without words it is empty and linked
    with nothing.  Documents link when 100 * overlap >= ``hundredths`` * union.  ``n_links`` counts
    the other documents linked directly, ``component_id`` is the smallest doc_id that links reach.

    Equal sets are one row of the incidence matrix.  Rows that agree in a whole group of columns
    (``column_keys``, which loses no pair) are compared by sketch (``may_link``, which loses none either);
    what that leaves connected is multiplied block by block, overlap counts add up over chunks of columns, block pairs whose
    sizes cannot reach the similarity are skipped, and pairs below the bound are dropped inside
    the task: only link counts and a spanning forest leave it, so a group of near copies gives
    rows in proportion to its members.  N-grams are compared by 64-bit hashes.

    Null texts are empty; repeated rows are documents of their own; null ids never become the
    smallest id.  Only ``doc_id`` and ``text`` are read.
    """
    threshold = hundredths / 100
    docs = documents.select("doc_id", "text")
    classes = document_classes(docs, width)
    known = (classes.where("class is not null").groupBy("class").agg(
        F.first("node").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"),
        F.min("doc_id").alias("least"), F.min(F.struct("content", "doc_id")).alias("one")))
    known = stored(known, "known")
    groups = stored(connected_components(candidate_edges(docs, known, width, threshold)), "groups")
    members = known.join(groups, "node").select("class", "node", "n", "copies", F.col("component").alias("grp"),
                                                F.col("one.content").alias("content"), F.col("one.doc_id").alias("one_id"))
    members = stored(members, "members")
    edge_schema = "a binary, b binary, na long, nb long"
    pieces = _block_rows(docs, members, width, threshold)
    links = stored(pieces.mapInArrow(_multiply(hundredths), edge_schema), "links")
    # counts: rows with a null b; forest edges: rows with both
    counts = links.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("na").alias("linked"))
    joined = stored(connected_components(links.where("b is not null")), "joined")
    least = (known.join(joined.withColumnRenamed("node", "class"), "class", "left")
             .withColumn("component", F.coalesce("component", "class")))
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    final = stored(least.join(smallest, "component").join(counts, "class", "left")
                   .select("class", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "final")
    out = classes.join(final, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      F.coalesce("component_id", "doc_id").alias("component_id"))


def _blocks(members: DataFrame, threshold: float, most_rows: int, most_cells: int | None) -> tuple[DataFrame, DataFrame]:
    """The members (grp, node, n, …) with their block, and the pairs of blocks whose sizes allow a link.

    A group is ordered by set size and cut into blocks of about ``most_rows`` rows and ``most_cells`` n-grams; the
    position in a group comes from sums over sizes, not from one sorted group.
    """
    from pyspark.sql import Window

    by_size = members.groupBy("grp", "n").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("grp").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sized = by_size.select("grp", "n", "m", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("rows_before"),
                           F.coalesce(F.sum(F.col("m") * F.col("n")).over(before), F.lit(0)).alias("cells_before"))
    # rows of one size are spread over that size's blocks by hash
    fill, base = F.col("m") / most_rows, F.floor(F.col("rows_before") / most_rows)
    if most_cells:
        fill = F.greatest(fill, F.col("m") * F.col("n") / most_cells)
        base = F.greatest(base, F.floor(F.col("cells_before") / most_cells))
    sized = sized.withColumn("base", base).withColumn("parts", F.greatest(F.lit(1), F.ceil(fill)))
    blocks = (members.join(sized, ["grp", "n"])
              .withColumn("block", (F.col("base") + F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")))
    blocks = stored(blocks.select(*members.columns, "block"), "blocks")
    spans = blocks.groupBy("grp", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    i, j = spans.alias("i"), spans.alias("j")
    pairs = (i.join(j, (F.col("i.grp") == F.col("j.grp")) & (F.col("i.block") <= F.col("j.block")))
             .where((F.col("i.high") >= F.floor(F.col("j.low") * threshold)) & (F.col("j.high") >= F.floor(F.col("i.low") * threshold)))
             .select(F.col("i.grp").alias("grp"), F.col("i.block").alias("bi"), F.col("j.block").alias("bj")))
    return blocks, stored(pairs, "blockpairs")


def _sides(rows: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (grp, bi, bj, side, *columns) of all block pairs, each pair in one task, sorted."""
    left = rows.join(pairs, (rows.grp == pairs.grp) & (rows.block == pairs.bi)).select(pairs.grp, "bi", "bj", F.lit(0).alias("side"), *columns)
    right = rows.join(pairs.where("bi < bj"), (rows.grp == pairs.grp) & (rows.block == pairs.bj)).select(pairs.grp, "bi", "bj", F.lit(1).alias("side"), *columns)
    return left.unionByName(right).repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "side", columns[0])


def _block_rows(docs: DataFrame, members: DataFrame, width: int, threshold: float) -> DataFrame:
    """Rows (grp, bi, bj, side, class, copies, cells) of the block pairs that can hold links, sorted."""
    blocks, pairs = _blocks(members, threshold, BLOCK_ROWS, BLOCK_CELLS)

    def cells(batches):
        known = _Hashes()
        for batch in batches:
            data, ends = batch_bytes(batch.column(0))
            view = memoryview(data) if len(data) else memoryview(b"")
            made = [ngram_set(bytes(view[a:b]), width, known).tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), *batch.columns[1:]], ["cells", *batch.schema.names[1:]])

    # most documents have no partner: their sets are not made; texts are shuffled once, at every size
    texts = docs.select(text_or_empty().alias("text"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_or_empty()).alias("h"))
    wanted = texts.join(blocks.hint("merge"), (F.col("h") == F.col("content")) & F.col("d").eqNullSafe(F.col("one_id")))
    sets = wanted.select("text", "grp", "class", "copies", "block").mapInArrow(
        cells, "cells binary, grp long, class binary, copies long, block int")
    return _sides(stored(sets, "sets"), pairs, ["class", "copies", "cells"])


def _multiply(hundredths: int):
    def run(batches):
        a, b, na = [], [], []
        for rows in sorted_groups(batches, ["grp", "bi", "bj"]):
            side, names, copies, raw = (rows.column(c).to_pylist() for c in ("side", "class", "copies", "cells"))
            held = [{}, {}]
            for s, name, n, cells in zip(side, names, copies, raw):
                held[s][name] = (n, np.frombuffer(cells, np.uint64))
            same = not held[1]
            left = list(held[0])
            right = left if same else list(held[1])
            if not left or not right or same and len(left) == 1:
                continue
            rights = held[0] if same else held[1]
            hits = linked([held[0][c][1] for c in left], [rights[c][1] for c in right], hundredths)
            if same:
                np.fill_diagonal(hits, False)
            for mine, other, table in ((left, hits, [rights[c][0] for c in right]), (right, hits.T, [held[0][c][0] for c in left])):
                counts = other.astype(np.int64) @ np.array(table, np.int64)
                for c, n in zip(mine, counts.tolist()):
                    if n:
                        a.append(c), b.append(None), na.append(n)
                if same:
                    break
            for i, j in forest(hits):
                a.append(left[i]), b.append(right[j]), na.append(0)
            if len(a) > 50_000:
                yield _links(a, b, na)
                a, b, na = [], [], []
        yield _links(a, b, na)

    return run


def _links(a, b, na) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(na, pa.int64()), pa.array([0] * len(a), pa.int64())],
                                      ["a", "b", "na", "nb"])


def drop_near_copies(documents: DataFrame, width: int = 5, hundredths: int = 80) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id; all columns stay.

    Rows that share an id are one document; rows without id stay.
    """
    gone = ngram_classes(documents, width, hundredths).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(stored(gone, "copies").hint("merge"), F.col("doc_id") == F.col("__gone"), "left_anti")
