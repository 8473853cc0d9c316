"""Merkle manifest, chunk fingerprints and ranked search against plain Python versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rowtrail.llm import fingerprints, merkle, queries, search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, path string, rank string, n long"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars); the other columns clash with names the operators use."""
    return spark.createDataFrame([(*r, "x", "y", "z", 7) for r in rows], DOCS)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root of a list of digests, and for each its siblings (left, right) level by level."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, groups = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a:a + 3]
            for k, who in enumerate(owners[a:a + 3]):
                for i in who:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(H(*run))
            groups.append([i for who in owners[a:a + 3] for i in who])
        nodes, owners = up, groups
    return nodes[0], paths


def brute_manifest(rows):
    def leaf(i, text, lang, source, n, probe=False):
        if probe and text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0:
            text = text.replace("\n", "")
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held, subs = [], []
    for s in sources:
        own = sorted([(r[0] is not None, r[0] or 0, leaf(*r), leaf(*r, probe=True)) for r in rows if r[3] == s])
        subroot, paths = tree([o[2] for o in own])
        subs.append(subroot)
        held.append((own, paths))
    root, over = tree(subs) if subs else (None, [])
    out = []
    for (own, paths), subroot, up in zip(held, subs, over):
        for (known, i, h, probe), path in zip(own, paths):
            path, fold = path + up, probe
            for left, right in path:
                fold = H(left, fold, right)
            out.append((str(i) if known else "None", h, subroot, root, H(*[a + b for a, b in path]), fold, fold == root))
    return sorted(out)


def manifest_rows():
    rows = [(i * 37 - 900, f"line {i}\nnext é𝄞", "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, i if i % 7 else None) for i in range(150)]
    rows += [(2 ** 62, "far", "en", "wide", 1), (-2 ** 63, "far", "en", "wide", 1), (63, "a", "en", "wide", 1), (64, "b", "en", "wide", 1), (127, "c", "en", "wide", 1)]
    rows += [(None, None, None, None, None), (None, "no id", "en", "s1", 2), (None, "no id", "en", "s1", 2), (None, "other", "en", "s1", 2)]
    rows += [(7, t, "en", "twice", 3) for t in ("one\n", "one\n", "two", "one\n", None, "")]
    rows += [(8, "é\n" * 60_000, "de", "é", 5), (9, "x", "de", "", 5), (10, "x", "de", "s" + "\x00", 5)]
    return rows


@pytest.mark.parametrize("rows", [manifest_rows(), manifest_rows()[:1], [(i, "t\n", "en", f"src{i}", 1) for i in range(40)], [(i, "t\n", "en", "s", 1) for i in range(30)], []],
                         ids=["mixed", "one", "sources", "one source", "none"])
def test_manifest(spark, rows):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.dataset_manifest(docs(spark, rows), tampered).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == brute_manifest(rows)


def test_manifest_verifies_itself(spark):
    got = merkle.dataset_manifest(docs(spark, manifest_rows()).repartition(5)).collect()
    assert all(r.verified for r in got) and len({r.root for r in got}) == 1


def test_ranks_do_not_gather_a_group(spark):
    """Coordinates come from windows over pages of counts: nothing is partitioned by the source alone but the last page."""
    leaves = spark.range(300_000).select(F.lit("s").alias("grp"), (F.col("id") * 3).alias("doc_id"), F.shiftright(F.col("id") * 3, 6).alias("word"),
                                         F.lit("l").alias("leaf"), F.lit("l").alias("probe"))
    got = merkle._ranked(leaves)
    assert got.where("pos <> doc_id div 3 or total <> 300000").isEmpty() and got.count() == 300_000


def brute_chunks(text):
    """Chunk ends of one text, byte by byte, with the hash reset at every cut."""
    ends, at, h = [], 0, 0
    for i, b in enumerate(text):
        h = ((h << 2) + int(fingerprints.GEAR[b])) & 0xFFFFFFFF
        size = i + 1 - at
        mask = int(fingerprints.STRICT) if size < fingerprints.NORMAL else int(fingerprints.LOOSE)
        if size >= fingerprints.LEAST and h & mask == 0 or size == fingerprints.MOST:
            ends.append(i + 1)
            at, h = i + 1, 0
    return ends if at == len(text) else [*ends, len(text)]


def fingerprint(text):
    out, at = {}, 0
    for end in brute_chunks(text):
        out[xxhash.xxh3_64_hexdigest(text[at:end])] = end - at
        at = end
    return out


def likeness(a, b):
    return sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b)


def words(seed, n, vocabulary=400):
    draw = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in draw.integers(0, vocabulary, n))


def test_fingerprints(spark):
    rows = [(i * 5 % 61 - 20, words(i, 1 + i * 7), "en", "a", 1) for i in range(61)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, "é𝄞" * 40, "en", "a", 1), (103, words(1, 30_000), "en", "a", 1),
             (104, words(1, 30_000), "en", "a", 1), (104, "tie", "en", "a", 1), (None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1)]
    got = fingerprints.fingerprint_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    shown = lambda f: ",".join(f"{d}:{n}" for d, n in f.items())
    # rows of one id stand in any order, so their followers are tried in both
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    order = sorted([i for i in texts if i is not None], reverse=True) + [None]
    for r in got:
        at = order.index(r.doc_id)
        followers = texts[order[(at + 1) % len(order)]] + (texts[r.doc_id] if len(texts[r.doc_id]) > 1 else [])
        options = set()
        for t in texts[r.doc_id]:
            for nxt in followers:
                half = len(t) // 2
                made = (t[:len(t) - half] + nxt[:half]).encode()
                a, b = fingerprint(t.encode()), fingerprint(made)
                options.add((len(t), hashlib.sha256(made).hexdigest(), shown(a), shown(b), likeness(a, b), likeness(a, fingerprint(nxt.encode()))))
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) in options
    by = {r.doc_id: r for r in got}
    assert by[103].fingerprint in [r.fingerprint for r in got if r.doc_id == 104] and 0.4 < by[103].near_edited < 0.6
    one = fingerprints.fingerprint_documents(docs(spark, rows[:1])).first()
    assert one.near_next == 1.0 and fingerprints.fingerprint_documents(docs(spark, [])).count() == 0


def test_chunks_resist_shifts():
    text = words(3, 4000).encode()
    a, b = fingerprint(text), fingerprint(b"some words before " + text)
    assert fingerprints.fingerprints([text, b"", text])[2] == {int(d, 16): n for d, n in a.items()}
    assert likeness(a, b) > 0.97
    sizes = np.array(list(a.values()))
    assert fingerprints.LEAST <= sizes[:-1].min() and sizes.max() <= fingerprints.MOST and 45 < sizes.mean() < 100
    assert fingerprints.fingerprints([b"", b"abc"]) == [{}, {xxhash.xxh3_64_intdigest(b"abc"): 3}]


def test_runs_hold_neighbours(spark):
    """Every run ends with the first document of the next one as its guest."""
    rows = [(i, f"t{i}", "en", "a", 1) for i in range(300)] + [(None, "none", "en", "a", 1)]
    got = fingerprints.with_neighbours(docs(spark, rows)).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.part, []).append((r.guest, -1 if r.doc_id is None else r.doc_id))
    assert len(parts) > 3 and sum(not g for own in parts.values() for g, _ in own) == 301
    for own in parts.values():
        ids = [i for g, i in sorted(own, key=lambda x: (x[0], -x[1]))]
        assert sum(g for g, _ in own) == 1 and all(b == a - 1 or (a, b) == (-1, 299) for a, b in zip(ids, ids[1:]))


def brute_search(rows, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t, *_ in rows]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    wanted = {}
    for item, text, *_ in items:
        wanted.setdefault(item, set()).update(terms(text))
    for item, own in wanted.items():
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top])]
    return sorted(map(str, out))


def search_rows():
    rows = [(i, words(i, 5 + i % 90, 60) + (" Émile" if i % 9 == 0 else ""), "en", "a", 1) for i in range(700)]
    rows += [(i + 1000, rows[5][1], "en", "a", 1) for i in range(60)]  # equal scores
    rows += [(2000, None, None, None, None), (2001, "", "en", "a", 1), (2002, " .,", "en", "a", 1), (2003, "W1-w2_w3 " * 30_000, "en", "a", 1),
             (None, rows[5][1], "en", "a", 1), (3, rows[3][1], "en", "a", 1)]
    items = [(1, rows[5][1], 1), (2, "w1 w2 w3, W4", 1), (3, None, 1), (4, "", 1), (5, "nowhere", 1), (6, "Émile! émile", 1), (2, "w9", 1), (7, words(900, 3000, 60), 1), (None, "w7", 1)]
    return rows, items


@pytest.mark.parametrize("top, block_bytes", [(50, 1 << 20), (3, 40), (5000, 1 << 20)])
def test_search(spark, top, block_bytes):
    rows, items = search_rows()
    frame = spark.createDataFrame(items, "item_id long, text string, score int")
    got = search.search(docs(spark, rows).repartition(6), frame, top, block_bytes).collect()
    assert sorted(str((r.item_id, r.rank, r.doc_id, r.score)) for r in got) == brute_search(rows, items, top)


def test_search_empty(spark):
    rows, items = search_rows()
    frame = spark.createDataFrame(items, "item_id long, text string, score int")
    assert search.search(docs(spark, []), frame).count() == 0 and search.search(docs(spark, rows), frame.limit(0)).count() == 0
    assert search.search(docs(spark, [(1, None, None, None, None)]), frame).count() == 0


def test_bounds_prune_and_lose_nothing():
    """With a floor known, most vectors are never scored; those at or above it all are."""
    draw = np.random.default_rng(1)
    n_docs, n_terms = 512, 300
    rows = np.repeat(np.arange(n_docs), 20)
    cols = np.concatenate([np.sort(draw.choice(n_terms, 20, replace=False)) for _ in range(n_docs)])
    impacts = draw.integers(1, 10 ** 6, len(cols))
    q = search.Queries([0, 1], {str(k).encode(): k for k in range(n_terms)}, np.concatenate([np.sort(draw.choice(n_terms, 12, replace=False)) for _ in range(2)]), np.array([0, 12, 24]))
    q.weights = draw.integers(0, 9000, 24)
    dense = np.zeros((n_docs, n_terms), np.int64)
    dense[rows, cols] = impacts
    exact = np.stack([dense[:, q.columns[a:a + 12]] @ q.weights[a:a + 12] for a in (0, 12)])
    floors = np.sort(exact, axis=1)[:, -5]
    best = search._Best(2, 5, floors)
    longest = float(np.sqrt((dense.astype(float) ** 2).sum(axis=1)).max())
    scored = search.search_bucket(q, best, list(range(n_docs)), rows, cols, impacts, longest)
    assert [[(-s, i) for s, _, i in own] for own in best.rows] == [
        sorted(((int(exact[k, i]), i) for i in np.flatnonzero(exact[k] >= floors[k])), key=lambda x: (-x[0], x[1]))[:5] for k in (0, 1)]
    assert scored < 200
    assert search.search_bucket(q, search._Best(2, 5, np.array([10 ** 12, 10 ** 12])), list(range(n_docs)), rows, cols, impacts, longest) == 0


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_lexical_search"])
def test_sql_exists(name):
    assert name in queries.ORACLES
