import itertools
import random

import numpy as np
import pytest

from quern.llm.simhash import Tree, fingerprints, groups, near_duplicates, near_forest, simhash_dedup

SCHEMA = "doc_id long, text string, root string, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "f") for i, t in rows], SCHEMA)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    rows, truth = [], []
    for _ in range(n):
        body = [r.choice(vocab) for _ in range(r.randrange(80, 200))]
        ids = []
        for c in range(r.choice([1, 1, 2, 4])):
            copy = [r.choice(vocab) if c and r.random() < 0.04 else w for w in body]
            ids.append(len(rows))
            rows.append((len(rows), " ".join(copy)))
        truth.append(ids)
    return rows, truth


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_tree_bounds_lose_no_pair(radius):
    rng = np.random.default_rng(radius)
    v = rng.integers(0, 1 << 16, 300).astype(np.uint16)
    v[::7] ^= np.uint16(4)
    tree = Tree(v, 1.0, 20, 1)
    at, leaf, own = tree.visits(v, radius)
    assert (np.bincount(at[own], minlength=300) == 1).all() and tree.leaves > 5
    home = np.zeros(300, int)
    home[at[own]] = leaf[own]
    there = set(zip(at.tolist(), leaf.tolist(), strict=True))
    for i, j in itertools.combinations(range(300), 2):
        if np.bitwise_count(v[i] ^ v[j]) <= radius:
            assert (i, home[j]) in there or (j, home[i]) in there


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (5, 4)).astype(np.uint64)
    x = np.repeat(base, 30, axis=0) ^ (np.uint64(1) << rng.integers(0, 63, (150, 4)).astype(np.uint64))
    kept = near_forest(x[:100].view(np.uint16), x[100:].view(np.uint16), 8, rows=16, columns=32)
    assert len(kept) <= 149
    label = list(range(150))
    for i, j in kept:
        assert np.bitwise_count(x[i] ^ x[j]).sum() <= 8
        a, b = label[i], label[j]
        label = [a if v == b else v for v in label]
    assert all(len({label[i] for i in range(g * 30, min(g * 30 + 30, 100))}) == 1 for g in range(3))


def test_recall_against_brute_force(spark):
    rows, truth = corpus(1)
    got = {x["doc"]: x for x in groups(frame(spark, rows), leaf=32).collect()}
    fp = {i: np.frombuffer(bytes(x["fp"]), np.uint64) for i, x in got.items()}
    near = [(a, b) for a, b in itertools.combinations(sorted(fp), 2) if np.bitwise_count(fp[a] ^ fp[b]).sum() <= 40]
    found = [(a, b) for a, b in near if bytes(got[a]["root"]) == bytes(got[b]["root"])]
    assert near and len(found) >= 0.9 * len(near)
    want = {(i, t[0]) for t in truth for i in t[1:]}
    pairs = {(x["doc_id"], x["kept_doc_id"]) for x in near_duplicates(frame(spark, rows), leaf=32).collect()}
    assert len(pairs & want) >= 0.95 * len(want) and not pairs - want


@pytest.mark.parametrize("parts", [1, 3])
def test_every_pair_near_the_radius_is_found(spark, parts):
    """Groups of two at all distances up to the radius, which no third document connects."""
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20_000)]
    rows = []
    for i in range(400):
        body = [r.choice(vocab) for _ in range(150)]
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(r.choice(vocab) if r.random() < 0.02 + 0.1 * i / 400 else w for w in body))]
    got = {x["doc"]: x for x in groups(frame(spark, rows), leaf=64, parts=parts).collect()}
    fp = np.stack([np.frombuffer(bytes(got[i]["fp"]), np.uint64) for i in range(800)])
    far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    near = {(i, j) for i, j in zip(*np.nonzero(far <= 40), strict=True) if i < j}
    assert sum(far[i, j] > 32 for i, j in near) > 30
    assert near == {(i, j) for i, j in itertools.combinations(range(800), 2) if got[i]["root"] == got[j]["root"]}


@pytest.mark.parametrize("radius", [0, 8, 40, 70])
def test_index_against_brute_force(radius):
    rng = np.random.default_rng(radius)
    x = rng.integers(0, 1 << 64, (120, 4), np.uint64)
    bits = np.zeros((120, 256), np.uint8)
    for k in range(120):  # spread evenly or at random, just within the radius or just beyond it
        at = np.arange(radius + k % 2) * 256 // (radius + 1) if k % 4 < 2 else rng.choice(256, radius + k % 2, replace=False)
        bits[k, at] = 1
    y = x ^ np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    for own, visiting in ((np.concatenate([x, y]), x[:0]), (x, y)):
        pairs = near_forest(own.view(np.uint16), visiting.view(np.uint16), radius, rows=16, columns=8)
        assert {tuple(sorted(p)) for p in pairs} == {(k, k + 120) for k in range(0, 120, 2)}


def test_edges(spark):
    a = "one two three four five six seven eight nine ten"
    rows = [(5, a), (2, a.upper() + "!"), (9, a), (None, a), (3, None), (4, ""), (6, "..."), (7, ""), (8, "Short one."), (10, "short ONE"), (11, "one short"), (2, a.upper() + "!"), (12, " ".join(f"u{i % 5000}" for i in range(200_000)))]
    pairs = {(x["doc_id"], x["kept_doc_id"]) for x in near_duplicates(frame(spark, rows)).collect()}
    assert pairs == {(5, 2), (9, 2), (None, 2), (10, 8)}
    rows += [(3, None), (6, "..."), (6, "..."), (None, "")]
    for params in ({}, {"filter_bits": 64}):  # a filter that is full lets all rows by
        out = simhash_dedup(frame(spark, rows), **params)
        assert out.columns == ["doc_id", "text", "root", "fp"]
        assert sorted((x["doc_id"] or 0) for x in out.collect()) == [0, 2, 3, 3, 4, 6, 6, 6, 7, 8, 11, 12]
    assert near_duplicates(frame(spark, [])).count() == 0 and simhash_dedup(frame(spark, [])).count() == 0


def test_fingerprints_ignore_block_borders():
    import pyarrow as pa

    texts = ["alpha beta gamma delta epsilon zeta eta theta iota", "x " * 50, " ".join(map(str, range(300_000)))]
    whole, has = fingerprints(pa.array(texts))
    assert has.all()
    for i, t in enumerate(texts):
        assert (fingerprints(pa.array([t]))[0][0] == whole[i]).all()


def test_query_against_all_pairs(spark):
    """The query over its whole table: what goes, and for which document, by components over all pairs of fingerprints."""
    from pathlib import Path

    import pyarrow as pa

    from compare import SF_DIR, connection
    from quern.llm.queries import QUERIES

    if not Path(SF_DIR).exists():
        pytest.skip("no test tables here")
    rows = connection().execute("SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL ORDER BY doc_id, text").fetchall()
    fp, has = fingerprints(pa.array([t.lower() for _, t in rows]))
    words = fp.view(np.uint64)
    group = np.arange(len(rows))
    for i in np.flatnonzero(has).tolist():
        near = np.flatnonzero(has & (np.bitwise_count(words ^ words[i]).sum(axis=1) <= 40))
        joined = np.isin(group, group[near])
        group[joined] = group[joined].min()
    want = {(rows[i][0], rows[g][0]) for i, g in enumerate(group.tolist()) if i != g}
    got = [(r["doc_id"], r["kept_doc_id"]) for r in QUERIES["op10_simhash_near_dedup"](spark, SF_DIR).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
