import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import substring
from quern.llm.substring import SuffixAutomaton, _buckets, repeated_spans, substring_dedup

SCHEMA = "doc_id long, text string, lang string, key string, spans string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "k", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def brute(rows, n):
    """A word goes if it lies in an n-word run that an earlier position holds too; rows: distinct (id, text) in order."""
    docs = [(i, t.split() if t else []) for i, t in rows]
    seen, gone = set(), {}
    for k, (_, w) in enumerate(docs):
        for p in range(len(w) - n + 1):
            run = tuple(w[p : p + n])
            if run in seen:
                gone.setdefault(k, set()).update(range(p, p + n))
            seen.add(run)
    return [[x for p, x in enumerate(w) if p not in gone.get(k, ())] for k, (_, w) in enumerate(docs)]


def test_automaton_against_brute_force():
    r = random.Random(3)
    for _ in range(60):
        a = SuffixAutomaton()
        added = [[r.randrange(3) for _ in range(r.randrange(12))] for _ in range(4)]
        for s in added:
            a.add(s)
        subs = {tuple(s[i:j]) for s in added for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        q = [r.randrange(4) for _ in range(15)]
        want = [max([k for k in range(1, e + 1) if tuple(q[e - k : e]) in subs], default=0) for e in range(1, len(q) + 1)]
        assert a.statistics(q) == want


def test_minimizers_of_a_very_long_text():
    """Windows of a passage have the same minimizers at the start and beyond 2 ** 24 words."""
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 64, (1 << 24) + 2000, np.uint64)
    far = (1 << 24) + 700
    h[far : far + 200] = h[:200]
    m, a, b = _buckets(h, np.zeros(h.size, np.int64), 50, 8)
    n = b - a + 1 - 49  # windows
    assert int(n.sum()) == h.size - 49 and a[0] == 0 and (a[1:] == a[:-1] + n[:-1]).all()
    each = np.repeat(m, n)
    assert (each[:151] == each[far : far + 151]).all()


@pytest.mark.parametrize("places", [1, 7, 64])
def test_ranges_change_no_minimizer(monkeypatch, places):
    rng = np.random.default_rng(places)
    h, doc = rng.integers(0, 1 << 64, 500, np.uint64), np.repeat([0, 1, 2], [300, 20, 180])

    def windows():
        m, a, b = _buckets(h, doc, 30, 5)
        return [(p, x) for x, s, e in zip(m.tolist(), a.tolist(), b.tolist(), strict=True) for p in range(s, e - 28)]

    want = windows()
    monkeypatch.setattr(substring, "PLACES", places)
    assert windows() == want


def test_many_contents_in_a_bucket():
    r = random.Random(5)
    core = [r.randrange(1 << 32) for _ in range(20)]
    pack = lambda xs: b"".join(x.to_bytes(4, "little") for x in xs)
    segs = [pack([r.randrange(1 << 32) for _ in range(10)] + core + [r.randrange(1 << 32) for _ in range(10)]) for _ in range(50)] + [pack([r.randrange(1 << 32) for _ in range(30)])]
    assert repeated_spans(segs, 20) == [[]] + [[(10, 30)]] * 49 + [[]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)]
    passage = [" ".join(r.choice(vocab) for _ in range(14)) for _ in range(3)]
    rows = []
    for i in range(60):
        body = [r.choice(vocab) for _ in range(r.randrange(25))]
        if i % 3 == 0:
            body.insert(r.randrange(len(body) + 1), r.choice(passage))
        if i % 10 == 0:
            body += ["la"] * 30  # a run that repeats itself
        rows.append((i, " ".join(body)))
    rows.append((99, rows[5][1]))
    got = {x["doc_id"]: x["text"] for x in substring_dedup(frame(spark, rows), min_words=8, gram=3).collect()}
    for (i, _), want in zip(rows, brute(rows, 8), strict=True):
        assert got[i].split() == want


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    part = " ".join(f"x{i}" for i in range(100, 160))
    rows = [(1, long), (2, f"head {part}\n\ntail"), (3, None), (4, ""), (5, " \n "), (None, part), (6, "Ünïcode " + part), (7, "same text"), (7, "same text"), (1, long)]
    out = substring_dedup(frame(spark, rows))
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    got = sorted(((x["doc_id"], x["text"], x["n_chars"]) for x in out.collect()), key=str)
    assert got == sorted([(1, long, len(long)), (2, "head tail", 9), (3, None, None), (4, "", 0), (5, " \n ", 3), (None, "", 0), (6, "Ünïcode ", 8), (7, "same text", 9), (7, "same text", 9), (1, long, len(long))], key=str)
    assert substring_dedup(frame(spark, [])).count() == 0
    again = substring_dedup(frame(spark, rows), min_words=50)
    assert again.count() == len(rows)


@pytest.mark.parametrize("params", [{"hot": 0}, {"hot": 2}, {"filter_bits": 1 << 6}])
def test_hot_buckets_and_full_filters_change_nothing(spark, params):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(9)]
    passage = " ".join(r.choice(vocab) for _ in range(20))
    rows = [(i, " ".join([*(r.choice(vocab) for _ in range(r.randrange(12))), passage, *(r.choice(vocab) for _ in range(r.randrange(12)))])) for i in range(40)]
    rows += [(None, rows[3][1]), (50, "la " * 30), (51, "la " * 9), (3, rows[3][1])]
    got = {(x["doc_id"], x["text"]) for x in substring_dedup(frame(spark, rows), min_words=8, gram=3, **params).collect()}
    assert got == {(x["doc_id"], x["text"]) for x in substring_dedup(frame(spark, rows), min_words=8, gram=3).collect()}
    distinct = [*rows[:40], *rows[41:43], rows[40]]
    texts = {i: t.split() for i, t in got}
    assert [texts[i] for i, _ in distinct] == brute(distinct, 8)


def test_spans_that_meet_are_one():
    doc = [1, 1, 1, 1, 2, 2, None, None]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, [7, 7, 7, 8, 8, 8, 8, 8], [0, 5, 20, 3, 0, 9, 0, 2], [10, 5, 5, 5, 9, 1, 5, 1])], ["doc", "key", "start", "length"])
    want = [(1, 7, [0, 20], [10, 25]), (1, 8, [3], [8]), (2, 8, [0], [10]), (None, 8, [0], [5])]
    for step in (1, 3, 8):
        out = [r for b in substring._merge(batch.slice(i, step) for i in range(0, 8, step)) for r in b.to_pylist()]
        assert [tuple(r.values()) for r in out] == want


def test_the_filter_misses_no_key(spark):
    from pyspark.sql import functions as F

    from quern.llm.common import Sieve

    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    own = np.array([r["h"] for r in keys.collect()]).view(np.uint64)
    other = np.array([r["h"] for r in spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).collect()]).view(np.uint64)
    full, tight = Sieve(keys, "h"), Sieve(keys, "h", most=1 << 10)
    assert full.holds(own).all() and tight.holds(own).all()
    assert full.holds(other).mean() < 0.02 and tight.words.size == 16
    assert not Sieve(keys.limit(0), "h").holds(other).any()
