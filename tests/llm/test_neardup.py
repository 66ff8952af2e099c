import numpy as np

from quern.llm.common import components
from quern.llm.neardup import near_duplicates, plan

SCHEMA = "vec_id long, embedding array<float>, code int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], SCHEMA)


def corpus(seed):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for g in range(60):
        base = rng.standard_normal(32)
        for _ in range(int(rng.choice([1, 2, 5]))):
            rows.append((n, base * rng.uniform(0.5, 2) + rng.standard_normal(32) * 0.15))
            n += 1
    return rows


def test_recall_against_brute_force(spark):
    rows = corpus(1)
    x = np.array([v for _, v in rows]).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    for block in (8192, 3):  # 3: every bucket is cut into blocks
        out = {r["vec_id"]: r["kept_vec_id"] for r in near_duplicates(frame(spark, rows), bits=4, block=block).collect()}
        root = [out.get(i, i) for i in range(len(rows))]
        assert len(near) > 50 and np.mean([root[a] == root[b] for a, b in near]) >= 0.9
        truth = components(spark.createDataFrame([(int(a), int(b)) for a, b in near], "a long, b long")).collect()
        group = {r["node"]: r["root"] for r in truth}
        assert all(group.get(i, i) == group.get(k, k) for i, k in out.items())


def test_edges(spark):
    rows = [(3, [1, 0, 0]), (1, [2, 0, 0]), (None, [1, 0, 0]), (4, None), (5, []), (6, [0, 0, 0]), (7, [float("nan"), 1, 0]), (8, [None, 1, 0]), (9, [1, 0]), (10, [0, 1, 0]), (3, [1, 0, 0]), (11, [-1, 0, 0]), (12, [float("inf"), 0, 0])]
    got = {(r["vec_id"], r["kept_vec_id"]) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == {(3, 1), (None, 1)}
    assert near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_recall_of_production_tables_near_the_threshold(spark):
    """Groups of two at cosines from 0.9 to 0.92, which no third vector connects."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(500):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        cos = rng.uniform(0.9005, 0.92)
        rows += [(2 * g, a), (2 * g + 1, cos * a + np.sqrt(1 - cos**2) * b / np.linalg.norm(b))]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = {(int(b), int(a)) for a, b in np.argwhere(np.triu(x @ x.T >= 0.9, 1))}
    got = {(r["vec_id"], r["kept_vec_id"]) for r in near_duplicates(frame(spark, rows)).collect()}
    assert len(near) == 500 and got <= near and len(got) >= 0.9 * len(near)


def test_plan_keeps_recall_and_bucket_size():
    for n in (0, 10, 1 << 21, (1 << 21) + 1, 16_000_000, 10**9, 10**11):
        tables, bits = plan(n, 0.9)
        share = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 0.94 <= 1 - (1 - share) ** tables < 0.952 and n / 2**bits <= 2048
    assert plan(1 << 21, 0.9) == (12, 10) and plan(5, 1.0) == (1, 10)
