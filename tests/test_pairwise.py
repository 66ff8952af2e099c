import itertools
import re

from pyspark.sql import functions as F

from quern.operators.pairwise import apjs


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_apjs_minhash_estimates_the_exact_mean(spark):
    words = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(words[i % 5 : i % 5 + 12 + i % 3])) for i in range(20)] + [(20, ""), (21, None)]
    sets = [set((t or "").split()) for _, t in rows]
    pairs = list(itertools.combinations(sets, 2))
    want = sum(jaccard(a, b) for a, b in pairs) / len(pairs)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    exact = apjs(df, "doc_id", F.col("text")).first()
    near = apjs(df, "doc_id", F.col("text"), similarity_method="minhash", num_perm=512).first()
    assert exact["num_pairs"] == near["num_pairs"] == len(pairs)
    assert abs(exact["score"] - want) < 1e-9 and abs(near["score"] - want) < 0.05


def test_minhash_query(spark):
    import itertools

    import pytest

    from compare import SF_DIR, connection
    from quern.functions.text import WORDS
    from quern.plans.queries import QUERIES

    sets = [set(WORDS.findall(t.lower())) for (t,) in connection().execute("SELECT text FROM documents").fetchall()]
    want = sum(len(a & b) / len(a | b) if a or b else 0.0 for a, b in itertools.combinations(sets, 2)) / (len(sets) * (len(sets) - 1) / 2)
    got = QUERIES["d01_apjs_minhash"](spark, SF_DIR).first()
    assert got["num_samples"] == len(sets) and got["num_pairs"] == len(sets) * (len(sets) - 1) // 2
    # words that most texts hold decide at once about many pairs: with ideal permutations, the mean of 128 has a standard
    # deviation of 0.0048 here
    assert abs(got["score"] - want) < 0.0145
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert apjs(docs, "doc_id", F.col("text"), similarity_method="minhash", num_perm=2048).first()["score"] == pytest.approx(want, rel=0.12)


def test_sampled_pairs(spark):
    import numpy as np

    from quern.operators.pairwise import aps

    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 5))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    for metric in ("cosine", "euclidean", "manhattan", "dot_product", "pearson"):
        whole, every, some = (aps(df, metric, n).first() for n in (None, 435, 60))
        assert (every["num_pairs"], some["num_pairs"], some["total_possible_pairs"], some["is_sampled"]) == (435, 60, 435, True)
        assert abs(every["score"] - whole["score"]) < 1e-9 and some["score"] == aps(df, metric, 60).first()["score"] != whole["score"]
    texts = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 7}" for j in range(1, 6))) for k in range(12)], "doc_id long, text string")
    whole, every, some = (apjs(texts, "doc_id", F.col("text"), sample_pairs=n).first() for n in (None, 66, 20))
    assert abs(every["score"] - whole["score"]) < 1e-9 and some["num_pairs"] == 20 and every["total_possible_pairs"] == 66


def test_apjs_by_tokens(spark):
    from quern.operators.tokens import token_ids

    texts = ["abab", "ab", "", "ba"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = apjs(df, "doc_id", F.col("text"), n=2, tokens=token_ids(F.col("text"))).first()
    sets = [{t[k : k + 2] for k in range(len(t) - 1)} for t in texts]
    pairs = list(itertools.combinations(sets, 2))
    assert got["tokenization_method"] == "token" and abs(got["score"] - sum(jaccard(a, b) for a, b in pairs) / len(pairs)) < 1e-9


def vectors(spark, x, partitions=3):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(partitions)


def test_novel_sum_shuffles_no_pairs(spark, monkeypatch):
    """what goes to disk grows with the rows; several rows of distances at a time, several blocks."""
    import numpy as np

    from quern.operators import blocks, novelty

    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 6))
    x[600:] = x[:100]
    df = vectors(spark, x)
    plan = novelty.novel_sum(df)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"collect_list\(struct\(d, d#\d+, rho", plan)
    monkeypatch.setattr(blocks, "BLOCK", 1 << 14)  # 700 rows of 12 numbers are five blocks
    got = novelty.novel_sum(df, density_powers=(0, 0.5), neighbors=(3,), distance_powers=(0, 1, 2)).first()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    rho = (np.maximum(np.sort(d, axis=1)[:, :3].mean(axis=1), 0) + 1e-10) ** -0.5
    rank = np.arange(1, 700.0)
    for dp, scale in ((0, np.ones(700)), (0.5, rho)):
        s = np.sort(d * scale, axis=1)[:, :-1]
        for q in (0, 1, 2):
            want = ((s * rank**-q).sum(axis=1) / (rank**-q).sum()).mean()
            assert abs(got[f"neighbor_3_density_{dp:g}_distance_{q}"] - want) < 1e-6 * want
    assert got["num_samples"] == 700 and abs(got["cos_distance"] - d[np.isfinite(d)].mean()) < 1e-9


def brute(x, metric):
    import numpy as np

    from quern.operators.blocks import distances

    d = distances(x, x, metric)
    np.fill_diagonal(d, np.inf)
    return d


def test_knn_settles_ties_and_screens_exactly(spark):
    """copies tie and go by id, far from the origin too; rows that aren't finite are nobody's neighbours."""
    import numpy as np

    from quern.operators.pairwise import knn, nearest

    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 7))
    x[300:600] = x[:300]
    x[600:610] = x[0]
    x[899, 2] = np.nan
    for shift in (0, 1e5):
        df = vectors(spark, x + shift)
        for metric in ("euclidean", "cosine", "manhattan", "squared_euclidean"):
            if metric == "cosine" and shift:
                continue
            d = brute(x[:899] + shift, metric)
            got = {r["id"]: r["score"] for r in knn(df, 5, metric).collect()}
            want = np.sort(d, axis=1)[:, :5].mean(axis=1)
            assert len(got) == 899 and max(abs(got[k] - w) for k, w in enumerate(want)) < 1e-6
    near = nearest(vectors(spark, x), 12, "cosine").where("id in (0, 605)").orderBy("id", "rank").collect()
    assert [r["other"] for r in near if r["id"] == 0][:11] == [300, *range(600, 610)]
    assert [r["other"] for r in near if r["id"] == 605][:11] == [0, 300, *[k for k in range(600, 610) if k != 605]]


def test_aps_euclidean_by_products(spark, monkeypatch):
    """each pair of blocks once, whatever the vectors' distance from the origin; copies are at distance 0."""
    import numpy as np

    from quern.operators import blocks
    from quern.operators.pairwise import aps

    monkeypatch.setattr(blocks, "BLOCK", 1 << 13)
    rng = np.random.default_rng(9)
    for shift in (0, 1e6):
        x = rng.normal(size=(800, 5)) + shift
        x[500:] = x[:300]
        got = aps(vectors(spark, x), "euclidean").first()
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        assert got["num_pairs"] == 319600 and abs(got["score"] - d.sum() / 2 / 319600) < 1e-8
    same = aps(vectors(spark, np.ones((50, 4)) * 0.3), "euclidean").first()
    assert same["score"] == 0


def test_miwv_takes_the_smallest_id_of_equal_neighbours(spark):
    """copies of a vector are at exactly the same distance, wherever in a block they are."""
    import numpy as np
    from pyspark.sql import functions as F

    from quern.operators.pairwise import miwv

    rng = np.random.default_rng(10)
    x = np.repeat(rng.normal(size=(40, 64)), 30, axis=0)[rng.permutation(1200)]
    df = vectors(spark, x)
    losses = df.select("id", F.lit(1.0).alias("zero_shot"), F.lit(2.0).alias("one_shot"))
    first = {}
    for k, v in enumerate(map(bytes, x)):
        first.setdefault(v, []).append(k)
    got = {r["id"]: r["most_similar_id"] for r in miwv(df, losses).collect()}
    assert got == {k: next(o for o in first[bytes(v)] if o != k) for k, v in enumerate(x)}


def test_nearest_meets_each_pair_of_blocks_once(spark):
    """one tile serves the rows of both blocks; ties within and between blocks go by id, an id is no neighbour of its own."""
    import numpy as np

    from quern.operators.pairwise import nearest

    rng = np.random.default_rng(11)
    x = rng.integers(-2, 3, (1500, 4)).astype(float)
    df = vectors(spark, x)
    assert re.search(r"l_b#\d+ <= r_b#\d+", nearest(df, 1)._jdf.queryExecution().optimizedPlan().toString())
    for metric in ("euclidean", "manhattan", "squared_euclidean"):  # exact in whole numbers
        d = brute(x, metric)
        for k in (1, 3):
            got = {(r["id"], r["rank"]): (r["other"], r["d"]) for r in nearest(df, k, metric).collect()}
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            assert got == {(a, r + 1): (o, d[a, o]) for a in range(len(x)) for r, o in enumerate(order[a].tolist())}
    twice = df.unionByName(df.selectExpr("id", "transform(v, e -> e + 0.25) v"))
    assert nearest(twice, 1).where("id = other").count() == 0


def test_top_k_of_both_sides(monkeypatch):
    """both sides of a tile, several tiles each way, blocks of unequal size and common ids; few pairs held at a time."""
    import tracemalloc

    import numpy as np

    from quern.operators import blocks

    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(1100, 9)), rng.normal(size=(2300, 9))
    x[:40], y[700:720], y[5] = y[:40], y[700], 0
    i, j = np.arange(1100) * 3, np.arange(2300) * 2
    for kept in (1000, 1 << 20):
        monkeypatch.setattr(blocks, "KEPT", kept)
        for metric in ("cosine", "euclidean", "manhattan"):
            want = []
            for a, p, b, q in ((i, x, j, y), (j, y, i, x)):
                d = np.array([blocks.exact(np.tile(v, (len(q), 1)), q, metric) for v in p])
                d[a[:, None] == b] = np.inf
                order = np.argsort(d, axis=1, kind="stable")[:, :4]
                want += [(a[r], b[c], d[r, c]) for r in range(len(a)) for c in order[r]]
            got = blocks.top_k(i, x, j, y, 4, metric, True)
            assert list(zip(got["id"], got["other"], got["d"], strict=True)) == want
    monkeypatch.setattr(blocks, "KEPT", 1 << 16)
    same, ids = np.ones((2500, 4)), np.arange(2500)
    tracemalloc.start()
    got = blocks.top_k(ids, same, ids, same, 1, "cosine")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["other"].tolist() == [1] + [0] * 2499 and most < 100e6


def test_apjs_forms_no_pairs(spark, monkeypatch):
    """no self join on n-grams; copies, empty sets, frequent n-grams and several blocks count whole."""
    from quern.operators import sets

    texts = [" ".join(f"w{(k * j) % 11 if j % 3 else 0} x{j * k % 173}" for j in range(1, 4 + k % 9)) for k in range(590)]
    texts += [texts[5]] * 20 + ["", None, "one"] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert not re.search(r"Join Inner, \(gram", apjs(df, "doc_id", F.col("text"))._jdf.queryExecution().optimizedPlan().toString())
    for rows, step, dense, elements in ((4096, 1 << 21, 0.004, 1 << 22), (97, 1000, 2.0, 1 << 22), (97, 1000, 0.0, 1000)):
        monkeypatch.setattr(sets, "ROWS", rows)
        monkeypatch.setattr(sets, "ELEMENTS", elements)
        monkeypatch.setattr(sets, "STEP", step)
        monkeypatch.setattr(sets, "DENSE", dense)
        for n in (1, 2):
            words = [(t or "").split() for t in texts]
            grams = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in words]
            pairs = list(itertools.combinations(grams, 2))
            got = apjs(df, "doc_id", F.col("text"), n=n).first()
            assert got["num_pairs"] == len(pairs) and abs(got["score"] - sum(jaccard(a, b) for a, b in pairs) / len(pairs)) < 1e-9


def test_apjs_minhash_gathers_no_ngrams(spark):
    """texts go in and minima come out, by tokens as by words."""
    df = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 7, 12))) for k in range(40)] + [(40, ""), (41, None)], "doc_id long, text string")
    got = apjs(df, "doc_id", F.col("text"), similarity_method="minhash")
    assert "ArrowEvalPython" not in got._jdf.queryExecution().optimizedPlan().toString()
    tokens = apjs(df, "doc_id", F.col("text"), similarity_method="minhash", tokens=F.split(F.coalesce("text", F.lit("")), " ")).first()
    exact = apjs(df, "doc_id", F.col("text")).first()["score"]
    assert abs(got.first()["score"] - exact) < 0.06 and abs(tokens["score"] - exact) < 0.06
