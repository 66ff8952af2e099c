import random

import numpy as np
import pytest

from quern.llm import cotrain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, score double"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(3, 8))) for _ in range(400)]
    docs, truth = [], {}
    for i in range(n):
        kind = r.choice(["good"] * 6 + ["toxic", "signs", "repeat"])
        words = [r.choice(vocab) for _ in range(r.randrange(60, 160))]
        if kind == "toxic":
            for _ in range(5):
                words.insert(r.randrange(len(words)), r.choice(["scumbag", "vermin", "wretch"]))
        if kind == "signs":
            words = [w + "###" for w in words]
        if kind == "repeat":
            words = words[:2] * 60
        text = ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)) + "."
        # metadata tells something too: most bad documents come from two sources
        source = f"s{r.choice([1, 2]) if kind != 'good' and r.random() < 0.8 else r.randrange(3, 9)}"
        docs.append((i, text, r.choice(["en", None]), source, len(text), "k", 0.0))
        truth[i] = kind
    return docs, truth


def labels_of(truth, ids):
    return [(i, int(truth[i] in ("good", "toxic")), int(truth[i] == "toxic")) for i in ids]


def test_held_out_accuracy(spark):
    docs, truth = corpus(900)
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels_of(truth, range(500)), LABELS)
    out = {x["doc_id"]: x for x in cotrain.score(df, lab).collect()}
    assert len(out) == 900
    held = range(500, 900)
    assert sum(out[i]["keep"] == (truth[i] == "good") for i in held) / 400 >= 0.97
    assert all(0 <= out[i][c] <= 1 for i in held for c in ("p_text", "p_meta", "score"))
    bad = [out[i]["p_meta"] for i in held if truth[i] != "good"]
    good = [out[i]["p_meta"] for i in held if truth[i] == "good"]
    assert sum(bad) / len(bad) < sum(good) / len(good) - 0.2
    model = cotrain.train(df, lab)
    assert model.exchanged > 0 and model.heldout_accuracy >= 0.95
    kept = cotrain.keep_good(df, lab)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in out.items() if x["keep"]}


def test_only_labels_are_sampled(spark):
    docs, truth = corpus(900, 2)
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels_of(truth, range(400)), LABELS)
    m = cotrain.train(df, lab, labelled=300)
    assert m.constant is None and m.exchanged > 300  # of 600 documents, by both views
    twice = cotrain.train(df.unionByName(df.where("doc_id >= 400")), lab, labelled=300)  # copies change nothing
    assert (twice.exchanged, twice.text.weights, twice.meta.weights, twice.combine) == (m.exchanged, m.text.weights, m.meta.weights, m.combine)


def random_pool(seed, n=400, sizes=(30, 8)):
    rng = np.random.default_rng(seed)
    pool = [[np.flatnonzero(rng.random(k) < 0.3).astype(np.int32) for _ in range(n)] for k in sizes]
    views = [cotrain.View(bias=0.1, slope=1.5, shift=-0.2, by_number=rng.normal(size=k)) for k in sizes]
    return pool, views


def test_exchange_against_brute_force(spark):
    pool, views = random_pool(4)
    df = spark.createDataFrame([(t.astype("<u2").tobytes(), m.astype("<u2").tobytes()) for t, m in zip(*pool, strict=True)], "t binary, m binary").repartition(3)
    pulls, count = cotrain.exchange_over(df, 0.8)(views, 500)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    seen = 0
    for v in (0, 1):
        raw = [np.array([views[u].by_number[x].sum() + 0.1 for x in pool[u]]) for u in (0, 1)]
        p = sigmoid(1.5 * raw[1 - v] - 0.2)
        sure = np.flatnonzero((p >= 0.8) | (p <= 0.2))
        seen += sure.size
        x = np.zeros((sure.size, views[v].by_number.size + 1))
        for k, i in enumerate(sure):
            x[k, pool[v][i]] = x[k, -1] = 1
        y = (p[sure] >= 0.8).astype(float)
        e = sigmoid(raw[v][sure]) - y
        for got, want in ((pulls[v].good, y @ x), (pulls[v].bad, (1 - y) @ x), (pulls[v].gradient, e @ x), (pulls[v].curvature, (x.sum(axis=1) / 4) @ x)):
            assert np.allclose(got, want / sure.size, atol=1e-5)
        assert pulls[v].weight == min(0.5, sure.size / 500)
    assert count == seen > 100


def test_the_bound_is_lowered_with_the_loss():
    pool, views = random_pool(5)
    rng = np.random.default_rng(6)
    x = np.zeros((400, 31))
    for k, f in enumerate(pool[0]):
        x[k, f] = x[k, -1] = 1
    truth = rng.normal(size=31)
    y = (x @ truth > 0).astype(float)
    w = np.append(views[0].by_number, views[0].bias)
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).mean()
    labelled, labels = pool[0][:60], y[:60]
    for _ in range(5):
        e = 1 / (1 + np.exp(-(x @ w))) - y
        pull = cotrain.Pull(y @ x / 400, (1 - y) @ x / 400, e @ x / 400, x.sum(axis=1) / 4 @ x / 400, 1e6)  # the pseudo-labels count alone
        new = cotrain.fit(labelled, labels, 30, 1e-9, 0, 0.0, 2000, pull, cotrain.View(bias=w[-1], by_number=w[:-1]))
        after = np.append(new.by_number, new.bias)
        assert loss(after) < loss(w)
        w = after


@pytest.mark.parametrize("labels, keep", [([], True), ([(1, 1, 0)], True), ([(1, 0, 0)], False), ([(None, 0, 0), (2, None, None)], True), ([(1, 1, 0), (1, 1, 1)], False)])
def test_one_class_or_none(spark, labels, keep):
    df = spark.createDataFrame([(1, "some text", "en", "a", 9, None, None), (2, None, None, None, None, None, None), (2, "", "en", "a", 0, "", 1.0)], SCHEMA)
    out = cotrain.score(df, spark.createDataFrame(labels, LABELS)).collect()
    assert [x["keep"] for x in out] == [keep] * 3


def test_edges(spark):
    docs, truth = corpus(200, 3)
    odd = [(None, None, None, None, None, None, None), (1000, "", "", "", -5, "x", 2.0), (1001, "w " * 100_000, "en", "s3", 200_000, "x", 1.0), docs[0], docs[0]]
    lab = spark.createDataFrame(labels_of(truth, range(200)), LABELS)
    out = cotrain.score(spark.createDataFrame(docs + odd, SCHEMA), lab).collect()
    assert len(out) == 205 and len({(x["score"]) for x in out if x["doc_id"] == 0}) == 1
    assert cotrain.score(spark.createDataFrame([], SCHEMA), lab).count() == 0
    few = spark.createDataFrame([(d[0], d[1]) for d in docs], "doc_id long, text string")
    assert cotrain.score(few, lab).count() == 200
