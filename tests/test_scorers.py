"""Queries that SQL can't express, over whole tables, against plain Python and NumPy."""

import ast
import math
import os
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import SF_DIR, connection
from quern.functions import text as X
from quern.functions import vectors as V
from quern.operators import lexical, spectral, tokens
from quern.plans.queries import QUERIES, VOCABULARY

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


def scores(spark, name, key="doc_id", column="score"):
    got = QUERIES[name](spark, SF_DIR)
    rows = got.collect()
    out = {r[key]: (r[column] if isinstance(column, str) else tuple(r[c] for c in column)) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def texts():
    return dict(connection().execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def vectors():
    return {i: np.array(v, float) for i, v in connection().execute("SELECT vec_id, embedding FROM embeddings").fetchall()}


def same(got, want, places=1e-6):
    assert got.keys() == want.keys()
    wrong = [(k, got[k], want[k]) for k in got if not math.isclose(got[k], want[k], rel_tol=places, abs_tol=places)]
    assert not wrong, wrong[:3]


def shannon(items):
    c = Counter(items)
    n = sum(c.values())
    return -sum(x / n * math.log2(x / n) for x in c.values()) if n else 0.0


def bare(text):
    return re.sub(r"[^\w\s]|_", "", text.lower()).split()


def test_compress_ratio(spark, texts):
    same(scores(spark, "h01_compress_ratio"), {i: len(zlib.compress(t.encode(), 9)) / len(t.encode()) if t else 0.0 for i, t in texts.items()})


def test_mtld(spark, texts):
    def one_way(words):
        factors, start = 0.0, 0
        for k in range(len(words)):
            run = words[start : k + 1]
            if len(set(run)) / len(run) <= 0.72:
                factors, start = factors + 1, k + 1
        rest = words[start:]
        if rest:
            factors += (1 - len(set(rest)) / len(rest)) / 0.28
        return len(words) / factors if factors else len(words)

    got = scores(spark, "h05_mtld")
    assert got.keys() == texts.keys()
    short = {i: t for i, t in texts.items() if len(t) < 5000}
    want = {i: (one_way(w) + one_way(w[::-1])) / 2 if (w := bare(t)) else 0.0 for i, t in short.items()}
    same({i: got[i] for i in short}, want)


@pytest.fixture(scope="module")
def encoded(texts):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb")) if a}
    return {i: tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(t) for i, t in texts.items()}


needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@needs_vocabulary
def test_token_scores(spark, encoded):
    same(scores(spark, "h09_token_entropy"), {i: shannon(t) for i, t in encoded.items()})
    assert scores(spark, "h10_token_length") == {i: len(t) for i, t in encoded.items()}
    same(scores(spark, "h14_unique_ntoken"), {i: len(set(zip(t, t[1:]))) / (len(t) - 1) if len(t) > 1 else 0.0 for i, t in encoded.items()})


def test_tree(spark, texts):
    """The stand-in parser's chain: as deep as the longest sentence is long."""
    want = {}
    for i, t in texts.items():
        sentences = [len(s.split()) for s in re.split(r"[.!?]", t)]
        want[i] = (sum(sentences), max(sentences))
    assert scores(spark, "h11_tree_instruct", column=("nodes", "depth")) == want
    assert tokens.tree_shape([1, -1, 1, 2, 9]) == (0, 0) and tokens.tree_shape([1, 0]) == (0, 0)
    assert tokens.tree_shape([1, -1, 1, 2]) == (4, 3) and tokens.tree_shape([-1]) == (1, 1)


def test_python(spark, texts):
    def valid(code):
        try:
            ast.parse(code)
            return True
        except (SyntaxError, ValueError):
            return False

    got = scores(spark, "h12_ts_python")
    for i, t in texts.items():
        if i % 5 in (1, 4):  # never Python: a tag
            assert got[i] == 0
        elif i % 5 in (2, 3):
            assert got[i] == 1
        else:
            assert got[i] == int(bool(t.strip()) and valid(t))


def test_vocd(spark, texts):
    grid = np.exp(np.linspace(np.log(1e-2), np.log(1e5), 20_001))

    def d_of(words, most):
        if len(words) < most:
            return None
        n, total = np.arange(35, most + 1), len(words)
        ttr = np.array([sum(1 - math.comb(total - c, k) / math.comb(total, k) for c in Counter(words).values()) / k for k in n])
        loss = ((grid[:, None] / n * (np.sqrt(1 + 2 * n / grid[:, None]) - 1) - ttr) ** 2).sum(axis=1)
        return grid[loss.argmin()]

    got = scores(spark, "h15_vocd")
    assert got.keys() == texts.keys()
    some = {i: bare(t) for i, t in texts.items() if len(t) < 4000}
    for i, words in some.items():
        want = d_of(words, 50)
        assert got[i] == 0 if want is None else math.isclose(got[i], want, rel_tol=2e-3), i
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    wide = {r[0]: r[1] for r in df.select("doc_id", lexical.vocd(F.col("text"), 80)).collect()}
    for i, words in list(some.items())[:60]:
        want = d_of(words, 80)
        assert wide[i] == 0 if want is None else math.isclose(wide[i], want, rel_tol=2e-3), i
    drawn = {r[0]: r[1] for r in df.select("doc_id", lexical.vocd(F.col("text"), within_sample=400, mode="sampled")).collect() if r[1]}
    near = [abs(np.log(drawn[i] / got[i])) for i in drawn if 1 < got[i] < 500]
    assert drawn and np.median(near) < 0.1


def test_log_det(spark, vectors):
    x = np.array(list(vectors.values()))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    got = QUERIES["d06_log_det"](spark, SF_DIR).first()
    sign, value = np.linalg.slogdet(s + 1e-10 * np.eye(len(s)))
    assert got["num_samples"] == len(x) and got["sign"] == 1.0 and sign == 1 and got["is_positive_definite"] == (np.linalg.matrix_rank(s) == len(s))
    assert math.isclose(got["log_det"], value, rel_tol=1e-3)
    assert math.isclose(got["mean"], s.mean(), abs_tol=1e-6) and math.isclose(got["min"], s.min(), abs_tol=1e-6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, v array<double>")
    short = spectral.log_det(df, extremes=False).first()
    assert math.isclose(short["log_det"], got["log_det"], rel_tol=1e-6) and short["similarity_matrix_stats"]["min"] is None


def test_vendi(spark, vectors):
    x = np.array(list(vectors.values()))

    def score(k):
        e = np.clip(np.linalg.eigvalsh(k), 0, None)
        p = e[e > 0] / e.sum()
        return float(np.exp(-(p * np.log(p)).sum()))

    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {"cosine": score(unit(x) @ unit(x).T), "pearson": score(np.corrcoef(x)), "dot_product": score(x @ x.T)}
    got = {r["similarity_metric"]: r["vendi_score"] for r in QUERIES["d10_vendi"](spark, SF_DIR).collect()}
    same({k: got[k] for k in want}, want, 1e-4)
    far = {"euclidean": np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), "manhattan": np.abs(x[:, None] - x[None]).sum(axis=2)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, v array<double>")
    for m, d in far.items():
        assert math.isclose(spectral.vendi(df, m).first()["vendi_score"], score(1 / (1 + d)), rel_tol=1e-4)
        with pytest.raises(ValueError, match="more than 10 samples"):
            spectral.vendi(df, m, most=10)


def projections(vectors):
    """id -> singular values of the whole and of the halved matrix."""
    return {i: [np.linalg.svd(v.reshape(8, 8)[:n], compute_uv=False) for n in (8, 4)] for i, v in vectors.items()}


def test_spectra(spark, vectors):
    rank = lambda s: float(np.exp(shannon_of(s)))
    shannon_of = lambda s: -(s / s.sum() * np.log(s / s.sum())).sum()
    every = projections(vectors)
    for name, f in (("m08_effective_rank", rank), ("m21_nuclear_norm", lambda s: float(s.sum()))):
        for p in "QKVO":
            same(scores(spark, name, "id", p), {i: (f(a) + f(b)) / 2 for i, (a, b) in every.items()})
    same(scores(spark, "m09_embed_svd_entropy", "id"), {i: float(-(a / a.sum() * np.log(a / a.sum() + 1e-10)).sum()) for i, (a, _) in every.items()})


def test_logical_words(spark):
    df = spark.createDataFrame([(1, "And, the AND；sand the"), (2, None), (3, "")], "id int, t string").coalesce(1)
    words = [" And ", "the", "", "and"]
    got = df.select(lexical.logical_word_count(F.col("t"), words).alias("s"), lexical.logical_word_count(F.col("t"), words, "token").alias("w"), lexical.logical_word_counts(F.col("t"), words, "token").alias("c")).collect()
    assert [(r["s"], r["w"], r["c"]) for r in got] == [(5, 4, {"and": 2, "the": 2}), (0, 0, {"and": 0, "the": 0}), (0, 0, {"and": 0, "the": 0})]
    assert df.select(lexical.logical_word_count(F.col("t"), [" "])).first()[0] == 0


def test_words_are_the_same_in_both_engines(spark):
    odd = ["", " ", "a_b c's Ünï-x 12,5 ①Ⅷ", "x\u00a0y\u2003z \x0b\x1c", "日本語。テスト", "e\u0301 \ufe0f 😀!!", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string")
    for r in df.select(F.coalesce(F.lower("t"), F.lit("")).alias("low"), X.words(F.col("t")).alias("w"), X.plain_words(F.col("t")).alias("p"), lexical.gram_entropy(F.col("t")).alias("e"), lexical.hdd(F.col("t")).alias("h")).collect():
        assert X.WORDS.findall(r["low"]) == (r["w"] or []), r
        assert math.isclose(r["e"], shannon(r["w"] or []), abs_tol=1e-12)
        p = r["p"] or []
        assert math.isclose(r["h"], len(set(p)) / len(p) if p else 0.0, abs_tol=1e-12)  # fewer than 42 words: all are drawn


def test_embedding_plug_in(spark):
    from quern.plans import registry

    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, t string")
    got = {r["id"]: r["v"] for r in registry.embed(df, "id", F.col("t"), registry.hashing_embedder(8), 8).collect()}
    assert len(got[1]) == 8 and not any(got[2]) and V.METRICS
    long = spark.createDataFrame([(k, "ä" * k) for k in range(9)], "id long, t string").coalesce(1)
    cut = {r["id"]: (r["v"], r["truncated"]) for r in registry.embed(long, "id", F.col("t"), lambda ts: [[len(t), len(ts)] for t in ts], max_tokens=7, batch=4, report=True).collect()}
    assert cut == {k: ([min(k, 3), 4 if k < 8 else 1], k > 3) for k in range(9)}
    assert registry.embed(long, "id", F.col("t"), lambda ts: [[0.0] * len(t) for t in ts], 2).count() == 1


@needs_vocabulary
def test_limits():
    with open(VOCABULARY, "rb") as f:
        limit = tokens.tiktoken_limit(f.read())
    assert limit(["one two three", "one", ""], 2) == (["one two", "one", ""], [True, False, False])


def test_backend_and_registry(spark):
    from quern.plans import registry

    class Backend:
        schema = "reward double, logits array<double>"

        def predict(self, batch):
            import pandas as pd

            n = batch["output"].fillna("").str.len()
            return pd.DataFrame({"reward": n * 1.0, "logits": [[0.0, float(x)] for x in n]})

    df = spark.createDataFrame([("a", "i", "abc"), ("b", "i", None)], "id string, instruction string, output string")
    out = registry.score(registry.with_backend(df, Backend()), "scorers:\n- {name: x, type: AtheneScorer, config: {}}\n- {name: y, type: StrLengthScorer, config: {fields: [output]}}\n")
    assert {tuple(r) for r in out.collect()} == {("a", 3.0, 3), ("b", 0.0, 0)}
    with pytest.warns(UserWarning, match="max_workers"):
        registry.score(df, [{"name": "StrLengthScorer", "max_workers": 3}])
    with pytest.raises(ValueError):
        registry.score(df, [{"name": "NoScorer"}])
    e = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], "id long, v array<double>")
    assert registry.evaluate(e, {"name": "RadiusScorer"}).first()["num_samples"] == 4
    with pytest.raises(ValueError):
        registry.evaluate(e, {"name": "StrLengthScorer"})


def test_entropy_by_shuffle(spark):
    df = spark.createDataFrame([(1, "a b b, a"), (2, "x"), (3, "")], "k int, t string")
    got = {r["id"]: r["score"] for r in lexical.gram_entropy_by_shuffle(df, "k", F.col("t")).collect()}
    want = {r["k"]: r["e"] for r in df.select("k", lexical.gram_entropy(F.col("t")).alias("e")).collect()}
    same(got, {k: want[k] for k in (1, 2)})  # a text without words has no row


def test_text_scorers_hold_few_texts_at_a_time(spark):
    """F8, F9: of a batch's texts, Python objects are made slice by slice, in order."""
    import pyarrow as pa

    from quern.functions import text as X

    seen = []

    class Column:
        def __init__(self, data):
            self.data = data

        def __len__(self):
            return len(self.data)

        def slice(self, k, n):
            seen.append(n)
            return self.data.slice(k, n)

    data = pa.array([f"t{k}" for k in range(3 * X.SLICE + 5)])
    assert list(X.values(Column(data))) == data.to_pylist() and len(seen) == 4 and max(seen) == X.SLICE < 100


def test_gram_rows_come_in_small_batches(spark):
    """the n-grams of a batch of texts are never one array column; keys keep their type."""
    from pyspark.sql import functions as F

    from quern.operators.contamination import gram_hashes, gram_rows

    texts = [" ".join(f"w{k}x{j}" for j in range(k % 900)) for k in range(400)] + ["", None]
    df = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "doc string, text string").coalesce(1)
    rows = gram_rows(df, "doc", F.col("text"), 8)
    assert "Explode" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.schema["doc"].dataType.simpleString() == "string"
    got = {}
    for r in rows.collect():
        got.setdefault(r["doc"], []).append(r["g"])
    want = {f"d{k}": sorted(gram_hashes((t or "").split(), 8).tolist()) for k, t in enumerate(texts)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
