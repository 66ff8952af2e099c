"""The pipeline's stages over a small corpus, each held to a brute-force version on what the stage before left."""

import itertools
import os
import random

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from quern.llm import bpe, cotrain, simhash
from test_cotrain import corpus, labels_of
from test_substring import brute

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    base, truth = corpus(260, 7)
    docs = [(i, t, lang, source, n) for i, t, lang, source, n, _, _ in base]
    r = random.Random(3)
    words = sorted({w.strip(".") for i, t, *_ in base if truth[i] == "good" for w in t.split()})
    say = lambda n: [r.choice(words) + "." * (k % 9 == 8) for k in range(n)]
    item, passage = say(30), say(70)
    extra = []
    for k in range(12):
        own = say(120)
        extra.append(own)
        if k % 3 == 0:
            extra.append([w if r.random() > 0.02 else r.choice(words) for w in own])  # a near copy
        if k % 4 == 1:
            extra.append(say(40) + passage + say(40))
        if k % 4 == 2:
            extra.append(say(50) + item[k : k + 15] + say(50))
    texts = [" ".join(x) + "." for x in extra] + ["", None, " ".join(extra[0]) + ".", "short text", "short text"]
    docs += [(1000 + k, t, "en", "s4", None if t is None else len(t)) for k, t in enumerate(texts)] + [(None, "no id at all", None, None, 12), (1000, texts[0], "en", "s4", len(texts[0]))]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels_of(truth, range(180)), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), truth, " ".join(item)


def by_id(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0))


def test_stages(spark, tables):
    folder, truth, item = tables
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "substring_dedup", "decontaminate", "encode"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def run(name, df, path):
        stages[name](spark, df, folder).write.mode("overwrite").parquet(path)
        out = spark.read.parquet(path)
        if name != "encode":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        return out

    before = docs.collect()
    kept = run("quality", docs, f"{folder}/1")
    model = cotrain.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert by_id(kept.collect()) == by_id([r for r in before if model.score(r["text"], r["lang"], r["source"], r["n_chars"])[2] >= 0.5])
    ids = {r["doc_id"] for r in kept.collect()}
    held = range(180, 260)
    assert sum((i in ids) == (truth[i] == "good") for i in held) >= 0.93 * len(held) and len([i for i in ids if i and i >= 1000]) > 15

    # near copies: components over all pairs of fingerprints
    before, kept = kept.collect(), run("near_dedup", kept, f"{folder}/2")
    rows = [(i, t) for i, t in dict.fromkeys(by_id(before)) if t and any(c.isalnum() for c in t)]
    import pyarrow as pa

    fp, _ = simhash.fingerprints(pa.array([t.lower() for _, t in rows]))
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if np.bitwise_count(fp[a] ^ fp[b]).sum() <= 40 and group[a] != group[b]:
            x, y = sorted((group[a], group[b]))
            group = [x if g == y else g for g in group]
    want = [rows[g] for g in sorted(set(group))] + [x for x in by_id(before) if not x[1]]
    assert by_id(kept.collect()) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0)) and len(want) < len(before)

    before, kept = by_id(kept.collect()), run("substring_dedup", kept, f"{folder}/3")
    got = by_id(kept.collect())
    assert [i for i, _ in got] == [i for i, _ in before] and [(t or "").split() for _, t in got] == brute(before, 50) and got != before
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept.collect())

    before, kept = got, run("decontaminate", kept, f"{folder}/4")
    runs = lambda t: {tuple(t[k : k + 13]) for k in range(len(t) - 12)}
    clean = [(i, t) for i, t in before if not runs((t or "").split()) & runs(item.split())]
    assert by_id(kept.collect()) == clean and len(clean) < len(before)

    last = run("encode", kept, f"{folder}/5").collect()
    own = bpe.Bpe(bpe.read_vocabulary(bpe.VOCABULARY))
    assert by_id(last) == clean
    for r in last:
        assert r["tokens"] == (None if r["text"] is None else own.encode(r["text"])) and r["round_trip"] in (None, True)

    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.select(*sorted(whole.columns)).collect())) == sorted(map(str, spark.read.parquet(f"{folder}/5").select(*sorted(whole.columns)).collect()))


def test_empty_tables(spark, tables, tmp_path):
    folder = tables[0]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{folder}/documents.parquet").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100  # without labels and benchmark


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
