import os
import random

import numpy as np
import pytest

from quern.llm import bpe, tokencount


def frame(spark, folder, files):
    rows = []
    for i, tokens in enumerate(files):
        p = folder / f"{i}.u16"
        p.write_bytes(np.array(tokens, "<u2").tobytes())
        rows.append((i, p.as_uri(), p.stat().st_size))
    return spark.createDataFrame(rows, "file long, path string, n_bytes long")


def brute(files, end):
    out = []
    for f, tokens in enumerate(files):
        first = n = 0
        for i, t in enumerate(tokens):
            if t == end:
                out.append((f, n, first, i - first, True))
                first, n = i + 1, n + 1
        if first < len(tokens):
            out.append((f, n, first, len(tokens) - first, False))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_against_brute_force(spark, tmp_path, block):
    r = random.Random(block)
    files = [[r.choice([1, 2, 3, 9, 9] if k % 2 else [1, 2, 3, 4, 5, 6, 7, 8, 9]) for _ in range(r.randrange(40))] for k in range(8)] + [[], [9], [1], [1] * 20 + [9], [9, 9, 9]]
    got = tokencount.count_tokens(frame(spark, tmp_path, files), separator=9, block_tokens=block)
    assert sorted(tuple(x) for x in got.collect()) == brute(files, 9)


def test_odd_bytes_are_ignored(spark, tmp_path):
    df = frame(spark, tmp_path, [[4, 9, 5]])
    with open(tmp_path / "0.u16", "ab") as f:
        f.write(b"x")
    df = df.withColumn("n_bytes", df["n_bytes"] + 1)
    assert sorted(tuple(x) for x in tokencount.count_tokens(df, separator=9).collect()) == [(0, 0, 0, 1, True), (0, 1, 2, 1, False)]


@pytest.mark.skipif(not os.path.exists(tokencount.VOCABULARY), reason="no vocabulary here")
def test_documents(spark):
    texts = ["one two", "", None, "three", "four " * 5000, "one two"]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, file int").coalesce(1)
    own = bpe.Bpe(bpe.read_vocabulary(tokencount.VOCABULARY))
    got = tokencount.token_counts(docs).orderBy("file", "doc_no").collect()
    assert [x["n_tokens"] for x in got] == [len(own.encode(t or "")) for t in texts] and all(x["closed"] for x in got)
    assert tokencount.token_counts(docs.where("false")).count() == 0


def test_ids_that_do_not_fit(spark, tmp_path):
    import base64

    docs = spark.createDataFrame([("a",)], "text string")
    vocabulary = tmp_path / "v"
    for last, separator in ((70_000, 300), (300, 65_536), (300, 300)):
        vocabulary.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)) + f"{base64.b64encode(b'ab').decode()} {last}\n")
        with pytest.raises(ValueError):
            tokencount.write_token_files(docs, str(tmp_path), vocabulary=str(vocabulary), separator=separator)
