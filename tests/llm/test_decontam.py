import random

from quern.llm.decontam import decontaminate, matches


def longest(a, b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    return best


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, item_id string, match_words int")


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(spark):
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 8, 12, 20])))) for i in range(12)]
    docs = []
    for i in range(80):
        w = [r.choice(vocab) for _ in range(r.randrange(40))]
        if i % 2:
            src = r.choice(items)[1].split()
            k = r.randrange(len(src))
            w[3:3] = src[k:] if r.random() < 0.5 else src
        docs.append((i, " ".join(w)))
    want = set()
    for i, t in docs:
        for j, u in items:
            a, b = t.split(), u.split()
            n, p, q = longest(a, b)
            if n >= min(8, len(b)):
                want.add((i, j, n, p, q))
    got = {tuple(x) for x in matches(docs_of(spark, docs), items_of(spark, items), min_words=8).collect()}
    assert got == want and want
    split = {tuple(x) for x in matches(docs_of(spark, docs), items_of(spark, items), min_words=8, broadcast_words=30).collect()}
    assert split == want
    bad = {w[0] for w in want}
    kept = decontaminate(docs_of(spark, docs), items_of(spark, items), min_words=8)
    assert kept.columns == ["doc_id", "text", "item_id", "match_words"] and {x["doc_id"] for x in kept.collect()} == {i for i, _ in docs} - bad


def test_edges(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, "x " + item), (4, "q0 q1 q2"), (5, "z " * 50_000 + item), (6, item.upper())]
    items = [(1, item), (1, item), (2, None), (3, ""), (4, "q19")]
    got = sorted((tuple(x) for x in matches(docs_of(spark, docs), items_of(spark, items)).collect()), key=str)
    assert got == sorted([(3, 1, 20, 0, 0), (3, 1, 20, 0, 0), (None, 1, 20, 1, 0), (5, 1, 20, 50_000, 0), (3, 4, 1, 19, 0), (3, 4, 1, 19, 0), (None, 4, 1, 20, 0), (5, 4, 1, 50_019, 0)], key=str)
    assert sorted(x["doc_id"] for x in decontaminate(docs_of(spark, docs), items_of(spark, items)).collect()) == [1, 2, 4, 6]
    assert matches(docs_of(spark, []), items_of(spark, items)).count() == 0
    assert decontaminate(docs_of(spark, docs), items_of(spark, [])).count() == len(docs)


def test_long_items(spark):
    """A passage of many words of a long item; memory follows the words, not their square."""
    r = random.Random(8)
    item = [f"t{r.randrange(5000)}" for _ in range(200_000)]
    rows = [(1, " ".join(["a", *item[1000:60_000], "b"])), (2, " ".join(item)), (3, " ".join(item[5:17])), (4, " ".join(["b", *item[150_000:150_013]]))]
    got = {tuple(x) for x in matches(docs_of(spark, rows), items_of(spark, [(1, " ".join(item)), (2, " ".join(item[:40]))])).collect()}
    assert got == {(1, 1, 59_000, 1, 1000), (2, 1, 200_000, 0, 0), (2, 2, 40, 0, 0), (4, 1, 13, 1, 150_000)}


def test_repeated_words_in_steps():
    import pyarrow as pa

    from quern.llm.decontam import Tests

    tests = Tests([1, 2], ["la " * 40, "x " + "la " * 14], 13)
    part = pa.RecordBatch.from_pydict({"text": ["la " * 30 + "end", "y " + "la " * 14, "la " * 12]})
    want = {(0, 0): (30, 0, 0), (0, 1): (14, 0, 1), (1, 0): (14, 1, 0), (1, 1): (14, 1, 1)}
    assert tests.find(part, "text") == tests.find(part, "text", most=7) == want
