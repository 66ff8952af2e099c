import pytest
from pyspark.sql import functions as F

from quern.llm.revisit import FIXED, canonical_url, captures, resolve

SCHEMA = "record_id long, uri string, at long, kind string, status int, headers map<string,string>, canonical string, base string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "b") for r in rows], SCHEMA)


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://www.Example.org:443/A/b/?b=2&a=1&utm_source=x#f", "example.org/A/b?a=1&b=2"),
        ("http://user:pw@Example.org:80", "example.org"),
        ("http://example.org:8080//", "example.org:8080"),
        ("example.org/?ref=x&refer=1", "example.org?refer=1"),
        ("", None),
        ("  ", None),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u")).alias("c")).first()["c"] == want


def brute(rows, canon):
    out = []
    for r in rows:
        rid, uri, at, kind, status, headers = r
        if kind != "revisit" or status != 304:
            continue
        time = lambda x: float("-inf") if x is None else x
        base = [x for x in rows if x[3] == "response" and x[4] == 200 and canon[uri] is not None and canon[x[1]] == canon[uri] and time(x[2]) <= time(at)]
        if not base:
            out.append((rid, canon[uri], None, "missing", None))
            continue
        b = max(base, key=lambda x: (time(x[2]), x[0]))
        old, new = ({k.lower(): v for k, v in sorted((h or {}).items())} for h in (b[5], headers))
        ok = True
        if old.get("etag") is not None and new.get("etag") is not None:
            ok = old["etag"].removeprefix("W/") == new["etag"].removeprefix("W/")
        elif old.get("last-modified") is not None and new.get("last-modified") is not None:
            ok = old["last-modified"] == new["last-modified"]
        merged = {**old, **{k: v for k, v in new.items() if k not in FIXED}}
        out.append((rid, canon[uri], b[0], "resolved" if ok else "changed", "\n".join(f"{k}: {v or ''}" for k, v in sorted(merged.items())) if ok else None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    import random

    r = random.Random(2)
    urls = ["http://a.org/x", "https://www.a.org/x/", "http://a.org/x#1", "http://b.org", None, ""]
    canon = dict(zip(urls, ["a.org/x", "a.org/x", "a.org/x", "b.org", None, None], strict=True))
    rows = []
    for i in range(150):
        response = r.random() < 0.5
        h = {k: v for k, v in (("ETag" if response else "etag", r.choice(['"1"', 'W/"1"', '"2"'])), ("Last-Modified", r.choice("ab")), ("content-length", str(i)), ("Date", str(i))) if r.random() < 0.7}
        rows.append((i, r.choice(urls), r.choice([None, *range(20)]), "response" if response else "revisit", r.choice([200, 200, 404]) if response else r.choice([304, 304, 200]), r.choice([h, h, h, None])))
    rows.append(rows[-1])
    got = sorted((tuple(x) for x in resolve(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows, canon) and {x[3] for x in got} == {"resolved", "changed", "missing"}


def test_edges(spark):
    assert resolve(frame(spark, [])).count() == 0
    many = [(i, "http://a.org", i, "revisit" if i % 2 else "response", 304 if i % 2 else 200, {"A": "1", "a": None}) for i in range(400)]
    got = resolve(frame(spark, many)).collect()
    assert len(got) == 200 and all(x["refers_to"] == x["record_id"] - 1 for x in got)


def test_captures(spark):
    pages = spark.createDataFrame([(0, "http://a.org", "<p>"), (11, "http://a.org", None), (12, None, "x")], "page_id long, url string, html string")
    got = {x["record_id"]: x["outcome"] for x in resolve(captures(pages)).collect()}
    assert got == {1: "changed", 2: "missing", 45: "resolved", 46: "changed", 49: "missing"}


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_a_hot_url_over_many_parts(spark, parts):
    import random

    r = random.Random(parts)
    urls = ["http://hot.org/"] * 6 + ["http://a.org", "http://z.org", None]
    canon = {"http://hot.org/": "hot.org", "http://a.org": "a.org", "http://z.org": "z.org", None: None}
    rows = []
    for i in range(400):
        kind, status = r.choice([("response", 200), ("revisit", 304), ("revisit", 304), ("revisit", 304), ("response", 404)])
        rows.append((i, r.choice(urls), r.choice([None, 5, r.randrange(2000)]) if i % 9 == 0 else r.randrange(60), kind, status, {"ETag": f"e{r.randrange(2)}"}))
    got = sorted((tuple(x) for x in resolve(frame(spark, rows), parts).collect()), key=str)
    assert got == brute(rows, canon)
