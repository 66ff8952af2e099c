"""Runs a query and its SQL side by side, as the driver does."""

from __future__ import annotations

import math
import os
from pathlib import Path

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return (0, "")
    if isinstance(x, (list, tuple)):
        return (3, tuple(value(v) for v in x))
    return (2, x) if isinstance(x, str) else (1, float(x))


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(value(r[k]) for k in order) for r in data)


def connection():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(SF_DIR, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def check(spark, query, sql):
    got = query(spark, SF_DIR)
    have = rows(got.columns, got.collect())
    cur = connection().execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert have[0] == want[0]
    assert len(have[1]) == len(want[1])
    wrong = [(a, b) for a, b in zip(have[1], want[1], strict=True) if a != b]
    assert not wrong, f"{len(wrong)} of {len(have[1])} rows differ: {str(wrong[0])[:400]}"
