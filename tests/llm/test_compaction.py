import threading

import pytest
from pyspark.sql import functions as F

from quern.llm.common import shared_dir
from quern.llm.compaction import Conflict, File, Store, Version, shard

SCHEMA = "doc_id long, text string, __arrival int"


def rows_of(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_rows_survive(spark):
    rows = [(i, f"text {i}" * 50, i) for i in range(500)] + [(1, "same", None)] * 2 + [(None, None, None), (7, "", 0), (8, "long " * 50_000, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = shard(df, arrivals=5, target=1 << 20, fanout=3)
    assert out.columns == df.columns and rows_of(out) == rows_of(df)
    assert shard(df.where("false")).count() == 0


def test_versions_and_tiers(spark):
    store = Store(spark, shared_dir(spark), target=40_000, fanout=3)
    assert store.current() is None and store.compact() is None
    with pytest.raises(FileNotFoundError):
        store.read()
    df = spark.range(0, 900).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    for k in range(9):
        store.append(df.where(F.col("doc_id") % 9 == k).coalesce(1))
    before = store.current()
    assert before.number == 9 and len(before.files) == 9
    after = store.compact()
    assert not store.plan(after) and len(after.files) < 9
    assert rows_of(store.read()) == rows_of(df)
    assert store.read(3).count() == 300  # older versions still read
    assert store.retire() >= 9 and rows_of(store.read()) == rows_of(df) and store.retire() == 0
    with pytest.raises(ValueError):
        store.append(df.drop("text"))
    store.append(df.where("false").select("text", "doc_id"))
    assert store.read().count() == 900


def test_plan_merges_similar_sizes():
    store = object.__new__(Store)
    store.target, store.fanout = 1 << 20, 3
    files = tuple(File(str(i), n) for i, n in enumerate([1000, 2000, 60_000, 70_000, 200_000, 300_000, 2 << 20, 250_000]))
    runs = store.plan(Version(1, files, ""))
    assert [[f.size for f in r] for r in runs] == [[1000, 2000, 60_000], [200_000, 300_000, 250_000]]


def test_commit_is_atomic(spark):
    store = Store(spark, shared_dir(spark))
    base = store.append(spark.range(3).toDF("doc_id"))
    store.commit(base, base.files, base.schema)
    with pytest.raises(Conflict):
        store.commit(base, (), base.schema)
    assert store.read().count() == 3
    errors = []

    def write(k):
        try:
            Store(spark, store.folder).append(spark.range(k, k + 1).toDF("doc_id"))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(10 + k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(x[0] for x in store.read().collect()) == [0, 1, 2, 10, 11, 12, 13]


def test_compaction_of_nearly_full_files_ends(spark):
    store = Store(spark, shared_dir(spark), fanout=4)
    df = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    for k in range(4):
        store.append(df.where(F.col("doc_id") % 4 == k).coalesce(1))
    before = store.current()
    store.target = max(f.size for f in before.files) * 10 // 9
    after = store.compact()
    assert after.number == before.number + 1 and len(after.files) == 3
    assert all(f.size >= store.target for f in after.files) or not store.plan(after)
    assert rows_of(store.read()) == rows_of(df)


def test_retire_spares_a_writer_at_work(spark):
    store = Store(spark, shared_dir(spark))
    store.append(spark.range(3).toDF("doc_id"))
    folder, intent = store._announce()
    spark.range(5, 7).toDF("doc_id").coalesce(1).write.parquet(folder)
    files = store._written(folder)
    assert files and store.retire() == 0
    base = store.current()
    store.commit(base, (*base.files, *files), base.schema)
    store.fs.delete(intent, False)
    assert store.retire() == 0 and sorted(r[0] for r in store.read().collect()) == [0, 1, 2, 5, 6]
    dead, _ = store._announce()
    spark.range(9).toDF("doc_id").write.parquet(dead)
    assert store.retire() == 0 and store.retire(grace=-60) == len(spark.range(9).rdd.glom().collect())
    assert store.read().count() == 5
