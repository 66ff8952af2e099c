import gc
from pathlib import Path
from types import SimpleNamespace
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from quern.llm import common


def test_shared_folder():
    def session(master, conf=None):
        made = []
        context = SimpleNamespace(master=master, applicationId="app", getConf=lambda: {"spark.checkpoint.dir": conf}, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=context), made

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master)[0])
        assert common.shared_dir(session(master, "hdfs://n/shared/")[0]).startswith("hdfs://n/shared/quern-app/")
    for master in ("local", "local[4]", "local[*]"):
        s, made = session(master)
        assert common.shared_dir(s).startswith("file:") and len(made) == 1


def test_discard_and_clean_up(spark):
    df = common.materialise(spark.range(5))
    folder = Path(urlsplit(df.inputFiles()[0]).path).parent
    assert df.count() == 5 and folder.exists()
    common.discard(df.where("id > 1"))  # another DataFrame
    assert folder.exists()
    common.discard(df)
    assert not folder.exists()
    common.discard(df)
    kept = [common.materialise(spark.range(k)) for k in range(3)]
    del kept
    gc.collect()
    home = folder.parent
    assert home.exists()
    common.clean_up(spark)
    assert not home.exists() and common.materialise(spark.range(2)).count() == 2


def test_sift_parts_rows(spark):
    df = spark.range(2000).withColumn("h", F.xxhash64("id"))
    keys = df.where("id % 10 = 0").select("h")
    for params, most in (({}, 30), ({"most": 1 << 9}, 2000)):
        absent, present = common.sift(df, F.col("h"), keys, "h", **params)
        a, b = {r["id"] for r in absent.collect()}, {r["id"] for r in present.collect()}
        assert not a & b and len(a | b) == 2000 and {i for i in range(2000) if i % 10 == 0} <= b and len(b) <= 200 + most
