"""Incremental scoring: new files of samples are scored once each; dataset metrics keep mergeable partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.registry import score


def score_stream(spark: SparkSession, source: str, schema: T.StructType, scorers: Sequence[dict[str, Any]], sink: str, checkpoint: str, files_per_trigger: int = 100):
    """Scores JSON-lines files as they arrive in source and writes Parquet to sink, exactly once. Returns the started query
    (it takes what is there and stops; start it again for more)."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(source)
    return score(rows, scorers).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partials(df: DataFrame) -> DataFrame:
    """(d, n, s, q): count, sum and sum of squares of each dimension of v; partials of parts add up to those of the whole."""
    return df.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))


def merged(*parts: DataFrame) -> DataFrame:
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("d").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])


def radius_of(parts: DataFrame) -> DataFrame:
    """The radius from partials. One row."""
    var = F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")), F.lit(0.0))
    return parts.select(F.sqrt(var).alias("s")).agg(F.exp(F.avg(F.log(F.when(F.col("s") == 0, F.lit(1e-10)).otherwise(F.col("s"))))).alias("radius"))
