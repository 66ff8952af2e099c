"""Cluster inertia and partition entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as V


def cluster_inertia_by_cluster(samples: DataFrame, centroids: DataFrame, distance_metric: str = "cosine") -> DataFrame:
    """(cluster_id, cluster_size, inertia); samples (id, v, cluster_id), centroids (cluster_id, centroid); empty clusters stay."""
    metric = distance_metric if distance_metric in V.METRICS else "cosine"
    own = samples.select(F.col("cluster_id").alias("c"), "v")
    joined = own.join(centroids, F.col("c") == F.col("cluster_id"), "right")
    return joined.select("cluster_id", F.when(F.col("v").isNotNull(), V.distance(F.col("v"), F.col("centroid"), metric)).alias("d")).groupBy("cluster_id").agg(F.count("d").alias("cluster_size"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("inertia"))


def cluster_inertia(samples: DataFrame, centroids: DataFrame, distance_metric: str = "cosine") -> DataFrame:
    """One row: totals and maps by cluster."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("cluster_id", c))))
    each = cluster_inertia_by_cluster(samples, centroids, distance_metric)
    out = each.agg(F.sum("inertia").alias("total_inertia"), F.sum("cluster_size").alias("num_samples"), F.count(F.lit(1)).alias("num_clusters"), entries("cluster_size").alias("cluster_sizes"), entries("inertia").alias("cluster_inertias"))
    return out.withColumn("avg_inertia_per_sample", F.coalesce(F.try_divide("total_inertia", "num_samples"), F.lit(0.0)))


def partition_entropy(samples: DataFrame, num_clusters: int, cluster_col: str = "cluster_id") -> DataFrame:
    """Entropy (natural) of the cluster shares, also over ln(num_clusters); rows without a cluster don't count. One row."""
    if num_clusters < 1:
        raise ValueError("num_clusters must be positive")
    each = samples.where(F.col(cluster_col).isNotNull()).groupBy(F.col(cluster_col).cast("int").alias("cluster_id")).agg(F.count(F.lit(1)).alias("c"))
    pair = lambda x: F.array_sort(F.collect_list(F.struct("cluster_id", x.alias("x"))))
    out = each.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), F.count(F.lit(1)).alias("k"), pair(F.col("c")).alias("counts"))
    entropy = F.when(F.col("n") > 0, F.log("n") - F.col("s") / F.col("n")).otherwise(F.lit(0.0))
    top = F.log(F.lit(float(num_clusters)))
    return out.select(
        entropy.alias("entropy"), F.coalesce(F.try_divide(entropy, top), F.lit(0.0)).alias("normalized_entropy"), top.alias("max_entropy"), F.col("n").alias("num_samples"), F.lit(num_clusters).alias("num_clusters_global"),
        F.col("k").alias("num_clusters_in_subset"), F.map_from_entries("counts").alias("cluster_counts"), F.map_from_entries(F.transform("counts", lambda e: F.struct(e["cluster_id"], (e["x"] / F.col("n")).alias("x")))).alias("cluster_probabilities"),
    )
