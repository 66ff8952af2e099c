"""Mean pairwise similarity, nearest neighbours, facility location. Embeddings are frames (id long, v array<double>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import vectors as V
from quern.operators.blocks import block_pairs, cells, distances, euclidean_sum, pack, shape, top_k
from quern.operators.contamination import gram_hashes, grams, lowered
from quern.operators.sets import jaccard_sum


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The frame that the operators here take; rows without a vector are left out."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")


def _sampled(df: DataFrame, pairs: int, seed: int = 42) -> DataFrame:
    """The pairs with the smallest seeded hashes (the feature of sample_pairs)."""
    return df.orderBy(F.xxhash64(F.lit(seed), "i", "j"), "i", "j").limit(pairs)


# --- Apjs ------------------------------------------------------------------------------------------------------------


def apjs(df: DataFrame, id_col: str, text: Column, n: int = 1, similarity_method: str = "direct", num_perm: int = 128, tokens: Column | None = None, sample_pairs: int | None = None) -> DataFrame:
    """Average pairwise Jaccard similarity of n-gram sets; two empty sets have similarity 0. One row."""
    items = tokens if tokens is not None else X.words(F.coalesce(text, F.lit("")))
    sets = df.select(F.col(id_col).alias("id"), F.array_distinct(X.ngrams(items, n)).alias("g"))
    size = df.agg(F.count(F.lit(1)).alias("num_samples"))
    hashes = grams(text, n) if tokens is None else F.transform(F.array_distinct(X.ngrams(items, n)), lambda g: F.xxhash64(g))
    if similarity_method == "minhash":
        total = _minhash_sum(df.select(lowered(text)), num_perm, n) if tokens is None else _minhash_sum(df.select(hashes.alias("h")), num_perm)
    elif sample_pairs:
        every = sets.select(F.col("id").alias("i")).crossJoin(sets.select(F.col("id").alias("j"))).where("i < j")
        chosen = _sampled(every, sample_pairs).join(sets.select(F.col("id").alias("i"), F.col("g").alias("a")), "i").join(sets.select(F.col("id").alias("j"), F.col("g").alias("b")), "j")
        common = F.size(F.array_intersect("a", "b"))
        total = chosen.agg(F.coalesce(F.sum(F.try_divide(common, F.size("a") + F.size("b") - common)), F.lit(0.0)).alias("total"))
    else:
        # with the space or sign between them, words have four letters or more
        total = jaccard_sum(lambda d: d.select(hashes.alias("h")), df, F.char_length(text) / 4 if tokens is None else F.size(items))
    out = size.crossJoin(total).withColumn("total_possible_pairs", (F.col("num_samples") * (F.col("num_samples") - 1) / 2).cast("long"))
    out = out.withColumn("num_pairs", F.least("total_possible_pairs", F.lit(sample_pairs or 1 << 62)).cast("long"))
    return out.select(F.coalesce(F.try_divide("total", "num_pairs"), F.lit(0.0)).alias("score"), "num_samples", "num_pairs", "total_possible_pairs", F.lit(bool(sample_pairs)).alias("is_sampled"), F.lit("gram" if tokens is None else "token").alias("tokenization_method"), F.lit(n).alias("n"), F.lit(similarity_method).alias("similarity_method"))


def _minhash_sum(sets: DataFrame, num_perm: int, n: int | None = None) -> DataFrame:
    """sets: one column, array<long>, or with n lower-case texts, of whose n-grams few at a time are held. Expected Jaccard sum
    over all pairs, from how often minima agree: no pair is formed."""
    rng = np.random.default_rng(1)
    a, b = (rng.integers(1, 1 << 63, num_perm, dtype=np.uint64) | np.uint64(1) for _ in range(2))

    def lowest(h: np.ndarray) -> np.ndarray:
        low = np.full(num_perm, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, h.size, 1024):
            x = a[:, None] * h[None, k : k + 1024] + b[:, None]
            x ^= x >> np.uint64(31)
            low = np.minimum(low, x.min(axis=1))
        return low.view(np.int64)

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            for k in range(0, f.num_rows, 512):
                each = X.values(f.column(0).slice(k, 512))
                hashes = (gram_hashes(X.WORDS.findall(x), n) if n else np.asarray(x, np.int64) for x in each)
                out = [lowest(h.view(np.uint64)) for h in hashes if h.size]
                flat = np.concatenate(out) if out else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * num_perm, pa.int32()), pa.array(flat))], names=["m"])

    signature = sets.mapInArrow(minima, "m array<long>")
    equal = signature.select(F.posexplode("m").alias("p", "x")).groupBy("p", "x").count()
    return equal.agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2) / num_perm, F.lit(0.0)).alias("total"))


# --- APS -------------------------------------------------------------------------------------------------------------


def _by_dimension(df: DataFrame) -> DataFrame:
    return df.select("id", F.posexplode("v").alias("d", "x"))


def aps(df: DataFrame, similarity_metric: str = "cosine", sample_pairs: int | None = None) -> DataFrame:
    """Average pairwise similarity (for euclidean and manhattan: distance). Linear closed forms but for euclidean. One row."""
    if similarity_metric not in ("cosine", "euclidean", "manhattan", "dot_product", "pearson"):
        raise ValueError(f"unknown metric {similarity_metric}")
    n = df.agg(F.count(F.lit(1)).alias("num_samples"))
    if sample_pairs:
        a, b = df.select(F.col("id").alias("i"), F.col("v").alias("x")), df.select(F.col("id").alias("j"), F.col("v").alias("y"))
        chosen = _sampled(df.select(F.col("id").alias("i")).crossJoin(df.select(F.col("id").alias("j"))).where("i < j"), sample_pairs)
        centred = lambda c: X.bind(V.mean(c), lambda m: F.transform(c, lambda v: v - m))
        x, y = F.col("x"), F.col("y")
        sim = {"cosine": V.cosine, "dot_product": V.dot, "pearson": lambda p, q: V.cosine(centred(p), centred(q))}.get(similarity_metric) or (lambda p, q: V.distance(p, q, similarity_metric))
        total = chosen.join(a, "i").join(b, "j").agg(F.sum(sim(x, y)).alias("total"))
    elif similarity_metric == "euclidean":

        def half(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, apart: bool) -> pd.DataFrame:
            return pd.DataFrame({"s": [euclidean_sum(x, y) / (1 if apart else 2)]})

        size = shape(df)
        left, right = (pack(df, 16384, side, 10, size) for side in "lr")
        # a block meets itself in both orders, another one once
        total = cells(left, right, half, "s double", half=True).agg(F.sum("s").alias("total"))
    elif similarity_metric == "manhattan":
        rank = F.row_number().over(W.partitionBy("d").orderBy("x", "id"))
        total = _by_dimension(df).select(((2 * rank - F.count(F.lit(1)).over(W.partitionBy("d")) - 1) * F.col("x")).alias("t")).agg(F.sum("t").alias("total"))
    else:
        v = F.col("v")
        if similarity_metric == "pearson":
            v = X.bind(V.mean(v), lambda m: F.transform(df["v"], lambda e: e - m))
        if similarity_metric in ("cosine", "pearson"):
            v = X.bind(v, lambda u: X.bind(V.norm(u), lambda r: F.transform(u, lambda e: F.coalesce(F.try_divide(e, r), F.lit(0.0)))))
        unit = df.select("id", v.alias("v"))
        sums = _by_dimension(unit).groupBy("d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
        total = sums.agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2).alias("total"))
    out = n.crossJoin(total).withColumn("total_possible_pairs", (F.col("num_samples") * (F.col("num_samples") - 1) / 2).cast("long"))
    out = out.withColumn("num_pairs", F.least("total_possible_pairs", F.lit(sample_pairs or 1 << 62)).cast("long"))
    return out.select(
        F.coalesce(F.try_divide("total", "num_pairs"), F.lit(0.0)).alias("score"), "num_samples", "num_pairs", "total_possible_pairs", F.lit(bool(sample_pairs)).alias("is_sampled"),
        F.lit(similarity_metric).alias("similarity_metric"), F.when(F.col("num_samples") < 2, F.lit("fewer than two samples")).alias("warning"),
    )


def task2vec(df: DataFrame) -> DataFrame:
    """Mean pairwise cosine distance of per-sample task embeddings. One row."""
    return aps(df, "cosine").select((1 - F.col("score")).alias("score"), "num_samples")


# --- neighbours ------------------------------------------------------------------------------------------------------


def nearest(df: DataFrame, k: int, metric: str = "euclidean", reference: DataFrame | None = None, other_id: bool = True) -> DataFrame:
    """(id, rank, other, d): the k nearest others of each row (ties: the smaller id); with reference, from there (no self)."""

    def near(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, apart: bool = False) -> pd.DataFrame:
        return top_k(i, x, j, y, k, metric, apart)

    if reference is None:  # two blocks meet once, for the rows of both
        size = shape(df)
        left, right = (pack(df, 40960, side, 12, size) for side in "lr")
    else:
        left, right = pack(df, 8192, "l", 48), pack(reference, 65536, "r")
    found = cells(left, right, near, "id long, other long, d double", half=reference is None).groupBy("id")
    pair = F.struct("d", "other")
    best = found.agg(F.array(F.min(pair)).alias("best")) if k == 1 else found.agg(F.slice(F.sort_array(F.collect_list(pair)), 1, k).alias("best"))
    return best.select("id", F.posexplode("best").alias("r", "x")).select("id", (F.col("r") + 1).alias("rank"), F.col("x.other").alias("other"), F.col("x.d").alias("d"))


def knn(df: DataFrame, k: int = 5, distance_metric: str = "euclidean") -> DataFrame:
    """(id, score): mean distance to the k nearest others (to all others, if there are fewer); a lone row has none."""
    return nearest(df, k, distance_metric).groupBy("id").agg(F.avg("d").alias("score"))


def miwv(df: DataFrame, losses: DataFrame, distance_metric: str = "cosine") -> DataFrame:
    """(id, score, most_similar_id): loss with the nearest neighbour as example, less the loss without one.

    losses: (id, zero_shot, one_shot), one_shot measured with that neighbour as the example.
    """
    best = nearest(df, 1, distance_metric).select("id", F.col("other").alias("most_similar_id"))
    return best.join(losses, "id").select("id", (F.col("one_shot") - F.col("zero_shot")).alias("score"), "most_similar_id")


def facility_location(full: DataFrame, subset: DataFrame, distance_metric: str = "euclidean") -> DataFrame:
    """Sum over all rows of the distance to the nearest subset row, with its statistics. One row."""

    def low(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"id": i, "row": np.arange(len(i)), "d": distances(x, y, distance_metric).min(axis=1)})

    each = block_pairs(full, subset, low, "id long, row long, d double").groupBy("id").agg(F.min("d").alias("d"))
    stats = each.agg(F.sum("d").alias("facility_location_score"), F.avg("d").alias("avg_min_distance"), F.max("d").alias("max_min_distance"), F.percentile("d", 0.5).alias("median_min_distance"), F.stddev_pop("d").alias("std_min_distance"), F.count(F.lit(1)).alias("num_samples"))
    return stats.crossJoin(subset.agg(F.count(F.lit(1)).alias("num_subset_samples"))).withColumn("distance_metric", F.lit(distance_metric)).withColumn("subset_ratio", F.try_divide("num_subset_samples", "num_samples"))
