"""Radius, log-determinant, Vendi score and the spectrum of matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.blocks import block_pairs, distances


def radius(df: DataFrame) -> DataFrame:
    """Geometric mean of the dimensions' standard deviations (population; zero counts as 1e-10). One row."""
    each = df.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.stddev_pop("x").alias("raw")).withColumn("s", F.when(F.col("raw") == 0, F.lit(1e-10)).otherwise(F.col("raw")))
    out = each.agg(
        F.exp(F.avg(F.log("s"))).alias("radius"), F.avg("s").alias("arithmetic_mean_std"), F.min("s").alias("min_std"), F.max("s").alias("max_std"), F.percentile("s", 0.5).alias("median_std"),
        F.count(F.lit(1)).alias("embedding_dimension"), F.count_if(F.col("raw") == 0).alias("zero_std_dimensions"),
    )
    return out.withColumn("geometric_mean_std", F.col("radius")).crossJoin(df.agg(F.count(F.lit(1)).alias("num_samples")))


def gram(df: DataFrame, transform: str = "unit") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, X'X, column sums of X) with X's rows made unit, centred and unit ('pearson') or left ('raw').

    Summed in the tasks, then by (i, j); only D x D numbers come to the driver.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, s, n = None, None, 0
        for f in frames:
            if not len(f):
                continue
            x = np.array([np.asarray(v, float) for v in f["v"]])
            if transform == "pearson":
                x = x - x.mean(axis=1, keepdims=True)
            if transform != "raw":
                r = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, r, out=np.zeros_like(x), where=r > 0)
            g, s, n = (x.T @ x + (0 if g is None else g)), (x.sum(axis=0) + (0 if s is None else s)), n + len(x)
        if g is not None:
            d = len(g)
            i, j = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({"i": np.concatenate([i, np.full(d, -1), [-2]]), "j": np.concatenate([j, np.arange(d), [0]]), "x": np.concatenate([g.ravel(), s, [float(n)]])})

    rows = df.select("v").mapInPandas(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    if not len(rows):
        return 0, np.zeros((0, 0)), np.zeros(0)
    d = int(rows["j"].max()) + 1
    g, s, n = np.zeros((d, d)), np.zeros(d), 0
    for i, j, x in rows.itertuples(index=False):
        if i == -2:
            n = round(x)
        elif i == -1:
            s[j] = x
        else:
            g[i, j] = x
    return n, (g + g.T) / 2, s


def _full(df: DataFrame, similarity: str, most: int) -> np.ndarray:
    """The N x N similarity, for metrics without a short form; refuses more than `most` rows."""
    rows = df.orderBy("id").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"{similarity} needs all pairs in memory: more than {most} samples")
    x = np.array([np.asarray(v, float) for v in rows["v"]])
    return 1 / (1 + distances(x, x, similarity))


def vendi(df: DataFrame, similarity_metric: str = "cosine", most: int = 5000) -> DataFrame:
    """exp of the entropy of the similarity matrix's eigenvalues. One row.

    cosine, pearson and dot_product take the D x D Gram matrix, whose eigenvalues are the same; euclidean and manhattan use
    1 / (1 + distance) over all pairs, for at most `most` samples.
    """
    if similarity_metric in ("euclidean", "manhattan"):
        k = _full(df, similarity_metric, most)
        n = len(k)
    else:
        n, k, _ = gram(df, {"cosine": "unit", "pearson": "pearson", "dot_product": "raw"}[similarity_metric])
    e = np.clip(np.linalg.eigvalsh(k), 0, None) if n else np.zeros(0)
    p = e[e > 1e-12 * max(e.sum(), 1e-300)] / max(e.sum(), 1e-300)
    score = float(np.exp(-(p * np.log(p)).sum())) if n else 0.0
    return df.sparkSession.createDataFrame([(score, n, similarity_metric)], "vendi_score double, num_samples long, similarity_metric string")


def log_det(df: DataFrame, ridge_alpha: float = 1e-10, extremes: bool = True) -> DataFrame:
    """slogdet(S + ridge_alpha I) of the N x N cosine similarity S, from the D x D Gram matrix, with statistics of S. One row.

    Only S's smallest and largest value take all pairs: without extremes they are null, and the rest is linear in the rows.
    """
    n, g, s = gram(df)
    e = np.linalg.eigvalsh(g) if n else np.zeros(0)
    e = np.clip(np.where(np.abs(e) < 1e-9 * max(n, 1), 0, e), 0, None)
    top = np.sort(e)[::-1][:n]  # S has these eigenvalues and zeros up to n
    value = float(np.log(top + ridge_alpha).sum() + max(n - len(top), 0) * np.log(ridge_alpha)) if n else 0.0

    def ends(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        sim = 1 - distances(x, y, "cosine")
        return pd.DataFrame({"lo": [float(sim.min())], "hi": [float(sim.max())]})

    low, high = block_pairs(df, df, ends, "lo double, hi double").agg(F.min("lo"), F.max("hi")).first() if n and extremes else (None, None)
    mean = float((s**2).sum() / n**2) if n else 0.0
    std = float(np.sqrt(max((g**2).sum() / n**2 - mean**2, 0))) if n else 0.0
    rank = int((top > 0).sum())
    row = (value, 1.0 if n else 0.0, bool(np.isfinite(value)), bool(n and rank == n), True, (float(top.min()) if rank == n and n else 0.0, float(top.max()) if n else 0.0, 0), (low, high, mean, std), n, "similarity matrix is singular" if n and rank < n else None, bool(np.isinf(value)))
    schema = "log_det double, sign double, is_valid boolean, is_positive_definite boolean, is_positive_semidefinite boolean, eigenvalue_stats struct<min:double,max:double,num_negative:int>, similarity_matrix_stats struct<min:double,max:double,mean:double,std:double>, num_samples long, warning string, log_det_is_inf boolean"
    return df.sparkSession.createDataFrame([row], schema)


# --- spectra of matrices ---------------------------------------------------------------------------------------------


def _singular(m) -> np.ndarray:
    rows = [np.asarray(r, float) for r in m] if m is not None else []
    return np.linalg.svd(np.array(rows), compute_uv=False) if rows and len(rows[0]) else np.zeros(0)


def spectrum_score(matrix: Column, kind: str, max_rows: int = 512, strategy: str = "tail", eps: float = 1e-10) -> Column:
    """'effective_rank' exp(entropy), 'nuclear_norm' sum, 'svd_entropy' entropy of an array<array<double>>'s singular values.

    svd_entropy takes at most max_rows rows, the last ones ('tail') or evenly spread ones ('uniform'). Empty or failing: 0.
    """

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        out = []
        for m in s:
            try:
                if kind == "svd_entropy" and m is not None and len(m) > max_rows:
                    m = m[-max_rows:] if strategy == "tail" else [m[i] for i in np.linspace(0, len(m) - 1, max_rows).astype(int)]
                v = _singular(m)
                if kind == "nuclear_norm":
                    out.append(float(v.sum()))
                    continue
                p = v / v.sum() if v.sum() > 0 else np.zeros(0)
                if kind == "effective_rank":
                    q = p[p > 0]
                    out.append(float(np.exp(-(q * np.log(q)).sum())) if len(q) else 0.0)
                else:
                    out.append(float(-(p * np.log(p + eps)).sum()) if len(p) else 0.0)
            except (ValueError, np.linalg.LinAlgError):
                out.append(0.0)
        return pd.Series(out, dtype="float64")

    return score(matrix)


def per_projection(df: DataFrame, kind: str, projections: tuple[str, ...] = ("Q", "K", "V", "O")) -> DataFrame:
    """(id, one column per projection): mean over layers; df (id, layer, projection, m)."""
    each = df.select("id", "projection", spectrum_score(F.col("m"), kind).alias("x"))
    got = each.groupBy("id").pivot("projection", list(projections)).agg(F.avg("x"))
    return got.select("id", *[F.coalesce(F.col(p), F.lit(0.0)).alias(p) for p in projections])
