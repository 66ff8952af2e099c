"""NovelSum: novelty from distances weighted by local density and inverse rank."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.blocks import TILE, pack, shape, strips, unit
from quern.operators.pairwise import nearest


def _name(nb: int, dp: float, q: float) -> str:
    return f"neighbor_{nb}_density_{dp:g}_distance_{q:g}"


def novel_sum(df: DataFrame, reference: DataFrame | None = None, density_powers: Sequence[float] = (0, 0.25, 0.5), neighbors: Sequence[int] = (5, 10), distance_powers: Sequence[float] = (0, 1, 2), eps: float = 1e-10) -> DataFrame:
    """One row: num_samples, cos_distance and a score for each combination.

    The density factor of a sample is 1 / (mean cosine distance to its nearest reference samples, itself left out, + eps) **
    power. Each row's distances to the others, times their factors, are sorted and averaged with weights 1 / rank ** power.
    """
    near = nearest(df, max(neighbors), "cosine", reference)
    means = near.groupBy("id").agg(*[F.avg(F.when(F.col("rank") <= nb, F.col("d"))).alias(f"m{nb}") for nb in neighbors])
    combos = [(nb, dp) for nb in neighbors for dp in density_powers]
    factors = means.select("id", F.array(*[F.pow(F.greatest(F.col(f"m{nb}"), F.lit(0.0)) + eps, F.lit(-float(dp))) for nb, dp in combos]).alias("rho"))
    k, n, width = len(combos), *shape(df)
    # the factors travel at the end of the vectors
    right = df.join(factors, "id").select("id", F.concat("v", "rho").alias("v"))
    names = [_name(nb, dp, q) for nb, dp in combos for q in distance_powers]

    def scores(i: np.ndarray, x: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """A row of each of x against all others; of the distances only those of a few rows at a time are held."""
        j = np.concatenate([ids for ids, _ in others])
        order = np.argsort(j, kind="stable")
        place = np.empty(len(j), np.int64)
        place[order] = np.arange(len(j))
        j, x, yt, rho, at = j[order], unit(x), np.empty((x.shape[1], len(j))), np.empty((k, len(j))), 0
        for ids, y in others:
            own = place[at : at + len(ids)]
            yt[:, own], rho[:, own] = unit(y[:, :-k]).T, y[:, -k:].T
            at += len(ids)
        rank = np.arange(1, len(j) + 1, dtype=float)
        weights = np.array([rank ** -float(q) for q in distance_powers])
        totals = weights.cumsum(axis=1)
        first, last = np.searchsorted(j, i, "left"), np.searchsorted(j, i, "right")
        step = max(1, TILE // (8 * len(j)))
        for at in range(0, len(i), step):
            d = 1 - x[at : at + step] @ yt
            own = range(at, at + len(d))
            valid = len(j) - (last[own] - first[own])
            for r, a in enumerate(own):
                d[r, first[a] : last[a]] = 0
            out, done = {"d": d.sum(axis=1), "n": valid}, {}
            for c, (nb, dp) in enumerate(combos):
                if (nb * (dp != 0), dp) not in done:  # without density, neighbours don't matter
                    s = d * rho[c]
                    for r, a in enumerate(own):
                        s[r, first[a] : last[a]] = np.inf
                    s.sort(axis=1)
                    done[nb * (dp != 0), dp] = [[float(w[:m] @ s[r, :m] / t[m - 1]) if m else 0.0 for r, m in enumerate(valid)] for w, t in zip(weights, totals, strict=True)]
                out |= {_name(nb, dp, q): v for q, v in zip(distance_powers, done[nb * (dp != 0), dp], strict=True)}
            yield pa.RecordBatch.from_pydict({"d": out["d"], "n": out["n"], **{x: pa.array(out[x], pa.float64()) for x in names}})

    schema = ", ".join(["d double", "n long", *[f"`{x}` double" for x in names]])
    each = strips(pack(df, 8192, "l", 48, (n, width)), pack(right, 65536, "r", 1, (n, width + k), one=True), scores, schema)
    return each.agg(F.count(F.lit(1)).alias("num_samples"), F.coalesce(F.try_divide(F.sum("d"), F.sum("n")), F.lit(0.0)).alias("cos_distance"), *[F.avg(f"`{x}`").alias(x) for x in names])
