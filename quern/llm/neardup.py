"""Embedding near-dedup: random-hyperplane hashing in several tables, exact cosine verification, connected components.

In each of `tables` tables a vector's bucket is the signs of its products with `bits` random hyperplanes. All vectors of a
bucket are compared exactly; those with a cosine of at least `threshold` are near. A bucket reports a spanning forest of its
near pairs; distributed connected components over all of them give the groups. Vectors that are equal bit by bit are compared
once. A bucket beyond `block` distinct vectors is parted into blocks, every pair of which is a task of its own, so that a hot
bucket neither fills a task's memory nor drops a pair.

Unless given, `bits` grows with the logarithm of the table, so that buckets of unlike vectors keep their size (1,000 to 2,000
vectors, or fewer in small tables), and `tables` is as many as the share `recall` of pairs at the threshold needs: at cosine
0.9, 12 tables of 10 bits up to two million vectors, 20 of 13 bits at 16 million, 53 of 19 bits at a billion.

Nulls and edge cases: null, empty and zero vectors and those with null, NaN or infinite parts are in no group; vectors of
different widths are never near; a null id orders last and is no neighbour's id; rows that agree in id and vector are one;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Forest, components, materialise, ship, sorted_groups


def _planes(width: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, tables * bits)).astype(np.float32)


def _unit(vectors: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def plan(n: int, threshold: float, recall: float = 0.94) -> tuple[int, int]:
    """(tables, bits) for n vectors."""
    if not 0 < threshold:
        raise ValueError("the threshold must be above 0")
    bits = max(10, math.ceil(math.log2(max(n, 1))) - 11)
    share = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits  # of pairs at the threshold, in one table
    return (1 if share >= recall else math.ceil(math.log1p(-recall) / math.log1p(-share))), bits


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lists = batch.column("id"), batch.column("v")
        values = lists.flatten()
        bad = pc.fill_null(pc.invert(pc.is_finite(values)), True).to_numpy(zero_copy_only=False)
        number = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False) + 0.0  # no negative zero
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        for width in np.unique(size[size > 0]).tolist():
            rows = np.flatnonzero(size == width)
            place = end[rows][:, None] - width + np.arange(width)
            x = number[place]
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.linalg.norm(x, axis=1)
            good = ~bad[place].any(axis=1) & np.isfinite(norm) & (norm > 0)
            raw = np.ascontiguousarray(x[good], "<f8").tobytes()
            offsets = np.arange(int(good.sum()) + 1, dtype=np.int64) * width * 8
            vec = pa.Array.from_buffers(pa.large_binary(), offsets.size - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[good])), vec.cast(pa.binary())], ["id", "vec"])


def _buckets(tables: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = 1 << np.arange(bits, dtype=np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, 4000):
                batch = whole.slice(a, 4000)
                vectors = batch.column("vec").to_pylist()
                widths = np.array([len(v) // 8 for v in vectors])
                for width in np.unique(widths).tolist():
                    rows = np.flatnonzero(widths == width)
                    p = planes.setdefault(width, _planes(width, tables, bits, seed))
                    signs = _unit([vectors[i] for i in rows]).astype(np.float32) @ p > 0
                    code = signs.reshape(len(rows), tables, bits) @ weight
                    vec = batch.column("vec").take(pa.array(rows))
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), (width << 8) | t)), pa.array(code[:, t].astype(np.int64)), vec], ["tab", "code", "vec"])

    return run


def near_forest(first: np.ndarray, second: np.ndarray | None, threshold: float, step: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of unit rows at or above threshold: within first, or between first and second."""
    every = first if second is None else np.concatenate([first, second])
    forest = Forest(len(every))
    for a in range(0, len(first), step):
        for b in range(a if second is None else len(first), len(every), step):
            x, y = every[a : min(a + step, len(first))], every[b : b + step]
            close = x @ y.T >= threshold - 1e-12
            if close.any():
                forest.join(close, np.arange(a, a + len(x)), np.arange(b, b + len(y)))
    return forest.kept


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["tab", "code", "p", "q"]):
            if group.num_rows < 2:
                continue
            side = group.column("side").to_numpy()
            vectors = group.column("vec").to_pylist()
            order = [*np.flatnonzero(side == 0).tolist(), *np.flatnonzero(side == 1).tolist()]
            n = int((side == 0).sum())
            unit = _unit([vectors[i] for i in order])
            same = group.column("p")[0].as_py() == group.column("q")[0].as_py()
            pairs = near_forest(unit[:n], None if same else unit[n:], threshold)
            yield pa.RecordBatch.from_arrays([pa.array([vectors[order[i]] for i, _ in pairs], pa.binary()), pa.array([vectors[order[j]] for _, j in pairs], pa.binary())], ["a", "b"])

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, tables: int | None = None, bits: int | None = None, recall: float = 0.94, seed: int = 7, block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, kept_vec_id): each vector that goes, beside the smallest id of its group, which stays."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    vectors = materialise(rows.mapInArrow(_clean, "id long, vec binary").distinct())
    each = vectors.select("vec").distinct()
    if tables is None or bits is None:
        more, wide = plan(each.count(), threshold, recall)
        bits = wide if bits is None else bits
        tables = more if tables is None else tables
    codes = each.mapInArrow(_buckets(tables, bits, seed), "tab long, code long, vec binary")
    sizes = materialise(codes.groupBy("tab", "code").count().where("count > 1").select("tab", "code", F.ceil(F.col("count") / block).cast("int").alias("parts")))
    placed = codes.join(sizes, ["tab", "code"]).withColumn("at", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int"))
    # block pairs p <= q: a row of block i is on the left of (i, q) and on the right of (p, i)
    tasks = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = tasks.select("tab", "code", F.least("at", "o").alias("p"), F.greatest("at", "o").alias("q"), (F.col("at") > F.col("o")).cast("int").alias("side"), "vec")
    edges = tasks.repartition("tab", "code", "p", "q").sortWithinPartitions("tab", "code", "p", "q").mapInArrow(_compare(threshold), "a binary, b binary")
    roots = components(edges)
    every = vectors.join(roots, vectors["vec"] == roots["node"], "left").select("id", F.coalesce("root", "vec").alias("root"), "vec")
    first = every.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "vec")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = every.join(first, "root").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("vec") == F.col("first.vec"))))
    return gone.select(F.col("id").alias("vec_id"), F.col("first.id").alias("kept_vec_id"))
