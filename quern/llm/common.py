"""Shared pieces: the shared folder, shipping code to workers, vectorised word hashing, connected components."""

from __future__ import annotations

import ctypes
import io
import re
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_shipped: set[str] = set()
_written: dict[int, tuple[weakref.ref, str]] = {}


# --- session helpers -------------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which every executor sees; where that is unset, a local one in local mode and
    an error on a cluster. clean_up() removes all that an application wrote."""
    return f"{_home(spark)}/{uuid.uuid4().hex}"


def _home(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="quern-shared-")).as_uri()
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quern-{sc.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Removes what this application wrote to the shared folder; DataFrames that read it can no longer be used."""
    _delete(spark, _home(spark))


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialise() wrote for df, which nothing reads any more; does nothing to other DataFrames."""
    ref, path = _written.pop(id(df), (None, ""))
    if ref is not None and ref() is df:
        _delete(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Gives the workers this package (functions are pickled by reference)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = Path(tempfile.mkdtemp(prefix="quern-code-")) / "quern_code.zip"  # on the driver, which serves it to the executors
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


class Sieve:
    """A Bloom filter of 64-bit keys, built in the cluster: `each` bits a key, but `most` bits in all (so what is broadcast is
    bounded: 32 MB by default); beyond that more keys that aren't in it seem to be. Three bits of one 64-bit word are set."""

    def __init__(self, keys: DataFrame, column: str, each: int = 16, most: int = 1 << 28):
        n = keys.count()
        self.log = max(7, min(max(each * n, 1 << 12) - 1, most - 1).bit_length()) - 6  # of the number of words
        bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {at}) & 63 as int))" for at in (0, 6, 12))
        pairs = keys.selectExpr(f"shiftrightunsigned(`{column}`, {64 - self.log}) as word", f"{bits} as bits")
        got = pairs.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words = np.zeros(1 << self.log, U64)
        self.words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(U64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys (U64) that aren't in it."""
        one = U64(1)
        bits = one << (keys & U64(63)) | one << (keys >> U64(6) & U64(63)) | one << (keys >> U64(12) & U64(63))
        return self.words[(keys >> U64(64 - self.log)).astype(np.int64)] & bits == bits


def sift(df: DataFrame, key: Column, keys: DataFrame, column: str, **params) -> tuple[DataFrame, DataFrame]:
    """df's rows that surely have no key in keys, and all others. Nothing is shuffled, and only `key` goes to Python."""
    sent = df.sparkSession.sparkContext.broadcast(Sieve(keys, column, **params))

    @F.pandas_udf("boolean")
    def holds(x: pd.Series) -> pd.Series:
        return pd.Series(sent.value.holds(x.to_numpy(np.int64).view(U64)))

    return df.where(~holds(key)), df.where(holds(key))


def fresh(name: str, columns: list[str]) -> str:
    """A column name that doesn't clash with columns (compared as Spark does, without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fields(df: DataFrame, names: list[str]) -> dict[str, object]:
    return {n: df.schema[n].dataType for n in names}


# --- vectorised text -------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE = mix(np.arange(256, dtype=U64))
PLACE = mix(np.arange(1000, 1256, dtype=U64)) | U64(1)
GRAM = mix(np.arange(5000, 5512, dtype=U64)) | U64(1)

#: What parts words: ASCII white space; and for normalised words, all ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings and where each begins (one offset more than strings); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return all_bytes[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What a worker keeps between tasks, by owner: how to drop it.
KEPT: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    """Freed memory goes back to the system, which workers that are used again would hold on to."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, rows: int = 60_000, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text each (a longer text is a slice of its own). What others than owner
    kept in this worker is dropped, and memory is given back at the end."""
    for name, drop in KEPT.items():
        if name != owner:
            drop()
    for batch in batches:
        _, at = text_bytes(batch.column(column))
        start, n = 0, batch.num_rows
        while start < n:
            end = int(np.searchsorted(at, at[start] + most, "right")) - 1
            end = min(max(end, start + 1), start + rows, n)
            yield batch.slice(start, end - start)
            start = end
    _give_back()


def words(data: np.ndarray, at: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word and the index of its string."""
    inside = ~parts[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin = at[:-1][at[:-1] < data.size]
    first[begin] = inside[begin]
    end = at[1:][at[1:] > 0] - 1
    last[end] = inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, the same everywhere."""
    if not starts.size:
        return np.zeros(0, U64)
    lengths = ends - starts
    base = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum()), dtype=np.int64)
    place -= np.repeat(base, lengths)
    own = data[place + np.repeat(starts, lengths)]
    with np.errstate(over="ignore"):
        value = BYTE[own] * PLACE[place & 255]
        if lengths.max() > 256:
            value += (place >> 8).astype(U64) * BYTE[own ^ 0xA5]
        return mix(np.add.reduceat(value, base) + lengths.astype(U64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = h.size - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for j in range(k):
            out += h[j : j + n] * GRAM[j % 512]
        return mix(out)


# --- all pairs within a group as a forest ----------------------------------------------------------------------------


class Forest:
    """Union-find over 0..n-1; edges() are the unions made, which connect what all close pairs connect."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def labels(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                self.parent = q
                return q
            p = q

    def join(self, close: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Takes in a block: close[i, j] tells whether rows[i] and columns[j] are near."""
        while True:
            label = self.labels()
            open_ = close & (label[rows][:, None] != label[columns][None, :])
            hit = np.flatnonzero(open_.any(axis=1))
            if not hit.size:
                return
            for i, j in zip(rows[hit].tolist(), columns[open_[hit].argmax(axis=1)].tolist(), strict=True):
                a, b = self.find(i), self.find(j)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    self.kept.append((i, j))

    def join_pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """Takes in near pairs (i, j)."""
        while i.size:
            label = self.labels()
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
            _, first = np.unique(i, return_index=True)
            for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
                a, b = self.find(x), self.find(y)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
                    self.kept.append((x, y))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys (never null), each group whole even where it spans batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


# --- connected components --------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for undirected edges (a, b) of any orderable type.

    Alternates large-star and small-star steps until nothing changes. Each round is written to the shared folder. Nodes
    without edges don't appear; self-loops are ignored.
    """
    now = materialise(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: every edge points from the larger to the smaller node
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        last, now = now, materialise(small)
        discard(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(state):
            break
        seen = tuple(state)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
