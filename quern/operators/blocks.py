"""Block nested loops over vectors: all pairs of two frames without a broadcast and without a row per pair.

Each side is packed once into blocks, each one binary row in a partition of its own; a task gets a left block and a right one (or
all), and NumPy returns only what the caller reduces them to (a minimum, a top-k, a sum). So what is shuffled grows with the rows,
and a task holds two blocks, whatever the size of the frames; the time is quadratic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Reduce = Callable[..., pd.DataFrame]

#: Bytes of a block's vectors at most; of a tile of distances. Pairs of which one block's rows may be near, held at a time.
BLOCK, TILE, KEPT = 1 << 25, 1 << 25, 1 << 20


def rows_of(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if len(column) and (len(flat) % len(column) or (np.diff(column.offsets) != len(flat) // len(column)).any()):
        raise ValueError("vectors of unequal length")
    return flat.reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b, ids, vs = [], [], []
    for x in batches:
        if x.num_rows:
            b.append(x.column(0).to_numpy())
            ids.append(x.column(1).to_numpy())
            vs.append(rows_of(x.column(2)))
    if not b:
        return
    if len({v.shape[1] for v in vs}) > 1:
        raise ValueError("vectors of unequal length")
    id_, v = np.concatenate(ids), np.concatenate(vs)
    order = np.argsort(id_, kind="stable")
    step = max(1, BLOCK // (8 * v.shape[1]))  # equal rows share a block, however many they are
    for k in range(0, len(order), step):
        at = order[k : k + step]
        yield pa.RecordBatch.from_arrays([pa.array(b[0][:1]), pa.array([id_[at].tobytes()], pa.binary()), pa.array([v[at].tobytes()], pa.binary())], ["b", "ids", "vs"])


def shape(df: DataFrame) -> tuple[int, int]:
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    return n, max(width or 1, 1)


def pack(df: DataFrame, rows: int, prefix: str, least: int = 1, size: tuple[int, int] | None = None, one: bool = False) -> DataFrame:
    """df (id long, v array<double>) as blocks (b, ids, vs) of about `rows` rows, at least `least` of them (of 256 rows or more),
    each in a partition of its own (one: all in the same); equal ids may repeat. size: rows and width, where they are known."""
    n, width = size or shape(df)
    rows = max(1, min(rows, BLOCK // (8 * width)))
    blocks = max(1, -(-n // rows), min(least, n // 256))
    part = df.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("b"), "id", "v")
    packed = part.repartitionById(blocks, "b").mapInArrow(_pack, "b int, ids binary, vs binary")
    packed = packed.repartition(1) if one else packed.repartitionById(blocks, "b")
    return packed.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("b", "ids", "vs")])


def _block(ids: pa.Scalar, vs: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids.as_buffer(), np.int64)
    return i, np.frombuffer(vs.as_buffer(), float).reshape(len(i), -1)


def cells(left: DataFrame, right: DataFrame, reduce: Reduce, schema: str, half: bool = False) -> DataFrame:
    """reduce(ids, vectors, ids, vectors) of each pair of packed blocks; half: of those whose left number isn't the greater one,
    and reduce is told last whether the numbers differ (parts of one number meet in both orders)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            for lb, li, lv, rb, ri, rv in zip(*[f.column(f"{side}_{c}") for side in "lr" for c in ("b", "ids", "vs")], strict=True):
                got = reduce(*_block(li, lv), *_block(ri, rv), *[lb != rb] * half)
                yield from pa.Table.from_pandas(got, preserve_index=False).to_batches()

    both = left.hint("shuffle_replicate_nl").crossJoin(right)
    return (both.where("l_b <= r_b") if half else both).mapInArrow(run, schema)


def strips(left: DataFrame, right: DataFrame, reduce: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """reduce(ids, vectors, [(ids, vectors), ...]) of each packed left block and all blocks of right, which was packed into one
    partition: a task holds all of right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, others = None, []

        def strip() -> Iterator[pa.RecordBatch]:
            return reduce(*_block(*own), others)

        for f in batches:
            for li, lv, ri, rv in zip(*[f.column(c) for c in ("l_ids", "l_vs", "r_ids", "r_vs")], strict=True):
                if own and (own[0] != li or own[1] != lv):
                    yield from strip()
                    others = []
                own = li, lv
                others.append(_block(ri, rv))
        if own:
            yield from strip()

    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, schema)


def block_pairs(left: DataFrame, right: DataFrame, reduce: Reduce, schema: str, rows: int = 512) -> DataFrame:
    """reduce of each tile of rows x rows pairs."""

    def tiles(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        return pd.concat([reduce(i[a : a + rows], x[a : a + rows], j[b : b + rows], y[b : b + rows]) for a in range(0, len(i), rows) for b in range(0, len(j), rows)], ignore_index=True)

    return cells(pack(left, 8192, "l", 48), pack(right, 8192, "r"), tiles, schema)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Pairwise distances; zero vectors have cosine distance 1."""
    if metric == "cosine":
        return 1 - unit(a) @ unit(b).T
    if metric == "manhattan":
        return np.array([np.abs(b - x).sum(axis=1) for x in a]).reshape(len(a), len(b))
    if metric in ("euclidean", "squared_euclidean"):
        d = np.array([((b - x) ** 2).sum(axis=1) for x in a]).reshape(len(a), len(b))
        return np.sqrt(d) if metric == "euclidean" else d
    raise ValueError(f"unknown metric {metric}")


def exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of x's rows to y's, one to one, term after term as SQL adds them: equal pairs of vectors have equal distances."""
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)

    def total(a: np.ndarray) -> np.ndarray:
        return np.add.accumulate(a, axis=0, out=a)[-1]

    if metric == "cosine":
        n = np.sqrt(total(x * x)) * np.sqrt(total(y * y))
        return 1 - np.divide(total(x * y), n, out=np.zeros_like(n), where=n > 0)
    return total(np.abs(x - y)) if metric == "manhattan" else np.sqrt(total((x - y) ** 2))


def euclidean_sum(x: np.ndarray, y: np.ndarray) -> float:
    """Sum of all distances of x's rows to y's. Products give their squares; what they don't give well is computed apart."""
    mean = y.mean(axis=0)
    x, y = x - mean, y - mean
    total, yy = 0.0, (y * y).sum(axis=1)
    step = max(1, min(256, TILE // (8 * len(y))))
    for k in range(0, len(x), step):
        a = x[k : k + step]
        size = (a * a).sum(axis=1)[:, None] + yy
        d = a @ y.T
        d *= -2
        d += size
        size *= 1e-5
        r, c = np.nonzero(~(d > size))
        np.sqrt(np.maximum(d, 0, out=d), out=d)
        for m in range(0, len(r), 1 << 16):
            p, q = r[m : m + (1 << 16)], c[m : m + (1 << 16)]
            d[p, q] = exact(a[p], y[q], "euclidean")
        total += float(d.sum())
    return total


def _tiles(x: np.ndarray, y: np.ndarray, metric: str) -> tuple[Callable[[slice, slice], np.ndarray], tuple[int, int], np.ndarray, np.ndarray]:
    """tile(rows, columns): something that grows with their distances, overwritten by the next call; rows and columns of a tile;
    how far that may be off for each row of x, and for each row of y."""
    kind = np.float32 if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < 1e15 else float
    off = (y.shape[1] + 8) * float(np.finfo(kind).eps)
    if metric == "cosine":
        x, y = unit(x), unit(y)
    else:
        mean = y.mean(axis=0)
        x, y = x - mean, y - mean
    most = (256, 2048) if metric == "manhattan" else (512, 512)  # in a core's cache
    room = np.empty(most[0] * most[1], kind)
    if metric == "manhattan":
        # |a - b| = 2 max(a, b) - a - b
        sizes = [np.abs(v).sum(axis=1) for v in (x, y)]
        xs, ys = x.sum(axis=1).astype(kind), y.sum(axis=1).astype(kind)
        x1, yt, buffer = x.astype(kind), np.ascontiguousarray(y.T.astype(kind)), np.empty((y.shape[1], most[1]), kind)

        def tile(rows: slice, columns: slice) -> np.ndarray:
            a, part = x1[rows], np.ascontiguousarray(yt[:, columns])
            out, larger = room[: len(a) * part.shape[1]].reshape(len(a), -1), buffer[:, : part.shape[1]]
            for r in range(len(a)):
                np.maximum(part, a[r][:, None], out=larger)
                np.add.reduce(larger, axis=0, out=out[r])
            out *= 2
            out -= ys[columns]
            out -= xs[rows, None]
            return out

        return tile, most, *[2 * off * (own + other.max(initial=0)) for own, other in (sizes, sizes[::-1])]
    squares = [(v * v).sum(axis=1) for v in (x, y)]
    if metric == "cosine":
        a, b = -x.astype(kind), y.astype(kind)
    else:  # the squares come with the products
        a, b = (np.column_stack(v).astype(kind) for v in ((-2 * x, squares[0], np.ones(len(x))), (y, np.ones(len(y)), squares[1])))

    def tile(rows: slice, columns: slice) -> np.ndarray:
        p, q = a[rows], b[columns].T
        return np.matmul(p, q, out=room[: len(p) * q.shape[1]].reshape(len(p), -1))

    return tile, most, *[off * (np.sqrt(own) + np.sqrt(other.max(initial=0))) ** 2 for own, other in (squares, squares[::-1])]


class _Nearest:
    """The k of y nearest to each row of x, from tiles of rough distances that may be off by so much: what these can't exclude is
    computed exactly, some at a time."""

    def __init__(self, i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, k: int, metric: str, off: np.ndarray):
        self.i, self.x, self.j, self.y, self.k, self.metric, self.off = i, x, j, y, k, metric, off
        self.low = np.full((len(i), k), np.inf)  # the k-th isn't under the k-th smallest so far
        self.limit = np.full(len(i), np.inf)
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.kept, self.count = [], 0

    def add(self, row: int, column: int, least: np.ndarray, take: Callable[[np.ndarray], np.ndarray]) -> None:
        """A tile from that row and column on: the least of each row, and how to get some of its rows."""
        near = np.flatnonzero(least <= self.limit[row : row + len(least)])
        if not near.size:
            return
        part, at = take(near), row + near
        low = self.low[at]
        if part.shape[1] >= self.k and np.isinf(low).all():
            low = np.partition(part, self.k - 1, axis=1)[:, : self.k]
        else:
            low = np.sort(np.column_stack([low, least[near]]), axis=1)[:, : self.k]
        self.low[at] = low
        self.limit[at] = np.minimum(self.limit[at], low.max(axis=1) + self.off[at])
        r, c = np.divmod(np.flatnonzero((part <= self.limit[at].astype(part.dtype)[:, None]) & (part < np.inf)), part.shape[1])
        self.kept.append((at[r], c + column, part[r, c]))
        self.count += len(r)
        if self.count > KEPT:
            self.settle()

    def settle(self) -> None:
        if not self.kept:
            return
        r, c, rough = (np.concatenate(v) for v in zip(*self.kept, strict=True))
        at = np.flatnonzero(rough <= self.limit[r])
        found = [self.best]
        for m in range(0, len(at), 4096):
            p, q = r[at[m : m + 4096]], c[at[m : m + 4096]]
            d = exact(self.x[p], self.y[q], self.metric)
            found.append((p, q, d**2 if self.metric == "squared_euclidean" else d))
        r, c, d = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((self.j[c], d, r))
        r, c, d = r[order], c[order], d[order]
        keep = (np.arange(len(r)) - np.searchsorted(r, r, "left") < self.k) & np.isfinite(d)
        self.best, self.kept, self.count = (r[keep], c[keep], d[keep]), [], 0

    def frame(self) -> pd.DataFrame:
        self.settle()
        r, c, d = self.best
        return pd.DataFrame({"id": self.i[r], "other": self.j[c], "d": d})


def top_k(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, k: int, metric: str, both: bool = False) -> pd.DataFrame:
    """(id, other, d): the k of y nearest to each row of x, but none of its id; ties: the smaller id. j is sorted. both: also the
    k of x nearest to each row of y, by the same tiles.

    Quick arithmetic excludes nearly all; the distances of those it can't exclude are computed exactly. Distances that aren't
    finite don't count."""
    if metric not in ("cosine", "euclidean", "squared_euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric}")
    fine = [np.isfinite(v).all(axis=1) for v in (x, y)]
    i, x, j, y = i[fine[0]], x[fine[0]], j[fine[1]], y[fine[1]]
    if not len(i) or not len(j):
        return pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "d": np.zeros(0)})
    tile, (high, wide), *off = _tiles(x, y, metric)
    own = _Nearest(i, x, j, y, k, metric, off[0])
    others = _Nearest(j, y, i, x, k, metric, off[1]) if both else None
    first, last = np.searchsorted(j, i, "left"), np.searchsorted(j, i, "right")
    for a in range(0, len(i), high):
        rows = slice(a, a + high)
        same = np.flatnonzero(last[rows] > first[rows])
        for b in range(0, len(j), wide):
            out = tile(rows, slice(b, b + wide))
            if out.dtype == float:
                out[np.isnan(out)] = np.inf  # overflown
            lo, hi = np.maximum(first[a + same] - b, 0), np.minimum(last[a + same] - b, out.shape[1])
            for m in np.flatnonzero(hi > lo):
                out[same[m], lo[m] : hi[m]] = np.inf
            own.add(a, b, out.min(axis=1), lambda near: out[near])
            if others:
                others.add(b, a, out.min(axis=0), lambda near: np.ascontiguousarray(out[:, near].T))
    return pd.concat([own.frame(), others.frame()], ignore_index=True) if others else own.frame()
