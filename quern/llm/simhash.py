"""SimHash near-dedup: exact Hamming pairs through vantage-point trees over fingerprints.

Fingerprint: 256 bits, each the majority over the document's distinct words (letters and digits, lower case) of a hash bit.
A document with fewer than `min_features` distinct words gets a hash of its normalised words in order, so that it meets
exact copies only. Near: at most `radius` of 256 bits differ. Order and repetition of words don't count.

Search. A vantage-point tree partitions the fingerprints by their Hamming distance over all 256 bits to vantage points
(inside: at most mu). A leaf is a shard. By the triangle inequality a near pair can only be parted where the inside one has a
distance above mu - radius, so such a fingerprint also visits the outside branch; visitors descend into every branch that the
bounds don't exclude. Every leaf finds the near pairs among its own fingerprints and between them and its visitors: the bits
fall into blocks with radii so chosen that a pair which exceeds its radius in every block differs in more than `radius` bits
in all; so a near pair is within some block's radius there, every value within it is looked up in an index of the block, and
what is found is compared over all 256 bits. No near pair is missed. The tree is built from a bounded sample, and blocks are
chosen by the size of the leaf; both change times but no result.

A shard reports a spanning forest of its near pairs, not all of them; connected components over these give the groups.

Nulls and edge cases: null, empty and wordless texts are in no group; a null doc_id orders last; rows that agree in doc_id
and text are one document in near_duplicates() while simhash_dedup() keeps one row of them; extra columns pass through;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import NOT_WORD, U64, Forest, components, fresh, materialise, mix, pieces, ship, sift, text_bytes, word_hashes, words

BITS = 256
#: What NOT_WORD leaves of a text.
A_WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"


def fingerprints(column: pa.Array, min_features: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(n, 32) bytes and which rows have words at all; column: lower-case texts, at most 60,000."""
    data, at = text_bytes(column)
    n = len(column)
    starts, ends, doc = words(data, at, NOT_WORD)
    h = word_hashes(data, starts, ends)
    out = np.zeros((n, BITS // 8), np.uint8)
    total = np.bincount(doc, minlength=n)
    if not h.size:
        return out, total > 0
    low = U64((1 << 48) - 1)
    key = np.sort((doc.astype(U64) << U64(48)) | (h & low))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    row, feature = (key >> U64(48)).astype(np.int64), key & low
    distinct = np.bincount(row, minlength=n)
    votes = np.zeros((n, BITS), np.int32)
    for a in range(0, key.size, 1 << 17):
        r, f = row[a : a + (1 << 17)], feature[a : a + (1 << 17)]
        bits = np.unpackbits(np.stack([mix(f ^ (mix(np.array([s], U64)) & ~low)) for s in range(BITS // 64)], axis=1).view(np.uint8), axis=1)
        begin = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        size = np.diff(np.append(begin, r.size))
        begin = np.flatnonzero((np.arange(r.size) - np.repeat(begin, size)) % 255 == 0)  # byte counters hold 255 rows
        sums = np.add.reduceat(bits.view(U64), begin, axis=0).view(np.uint8)
        np.add.at(votes, r[begin], sums)
    out = np.packbits(votes * 2 > distinct[:, None], axis=1)
    first = np.searchsorted(doc, np.arange(n + 1))
    for i in np.flatnonzero((distinct < min_features) & (total > 0)).tolist():
        x = _fold(h[first[i] : first[i + 1]])
        out[i] = np.concatenate([mix(x + U64(s)) for s in range(1, BITS // 64 + 1)]).view(np.uint8)
    return out, total > 0


def _fold(h: np.ndarray) -> np.ndarray:
    """A run of words as one hash that depends on their order."""
    with np.errstate(over="ignore"):
        return mix((mix(np.arange(h.size, dtype=U64)) ^ h)).sum(keepdims=True)


def _far(values: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Hamming distances of values (numbers or rows of them) to v."""
    d = np.bitwise_count(values ^ v)
    return (d.sum(axis=1) if d.ndim > 1 else d).astype(np.int64)


class Tree:
    """A vantage-point tree over numbers or rows of them; nodes are (vantage, mu, inside, outside) or a leaf's number."""

    def __init__(self, values: np.ndarray, weight: float, leaf: int, seed: int, radius: int = 1):
        self.leaves = 0
        self.bits = values.itemsize * 8 * math.prod(values.shape[1:])
        self.radius = radius  # cuts are made where few values are so near to mu
        self.node = self._build(values, weight, leaf, np.random.default_rng(seed))

    def _build(self, values: np.ndarray, weight: float, leaf: int, rng: np.random.Generator):
        if len(values) * weight > leaf and len(values) > 8:
            best = None
            for v in rng.choice(values, 4):
                d = _far(values, v)
                inside = np.cumsum(np.bincount(d, minlength=self.bits + 1))
                for mu in range(self.bits):
                    a, b = inside[mu], len(values) - inside[mu]
                    if min(a, b) * 5 < len(values):
                        continue
                    near = inside[min(mu + self.radius, self.bits)] - (inside[mu - self.radius] if mu >= self.radius else 0)
                    if best is None or near < best[0]:
                        best = (near, v, mu, d)
            if best is None:  # no even cut: any cut
                for v in rng.choice(values, 8):
                    d = _far(values, v)
                    if d.max() > d.min():
                        best = (0, v, int(d.min()), d)
                        break
            if best is not None:
                _, v, mu, d = best
                return (v, mu, self._build(values[d <= mu], weight, leaf, rng), self._build(values[d > mu], weight, leaf, rng))
        self.leaves += 1
        return self.leaves - 1

    def visits(self, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into values, leaf, whether it is the value's own leaf)."""
        out: list[tuple[np.ndarray, int, bool]] = []

        def down(node, own: np.ndarray, visiting: np.ndarray) -> None:
            if not own.size and not visiting.size:
                return
            if not isinstance(node, tuple):
                out.extend([(own, node, True), (visiting, node, False)])
                return
            v, mu, inside, outside = node
            d, e = _far(values[own], v), _far(values[visiting], v)
            down(inside, own[d <= mu], visiting[e - radius <= mu])
            down(outside, own[d > mu], np.concatenate([own[(d <= mu) & (d + radius > mu)], visiting[e + radius > mu]]))

        down(self.node, np.arange(len(values)), np.zeros(0, np.int64))
        size = [x.size for x, _, _ in out]
        return np.concatenate([x for x, _, _ in out] or [np.zeros(0, np.int64)]), np.repeat([n for _, n, _ in out], size).astype(np.int64), np.repeat([o for _, _, o in out], size).astype(bool)


def blocks(n: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of blocks so that a pair beyond all their radii differs in more than `radius` bits; of the
    numbers of blocks, the one for which looking up all values within them among n random fingerprints is cheapest."""

    def plan(m: int) -> tuple[float, list[tuple[int, int, int]]]:
        cut = [BITS * i // m for i in range(m + 1)]
        spare, more = divmod(max(radius + 1 - m, 0), m)  # the radii and one for each block add up to radius + 1
        out = [(cut[i], cut[i + 1] - cut[i], spare + (i < more)) for i in range(min(m, radius + 1))]
        ball = [sum(math.comb(b, k) for k in range(min(r, b) + 1)) for _, b, r in out]
        return sum(x * (1 + 8 * n / 2**b) for x, (_, b, _) in zip(ball, out, strict=True)), out

    return min(plan(m) for m in range(12, 33))[1]


class Index:
    """Finds what is within a Hamming distance of its fingerprints (rows of four U64), and connects it."""

    def __init__(self, own: np.ndarray, radius: int, rows: int = 1024, most: int = 1 << 20):
        self.n, self.radius, self.rows, self.most = len(own), radius, rows, most
        self.columns = [np.ascontiguousarray(own[:, k]) for k in range(own.shape[1])]
        self.parent = np.arange(self.n)
        self.parts = []
        for start, bits, r in blocks(self.n, radius):
            value = self._cut(self.columns, start, bits)
            begins = np.concatenate(([0], np.cumsum(np.bincount(value, minlength=1 << bits)))).astype(np.int32)
            masks = np.array([sum(1 << b for b in on) for k in range(min(r, bits) + 1) for on in itertools.combinations(range(bits), k)], np.int64)
            self.parts.append((start, bits, masks, begins, np.argsort(value, kind="stable").astype(np.int32)))

    @staticmethod
    def _cut(columns: list[np.ndarray], start: int, bits: int) -> np.ndarray:
        word, at = divmod(start, 64)
        value = columns[word] >> U64(at)
        if at + bits > 64:
            value = value | (columns[word + 1] << U64(64 - at))
        return (value & U64((1 << bits) - 1)).astype(np.int64)

    def _near(self, forest: Forest, asked: list[np.ndarray], first: int, i: np.ndarray, j: np.ndarray) -> None:
        """Joins those of the pairs (asked i, own j) that are near."""
        if first < self.n:
            later = j > first + i  # the others are found from their other side
            i, j = i[later], j[later]
        for k in (0, 2):  # a near pair is near over the first half
            d = np.bitwise_count(asked[k][i] ^ self.columns[k][j]) + np.bitwise_count(asked[k + 1][i] ^ self.columns[k + 1][j]).astype(np.int16)
            d = d if not k else d + so_far
            i, j, so_far = i[d <= self.radius], j[d <= self.radius], d[d <= self.radius]
        forest.join_pairs(first + i, j)

    def search(self, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
        """A spanning forest of the near pairs of asked and own (None: own and own), beyond what earlier calls connected;
        indices count own first, then asked."""
        forest = Forest(self.n + (0 if asked is None else len(asked)))
        forest.parent[: self.n] = self.parent
        columns = self.columns if asked is None else [np.ascontiguousarray(asked[:, k]) for k in range(asked.shape[1])]
        base = 0 if asked is None else self.n
        for a in range(0, len(columns[0]), self.rows):
            some = [c[a : a + self.rows] for c in columns]
            for start, bits, masks, begins, order in self.parts:
                value = self._cut(some, start, bits)
                for b in range(0, masks.size, 512):
                    key = (value[:, None] ^ masks[None, b : b + 512]).ravel()
                    begin = begins[key]
                    count = begins[key + 1] - begin
                    hit = np.flatnonzero(count)
                    if not hit.size:
                        continue
                    row, begin, count = hit // min(512, masks.size - b), begin[hit].astype(np.int64), count[hit].astype(np.int64)
                    ends = np.cumsum(count)
                    for lo in range(0, int(ends[-1]), self.most):  # a value that many have is taken in pieces
                        hi = min(lo + self.most, int(ends[-1]))
                        x, y = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
                        size = np.minimum(ends[x:y], hi) - np.maximum(ends[x:y] - count[x:y], lo)
                        place = np.arange(lo, hi) + np.repeat(begin[x:y] - (ends[x:y] - count[x:y]), size)
                        self._near(forest, some, base + a, np.repeat(row[x:y], size), order[place])
        self.parent = forest.labels()[: self.n].copy()
        return forest.kept


def near_forest(own: np.ndarray, visiting: np.ndarray, radius: int, rows: int = 1024, columns: int = 1024) -> list[tuple[int, int]]:
    """A spanning forest of the near pairs own-own and own-visiting; indices count own first, then visiting. Rows are 16
    numbers of 16 bits; `rows` of them are looked up and rows x columns pairs compared at a time."""
    index = Index(np.ascontiguousarray(own).view(U64), radius, rows, rows * columns)
    return index.search() + index.search(np.ascontiguousarray(visiting).view(U64))


def _fingerprint_rows(min_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            fp, has = fingerprints(part.column("text"), min_features)
            keep = pa.array(np.flatnonzero(has))
            yield pa.RecordBatch.from_arrays([part.column("doc").take(keep), part.column("key").take(keep), pa.array([x.tobytes() for x in fp[has]], pa.binary())], ["doc", "key", "fp"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, BITS // 64)


def _to_leaves(tree, radius: int, parts: int):
    """A leaf has `parts` tasks, numbered leaf * parts + k: each gets all of its own fingerprints and a part of its visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = _matrix(batch.column("fp"))
            at, leaf, own = tree.value.visits(fp, radius)
            part = (mix(fp[at, 0]) % U64(parts)).astype(np.int64)
            copies = np.where(own, parts, 1)
            place = np.repeat(np.arange(at.size), copies)
            number = np.where(own[place], np.arange(place.size) - np.repeat(np.cumsum(copies) - copies, copies), part[place])
            at, own, task = at[place], own[place], leaf[place] * parts + number
            for a in range(0, at.size, 20_000):
                s = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(task[s]), pa.array(own[s]), batch.column("fp").take(pa.array(at[s]))], ["leaf", "own", "fp"])

    return run


def _in_leaf(radius: int, parts: int):
    """In each task of a leaf its own rows come first and are held; its visitors pass by. The first task compares its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, held, index, own = None, [], None, None

        def edges(every: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([every[x[k]].tobytes() for x in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

        def build() -> pa.RecordBatch:
            nonlocal index, own
            own = np.concatenate(held or [np.zeros((0, BITS // 64), U64)])
            held.clear()
            index = Index(own, radius)
            return edges(own, index.search() if leaf % parts == 0 else [])

        for batch in batches:
            if not batch.num_rows:
                continue
            number, mine, fp = batch.column("leaf").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False), _matrix(batch.column("fp"))
            cuts = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (mine[1:] != mine[:-1])) + 1).tolist(), len(fp)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if number[a] != leaf:
                    if held:
                        yield build()
                    leaf, index = number[a], None
                if mine[a]:
                    held.append(fp[a:b])
                    continue
                if index is None:
                    yield build()
                if index.n:
                    yield edges(np.concatenate([own, fp[a:b]]), index.search(fp[a:b]))
        if held:
            yield build()

    return run


def groups(docs: DataFrame, radius: int = 40, leaf: int = 32_768, leaves: int = 32, most: int = 4 << 20, parts: int = 8, sample: int = 50_000, min_features: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, key, fp, root) for each document with words: root is its group's smallest fingerprint. A leaf has about `leaf`
    fingerprints, or more where that would make more than about `leaves` of them, but about `most` at most, which bounds a
    task's memory. `parts` tasks share a leaf's visitors."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), F.lower(text_col).alias("text"))
    found = materialise(rows.mapInArrow(_fingerprint_rows(min_features), "doc long, key long, fp binary"))
    distinct = materialise(found.select("fp").distinct())
    n = distinct.count()
    share = min(1.0, sample / max(n, 1))
    chosen = sorted(distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).toArrow().column("fp").to_pylist())  # in order, so that a run repeats
    seen = np.frombuffer(b"".join(chosen), "<u8").reshape(-1, BITS // 64)
    tree = Tree(seen, n / max(len(chosen), 1), max(leaf, min(n // leaves, most)), 0, radius)
    sent = spark.sparkContext.broadcast(tree)
    shards = distinct.mapInArrow(_to_leaves(sent, radius, parts), "leaf long, own boolean, fp binary").repartition(4 * parts * tree.leaves, "leaf").sortWithinPartitions("leaf", F.desc("own"))
    edges = shards.mapInArrow(_in_leaf(radius, parts), "a binary, b binary")
    roots = components(edges)
    return found.join(roots, found["fp"] == roots["node"], "left").select("doc", "key", "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """(doc_id, kept_doc_id): each document that goes, beside the smallest doc_id of its group, which stays."""
    every = groups(docs, id_col=id_col, text_col=text_col, **params).select("doc", "key", "root").distinct()
    first = every.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("x"), "doc", "key")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    both = every.join(first, "root").where(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("key") == F.col("first.key"))))
    return both.select(F.col("doc").alias("doc_id"), F.col("first.doc").alias("kept_doc_id"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 1 << 28, **params) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id (then text hash).

    What may go is told by a Bloom filter of bounded size; only what it lets by is shuffled, to the marks of what goes. Of
    rows that agree in doc_id and text one is left before that shuffle already.
    """
    every = groups(docs, id_col=id_col, text_col=text_col, **params).select("doc", "key", "root")
    first = every.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("x"), "doc", "key")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = every.join(first, "root").groupBy("doc", "key").agg(F.max(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("key") == F.col("first.key"))).alias("stays"), F.count(F.lit(1)).alias("copies"))
    marks = materialise(marks.where("not stays or copies > 1"))
    cols = docs.columns
    key, doc, kind = (fresh(x, cols) for x in ("__key", "__doc", "__kind"))
    text, number = F.xxhash64(F.col(text_col)), F.col(id_col).cast("long")
    plain, some = sift(docs, F.xxhash64(number, text), marks.select(F.xxhash64("doc", "key").alias("h")), "h", most=filter_bits)
    # a row without words has no copies: it stays, told from its like by a number
    null = F.when(number.isNull(), -1).otherwise(0).cast("long")
    worded = F.coalesce(F.lower(text_col).rlike(A_WORD), F.lit(False))
    some = some.withColumn(doc, F.coalesce(number, F.lit(0))).withColumn(key, text).withColumn(kind, F.when(worded, null).otherwise(F.monotonically_increasing_id() + 1))
    once = some.groupBy(doc, key, kind).agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in cols])
    gone = marks.where("not stays").select(F.coalesce("doc", F.lit(0)).alias(doc), F.col("key").alias(key), F.when(F.col("doc").isNull(), -1).otherwise(0).cast("long").alias(kind))
    return plain.union(once.join(gone.hint("merge"), [doc, key, kind], "left_anti").select(*[f"`{c}`" for c in cols]))
