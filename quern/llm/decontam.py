"""Benchmark decontamination: suffix arrays of training shards, searched for every suffix of every test text.

Words are maximal runs of bytes other than ASCII white space, compared verbatim. A document is affected by an item when they
share a run of at least min(min_words, words of the item) words; an item without words affects nothing.

Each shard (about 1 MB of documents) gets a word-level suffix array of the suffixes that can begin such a run (their first
few words begin some test suffix), sorted by as many words as the run must have. The test suffixes whose first words occur in
the shard are searched for by bisection, all at once; every place found that isn't within a longer match is extended word by
word, and so gives the longest match of each document and item with its places. Test texts are kept as one array of word
hashes with an offset for each suffix, so they take memory in proportion to their words, however long an item is. They go to
all tasks; beyond `broadcast_words` words of them, the documents are passed once per part of the test texts.

Nulls and edge cases: a null or empty text (document or item) never matches; repeated document rows are each reported and
each removed; items that agree in id and text are one; ties between places take the earliest in the document, then in the
item; extra columns pass through the filter untouched; empty tables give empty results and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import U64, grams, pieces, ship, text_bytes, word_hashes, words


class Tests:
    """The suffixes of the test texts, as places in one array of word hashes, sorted by the hash of their first words."""

    def __init__(self, ids: list[int], texts: list[str], min_words: int):
        data, at = text_bytes(pa.array(texts, pa.large_string()))
        starts, ends, item = words(data, at)
        self.ids = ids
        self.h = word_hashes(data, starts, ends)
        sizes = np.bincount(item, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.begin = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.need = np.minimum(sizes, min_words)
        self.seed = min(int(self.need[self.need > 0].min(initial=min_words)), 6)
        g = grams(self.h, self.seed)
        place = np.flatnonzero(np.arange(self.h.size) + self.need[item] <= self.begin[item + 1])  # where a whole run begins
        seeds = g[place] if place.size else np.zeros(0, U64)
        order = np.argsort(seeds, kind="stable")
        self.place, self.item, self.seeds = place[order], item[place[order]], seeds[order]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.seeds >> U64(48)).astype(np.int64)] = True

    def find(self, part: pa.RecordBatch, column: str, most: int = 1 << 18) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, item's index) -> longest match in words, its place in the document and in the item."""
        data, at = text_bytes(part.column(column))
        starts, ends, doc = words(data, at)
        h = word_hashes(data, starts, ends)
        g = grams(h, self.seed)
        if not g.size or not self.place.size:
            return {}
        where = np.flatnonzero(self.bits[(g >> U64(48)).astype(np.int64)])
        where = where[np.isin(g[where], self.seeds)]
        where = where[doc[where] == doc[where + self.seed - 1]]
        if not where.size:
            return {}
        size = np.bincount(doc, minlength=part.num_rows)
        end = np.cumsum(size)  # of each document's words
        wanted = _ranges(np.searchsorted(self.seeds, u := np.unique(g[where]), "left"), np.searchsorted(self.seeds, u, "right"))[1]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for need in np.unique(self.need[self.item[wanted]]).tolist():
            asked = wanted[self.need[self.item[wanted]] == need]
            own = where[where + need <= end[doc[where]]]
            if not own.size:
                continue
            runs = np.concatenate([h[own[:, None] + np.arange(need)], self.h[self.place[asked][:, None] + np.arange(need)]])
            order = np.lexsort(runs.T[::-1])
            new = np.ones(order.size, np.int64)
            new[1:] = (runs[order[1:]] != runs[order[:-1]]).any(axis=1)
            rank = np.empty(order.size, np.int64)
            rank[order] = np.cumsum(new)
            array = own[np.argsort(rank[: own.size], kind="stable")]  # the shard's suffix array
            sorted_ranks = np.sort(rank[: own.size])
            low, high = (np.searchsorted(sorted_ranks, rank[own.size :], side) for side in ("left", "right"))
            for a, b in _steps(high - low, most):
                k, x = _ranges(low[a:b], high[a:b])
                suffix = asked[a:b][k]
                self._extend(h, doc, end, array[x], self.place[suffix], self.item[suffix], need, best)
        return best

    def _extend(self, h: np.ndarray, doc: np.ndarray, end: np.ndarray, p: np.ndarray, q: np.ndarray, item: np.ndarray, need: int, best: dict) -> None:
        """Takes in the matches of `need` words at p of the shard and q of the test texts."""
        d = doc[p]
        first = end[d] - np.bincount(doc, minlength=end.size)[d]
        inner = (p > first) & (q > self.begin[item]) & (h[p - 1] == self.h[q - 1])  # within a longer match of the same two
        p, q, item, d, first = (x[~inner] for x in (p, q, item, d, first))
        n = np.full(p.size, need)
        room = np.minimum(end[d] - p, self.begin[item + 1] - q)
        open_, step = np.flatnonzero(n < room), 16
        while open_.size:
            ahead = n[open_][:, None] + np.arange(step)
            there = ahead < room[open_][:, None]
            ahead = np.where(there, ahead, 0)
            same = there & (h[p[open_][:, None] + ahead] == self.h[q[open_][:, None] + ahead])
            more = np.where(same.all(axis=1), step, same.argmin(axis=1))
            n[open_] += more
            open_ = open_[more == step]
            step = min(2 * step, max(16, (1 << 20) // max(open_.size, 1)))
        for r, i, got in zip(d.tolist(), item.tolist(), zip((-n).tolist(), (p - first).tolist(), (q - self.begin[item]).tolist(), strict=True), strict=True):
            old = best.get((r, i))
            if old is None or got < (-old[0], old[1], old[2]):
                best[r, i] = (-got[0], got[1], got[2])


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, number) for all numbers of the ranges [low, high)."""
    size = high - low
    which = np.repeat(np.arange(size.size), size)
    return which, np.arange(which.size) + np.repeat(low - (np.cumsum(size) - size), size)


def _steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Parts of the sizes that sum up to about `most`."""
    total, a = np.cumsum(sizes), 0
    while a < sizes.size:
        b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")), a + 1)
        yield a, b
        a = b


def _tests(benchmark: DataFrame, min_words: int, id_col: str, text_col: str, broadcast_words: int) -> list[Tests]:
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (6 * broadcast_words)))
    out = []
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p).orderBy("id", "text").toArrow()
        out.append(Tests(own.column("id").to_pylist(), own.column("text").to_pylist(), min_words))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): the longest match of each affected document with each item."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, match_words long, doc_word long, item_word long"
    out = None
    for tests in _tests(benchmark, min_words, item_col, item_text, broadcast_words):
        sent = spark.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches, "text"):
                found = sorted(sent.value.find(part, "text").items())
                take = pa.array([r for (r, _), _ in found], pa.int64())
                rest = [[sent.value.ids[i] for (_, i), _ in found], *([v[j] for _, v in found] for j in range(3))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "match_words", "doc_word", "item_word"])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_words: int = 2_000_000) -> DataFrame:
    """docs without the affected documents; no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    for tests in _tests(benchmark, min_words, item_col, item_text, broadcast_words):
        sent = spark.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches, text_col):
                keep = np.ones(part.num_rows, bool)
                keep[[r for r, _ in sent.value.find(part, text_col)]] = False
                yield part if keep.all() else part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
