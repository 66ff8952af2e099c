"""Substring dedup: suffix automata over reference shards, matching statistics, removal of maximal repeated spans.

Words are maximal runs of bytes other than ASCII white space. A word is removed when it lies in a run of at least
`min_words` words that also occurs earlier in the corpus (earlier: smaller doc_id, null last; then smaller text hash; then
smaller position). So the first occurrence of every passage stays and maximal later spans go.

Reference shards. Every run of `min_words` words is assigned to the bucket of its minimizer (the smallest hash among its
`gram`-word runs, leftmost first). Equal runs have equal minimizers, so all occurrences of a passage meet in one bucket, and
a bucket sees at most 2 * min_words words around each. Buckets whose minimizer occurs once in the corpus hold no repeat and
aren't shuffled, but for some that a filter of bounded size takes for others. Within a bucket the segments are streamed in
corpus order through the suffix automaton of the segments before them; a match of length min_words or more is a repeated span.
Segments without any repeated run are dropped first. A bucket of more than `hot` segments isn't gathered: there equal segments,
then equal runs of min_words words are found by aggregation, with the same result.

Nulls and edge cases: a null text stays null and an empty one stays empty; a null doc_id orders last; rows that agree in
doc_id and text are one document (both keep the same text); other columns, whatever their names, pass through; an empty
table gives an empty table. n_chars, if there is such an integer column, is recomputed for changed texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import U64, Sieve, fresh, grams, materialise, mix, pieces, ship, sift, sorted_groups, text_bytes, word_hashes, words


class SuffixAutomaton:
    """A generalised suffix automaton over integer sequences, grown sequence by sequence."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _clone(self, p: int, q: int, c: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        clone = len(self.link) - 1
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:
            return q if self.length[p] + 1 == self.length[q] else self._clone(p, q, c)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[p] + 1)
        new = len(self.link) - 1
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[p] + 1 == self.length[q] else self._clone(p, q, c)
        return new

    def statistics(self, sequence: list[int]) -> list[int]:
        """For each position, the length of the longest match that ends there."""
        out, state, n = [], 0, 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            else:
                n = 0
            out.append(n)
        return out


SEGMENT = "m long, doc long, key long, at long, seg binary"
#: Windows that are looked at together: places of their grams take 24 bits beside a hash.
PLACES = (1 << 24) - (1 << 16)


def _buckets(h: np.ndarray, doc: np.ndarray, min_words: int, gram: int):
    """(hash of the minimizer, first word, last word) of each run of windows that share a minimizer."""
    empty = np.zeros(0, np.int64)
    n = h.size - min_words + 1
    if n <= 0:
        return empty.astype(U64), empty, empty
    if n > PLACES:  # more than places hold: ranges that overlap by a window less a word
        parts = [(a, _buckets(h[a : a + PLACES + min_words - 1], doc[a : a + PLACES + min_words - 1], min_words, gram)) for a in range(0, n, PLACES)]
        return np.concatenate([m for _, (m, _, _) in parts]), np.concatenate([x + a for a, (_, x, _) in parts]), np.concatenate([y + a for a, (_, _, y) in parts])
    g = grams(h, gram)
    w = min_words - gram + 1
    packed = (g & ~U64(0xFFFFFF)) | np.arange(g.size, dtype=U64)
    packed[doc[: g.size] != doc[gram - 1 : gram - 1 + g.size]] = U64(0xFFFFFFFFFFFFFFFF)
    span = 1
    while span * 2 <= w:
        packed = np.minimum(packed[:-span], packed[span:])
        span *= 2
    if span < w:
        packed = np.minimum(packed[: n], packed[w - span : w - span + n])
    ok = np.flatnonzero(doc[:n] == doc[min_words - 1 : min_words - 1 + n])
    if not ok.size:
        return empty.astype(U64), empty, empty
    at = (packed[ok] & U64(0xFFFFFF)).astype(np.int64)
    new = np.ones(ok.size, bool)
    new[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], ok.size) - 1
    return g[at[first]], ok[first], ok[last] + min_words - 1


def _hashed(batch: pa.RecordBatch, column: str):
    data, at = text_bytes(batch.column(column))
    starts, ends, doc = words(data, at)
    return word_hashes(data, starts, ends), doc, starts, ends, data, at


def _count(min_words: int, gram: int, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, column):
            h, doc, *_ = _hashed(part, column)
            m, _, _ = _buckets(h, doc, min_words, gram)
            u, n = np.unique(mix(m), return_counts=True)  # minimizers are small numbers: spread them
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["m", "n"])

    return run


def _segments(min_words: int, gram: int, many, hot, want_hot: bool = False):
    """Segments of the buckets that `many` seems to hold: of those that `hot` seems to hold, or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            h, doc, *_ = _hashed(part, "text")
            m, a, b = _buckets(h, doc, min_words, gram)
            m = mix(m)
            ok = many.value.holds(m)
            if hot is not None:
                ok &= hot.value.holds(m) == want_hot
            hit = np.flatnonzero(ok)
            m, a, b = m[hit], a[hit], b[hit]
            if not m.size:
                continue
            row = doc[a]
            first = np.searchsorted(doc, row)  # the first word of the document
            symbols = (h >> U64(32)).astype("<u4")
            raw = symbols.tobytes()
            segs = [raw[4 * x : 4 * y + 4] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(m.view(np.int64)), part.column("doc").take(take), part.column("key").take(take), pa.array((a - first).astype(np.int64)), pa.array(segs, pa.binary())],
                ["m", "doc", "key", "at", "seg"],
            )

    return run


def _windows(n: int):
    """Every run of n symbols of each segment, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "seg"):
            data, at = text_bytes(part.column("seg"))
            of = np.repeat(np.arange(part.num_rows), np.diff(at) // 4)
            g = grams(np.frombuffer(data.tobytes(), "<u4").astype(U64), n)
            good = np.flatnonzero(of[: g.size] == of[n - 1 : n - 1 + g.size])
            row = of[good]
            take = pa.array(row)
            place = part.column("at").to_numpy()[row] + good - at[row] // 4
            yield pa.RecordBatch.from_arrays([pa.array(g[good].view(np.int64)), part.column("doc").take(take), part.column("key").take(take), pa.array(place)], ["w", "doc", "key", "at"])

    return run


def _with_repeats(contents: list[bytes], n: int) -> set[int]:
    """Which contents hold an n-symbol run that occurs in another one (equal 64-bit hashes count as equal runs)."""
    own = np.concatenate([np.frombuffer(c, "<u4") for c in contents]).astype(U64)
    sizes = np.array([len(c) // 4 for c in contents])
    which = np.repeat(np.arange(len(contents)), sizes)
    g = grams(own, n)
    good = which[: g.size] == which[n - 1 : n - 1 + g.size]
    g, of = g[good], which[: good.size][good]
    _, back, count = np.unique(g, return_inverse=True, return_counts=True)
    return set(of[count[back] > 1].tolist())


def repeated_spans(segs: list[bytes], n: int) -> list[list[tuple[int, int]]]:
    """For each segment (4-byte symbols) the maximal spans [from, to) of n or more symbols that earlier segments hold."""
    out: list[list[tuple[int, int]]] = []
    distinct: dict[bytes, int] = {}
    for s in segs:
        distinct.setdefault(s, len(distinct))
    if len(distinct) > 1:
        wanted = _with_repeats(list(distinct), n)
        automaton = SuffixAutomaton()
    seen: set[bytes] = set()
    for s in segs:
        size = len(s) // 4
        if s in seen:
            out.append([(0, size)])
            continue
        seen.add(s)
        spans: list[tuple[int, int]] = []
        if len(distinct) > 1 and distinct[s] in wanted:
            symbols = np.frombuffer(s, "<u4").tolist()
            if len(automaton.link) > 1:
                for end, got in enumerate(automaton.statistics(symbols), 1):
                    if got >= n:
                        if spans and end - got <= spans[-1][1]:
                            spans[-1] = (min(spans[-1][0], end - got), end)
                        else:
                            spans.append((end - got, end))
            automaton.add(symbols)
        out.append(spans)
    return out


def _match(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, keys, starts, lengths = [], [], [], []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], ["doc", "key", "start", "length"])
            for x in (docs, keys, starts, lengths):
                x.clear()
            return got

        for group in sorted_groups(batches, ["m"]):
            if group.num_rows < 2:
                continue
            doc, key, at, seg = (group.column(c).to_pylist() for c in ("doc", "key", "at", "seg"))
            keep = [i for i in range(len(seg)) if not i or (doc[i], key[i], at[i]) != (doc[i - 1], key[i - 1], at[i - 1])]
            for i, spans in zip(keep, repeated_spans([seg[i] for i in keep], min_words), strict=True):
                for a, b in spans:
                    docs.append(doc[i])
                    keys.append(key[i])
                    starts.append(at[i] + a)
                    lengths.append(b - a)
            if len(docs) > 20_000:
                yield flush()
        yield flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document with its spans, those that meet made one; the rows come sorted by document and start."""
    held: pa.Table | None = None

    def emit(t: pa.Table) -> pa.RecordBatch:
        doc, key = t.column("doc").combine_chunks(), t.column("key").to_numpy()
        number, null = pc.fill_null(doc, 0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False)
        start = t.column("start").to_numpy()
        end = start + t.column("length").to_numpy()
        new = np.ones(t.num_rows, bool)
        new[1:] = (number[1:] != number[:-1]) | (null[1:] != null[:-1]) | (key[1:] != key[:-1])
        shift = np.cumsum(new) * (int(end.max(initial=0)) + 1)
        reach = np.maximum.accumulate(end + shift) - shift
        opens = new.copy()
        opens[1:] |= start[1:] > reach[:-1]
        first = np.flatnonzero(opens)
        last = np.append(first[1:], t.num_rows) - 1
        at = np.flatnonzero(new)
        offsets = pa.array(np.append(np.searchsorted(first, at), first.size).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (start[first], reach[last])]
        return pa.RecordBatch.from_arrays([doc.take(pa.array(at)), pa.array(key[at]), *lists], ["doc", "key", "starts", "ends"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        doc, key = t.column("doc"), t.column("key")
        same = pc.and_(pc.equal(key, key[-1]), doc.is_null() if doc[-1].as_py() is None else pc.fill_null(pc.equal(doc, doc[-1]), False))
        whole = t.num_rows - int(pc.sum(same).as_py())  # the last document may go on in the next batch
        if whole:
            yield emit(t.slice(0, whole))
        held = t.slice(whole)
    if held is not None:
        yield emit(held)


def _cut(column: str, starts: str, ends: str, chars: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, column, 4 << 20):
            names = [n for n in part.schema.names if n not in (starts, ends)]
            rows = np.flatnonzero(part.column(starts).is_valid().to_numpy(zero_copy_only=False))
            columns = {n: part.column(n) for n in names}
            if rows.size:
                at = pa.array(rows)
                new = [_without(*x) for x in zip(*(part.column(c).take(at).to_pylist() for c in (column, starts, ends)), strict=True)]
                mask = np.zeros(part.num_rows, bool)
                mask[rows] = True
                columns[column] = pc.replace_with_mask(part.column(column), pa.array(mask), pa.array(new, part.column(column).type))
                if chars:
                    old = part.column(chars)
                    columns[chars] = pc.replace_with_mask(old, pa.array(mask), pa.array([len(t) for t in new], old.type))
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return run


def _without(text: str, starts: list[int], ends: list[int]) -> str:
    """text without the words [start, end) of each span, and what follows each of them up to the next word."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    begins, _, _ = words(data, np.array([0, data.size]))
    begins = [*begins.tolist(), data.size]
    out, done = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(raw[done : begins[a]])
        done = begins[b]
    return b"".join([*out, raw[done:]]).decode()


def _order() -> Column:
    return F.struct(F.col("doc").isNull().alias("x"), "doc", "key", "at")


def spans(docs: DataFrame, min_words: int = 50, gram: int = 12, id_col: str = "doc_id", text_col: str = "text", hot: int = 8192, filter_bits: int = 1 << 28) -> DataFrame:
    """(doc, key, start, length): repeated spans in words; key is xxhash64 of the text. Spans of a document may overlap.

    Minimizers that occur more than once are told by a Bloom filter of at most `filter_bits`; the others that it lets by
    have buckets of one segment. Buckets of more than `hot` segments take the way of _hot_spans.
    """
    if not 1 <= gram <= min_words:
        raise ValueError("gram must be between 1 and min_words")
    spark = docs.sparkSession
    ship(spark)
    text = docs.select(F.col(text_col).alias("text"))
    many = materialise(text.mapInArrow(_count(min_words, gram, "text"), "m long, n long").groupBy("m").agg(F.sum("n").alias("n")).where("n > 1"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    sieve = spark.sparkContext.broadcast(Sieve(many, "m", most=filter_bits))
    crowded = many.where(F.col("n") > hot)
    hot_sieve = None if crowded.isEmpty() else spark.sparkContext.broadcast(Sieve(crowded, "m", most=filter_bits))
    segs = rows.mapInArrow(_segments(min_words, gram, sieve, hot_sieve), SEGMENT)
    shards = segs.repartition("m").sortWithinPartitions("m", F.col("doc").asc_nulls_last(), "key", "at")
    found = shards.mapInArrow(_match(min_words), "doc long, key long, start long, length long")
    if hot_sieve is None:
        return found
    return found.unionByName(_hot_spans(rows.mapInArrow(_segments(min_words, gram, sieve, hot_sieve, True), SEGMENT), min_words))


def _hot_spans(segs: DataFrame, n: int) -> DataFrame:
    """The spans of crowded buckets, of which no task gets a whole one: equal segments are aggregated (before the shuffle too),
    of which all but the first are repeated throughout; in the first ones, windows are aggregated likewise."""
    segs = segs.withColumn("s", F.xxhash64("seg"))
    firsts = materialise(segs.groupBy("m", "s").agg(F.min(_order()).alias("first"), F.first("seg").alias("seg")))
    later = segs.select("m", "s", "doc", "key", "at", (F.octet_length("seg") / 4).cast("long").alias("length")).join(firsts.select("m", "s", "first").hint("merge"), ["m", "s"]).where(~_order().eqNullSafe(F.col("first")))
    windows = firsts.select("first.doc", "first.key", "first.at", "seg").mapInArrow(_windows(n), "w long, doc long, key long, at long")
    earliest = windows.groupBy("w").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "first")
    again = windows.join(earliest.hint("merge"), "w").where(~_order().eqNullSafe(F.col("first")))
    return later.select("doc", "key", F.col("at").alias("start"), "length").unionByName(again.select("doc", "key", F.col("at").alias("start"), F.lit(n).cast("long").alias("length")))


def substring_dedup(docs: DataFrame, min_words: int = 50, gram: int = 12, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs with repeated passages of min_words or more words removed from all but their first place (see the module).

    Documents with spans are told by a Bloom filter of bounded size; only what it lets by is shuffled, to its spans.
    """
    cols = docs.columns
    doc, key, starts, ends = (fresh(x, cols) for x in ("__doc", "__key", "__starts", "__ends"))
    found = spans(docs, min_words, gram, id_col, text_col, **params).repartition("doc", "key").sortWithinPartitions("doc", "key", "start")
    found = materialise(found.mapInArrow(_merge, "doc long, key long, starts array<long>, ends array<long>"))
    text, number = F.xxhash64(F.col(text_col)), F.col(id_col).cast("long")
    plain, some = sift(docs, F.xxhash64(number, text), found.select(F.xxhash64("doc", "key").alias("h")), "h")
    found = found.select(F.col("doc").alias(doc), F.col("key").alias(key), F.col("starts").alias(starts), F.col("ends").alias(ends))
    left = some.withColumn(key + "t", text)
    joined = left.join(found.hint("merge"), number.eqNullSafe(F.col(doc)) & (F.col(key + "t") == F.col(key)), "left").select(*[f"`{c}`" for c in cols], starts, ends)
    chars = next((f.name for f in docs.schema.fields if f.name == "n_chars" and isinstance(f.dataType, T.IntegralType)), None)
    return plain.union(joined.mapInArrow(_cut(text_col, starts, ends, chars), docs.schema))
