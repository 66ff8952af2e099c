"""Byte-level BPE encoding and decoding by a prefix-sharing trie traversal.

Texts are parted into words by the vocabulary's pattern; the distinct new words of a block of documents form a trie, which is
walked depth first (as sorted words with common prefixes, keeping the states of the current path). The state of a prefix is
the last token of its encoding. It is the one token that ends the prefix and is compatible with the last token of what comes
before it: two tokens are compatible when BPE leaves the two as they are. So the encoding of a prefix shared by many words is
found once, and a word's encoding is read back from its states.

The vocabulary file (a parameter) is read by the driver and sent to the workers. A worker keeps encodings of recent words in
a bounded cache; the cache changes speed only.

Nulls and edge cases: a null text gives null tokens, an empty one none; text that looks like a special token is ordinary
text; extra columns pass through; a clashing name of an output column is replaced.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import KEPT, pieces, ship, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Contractions, letters, digits, other signs (each with a leading space), white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space within white space: PATTERN need not part there.
INNER = regex.compile(r"\s ")
CACHE, PAIRS = 250_000, 1_000_000


class Bpe:
    """A vocabulary: lines of base64 token and rank."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.bytes_of = {i: b for b, i in self.rank.items()}
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        self.split = regex.compile(pattern).findall
        self.by_space = pattern == PATTERN
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._automaton()
        top = max(self.bytes_of) + 1
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(top)], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.table = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)

    def _automaton(self) -> None:
        """For each state (the longest token prefix that ends here): the tokens that end here, longest first."""
        self.goto: dict[int, int] = {}
        own: list[int] = [-1]
        for b, token in self.rank.items():
            at = 0
            for c in b:
                key = at << 8 | c
                at = self.goto.setdefault(key, len(own))
                if at == len(own):
                    own.append(-1)
            own[at] = token
        self.fail = [0] * len(own)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        children: list[list[tuple[int, int]]] = [[] for _ in own]
        for key, to in self.goto.items():
            children[key >> 8].append((key & 255, to))
        queue = [0]
        for at in queue:
            for c, to in children[at]:
                self.fail[to] = 0 if not at else self.step(self.fail[at], c)
                shorter = self.ends[self.fail[to]]
                t = own[to]
                self.ends[to] = shorter if t < 0 else ((t, len(self.bytes_of[t])), *shorter)
                queue.append(to)

    def step(self, at: int, c: int) -> int:
        goto = self.goto
        while True:
            to = goto.get(at << 8 | c)
            if to is not None:
                return to
            if not at:
                return 0
            at = self.fail[at]

    def merge(self, piece: bytes) -> list[int]:
        """Plain BPE of a short piece: the lowest-ranked neighbours merge first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            r, i = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def _compatible(self, before: int, token: int) -> bool:
        """Whether BPE leaves the two tokens apart; before -1: whether it makes the token from its own bytes."""
        key = (before + 1) << 32 | token
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            pair = [before, token] if before >= 0 else [token]
            got = self.pairs[key] = self.merge(b"".join(self.bytes_of[t] for t in pair)) == pair
        return got

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Each word's tokens as int32 bytes; the words are walked as the trie of their prefixes."""
        out: dict[bytes, bytes] = {}
        pairs, size, ends, goto, step = self.pairs, self.size, self.ends, self.goto, self.step
        path = b""
        last, at = [-1], [0]  # of the path's first n bytes: the last token, the automaton's state
        for word in sorted(words):
            n, top = 0, min(len(path), len(word))
            while n < top and path[n] == word[n]:
                n += 1
            del last[n + 1 :], at[n + 1 :]
            path = word
            now = at[n]
            for end in range(n, len(word)):
                c = word[end]
                to = goto.get(now << 8 | c)
                now = step(now, c) if to is None else to
                at.append(now)
                for token, length in ends[now]:
                    before = last[end + 1 - length]
                    ok = pairs.get((before + 1) << 32 | token)
                    if ok is None:
                        ok = self._compatible(before, token)
                    if ok:
                        last.append(token)
                        break
                else:
                    raise ValueError(f"the vocabulary can't encode byte {c}")
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= size[last[end]]
            ids.reverse()
            out[word] = array("i", ids).tobytes()
        return out

    def _chunks(self, text: str) -> list[str]:
        """Parts that are encoded on their own: before spaces, where PATTERN always parts unless white space precedes them; else
        by the pattern."""
        if not self.by_space or "\0" in text or INNER.search(text):
            return self.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Tokens of each text as int32 bytes (null: none)."""
        chunks = [self._chunks(t) if t else [] for t in texts]
        distinct = set().union(*chunks)
        parts = {c: self.split(c) for c in distinct}
        words = set().union(*parts.values()).difference(self.young)
        known = words & self.old.keys()
        if len(self.young) + len(words) > CACHE:
            self.old, self.young = self.young, {}
            words = set().union(*parts.values())
            known = words & self.old.keys()
        self.young.update((w, self.old[w]) for w in known)
        new = {w.encode(): w for w in words - known}
        self.young.update((new[b], e) for b, e in self.encode_words(new).items())
        young = self.young
        encoded = {c: young[ws[0]] if len(ws) == 1 else b"".join([young[w] for w in ws]) for c, ws in parts.items()}
        get = encoded.__getitem__
        return [b"".join(map(get, c)) for c in chunks]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0], "<i4").tolist()

    def decode_array(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of tokens."""
        size = self.lengths[ids]
        if not ids.size or not size.sum():
            return np.zeros(0, np.uint8)
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        return self.table[np.arange(int(size.sum())) + np.repeat(self.offsets[ids] - begin, size)]

    def decode(self, ids: list[int]) -> str:
        """Bytes that aren't UTF-8 become replacement characters; a token that isn't in the vocabulary is an error."""
        if any(i not in self.bytes_of for i in ids):
            raise ValueError("unknown token")
        return b"".join(self.bytes_of[i] for i in ids).decode(errors="replace")


_loaded: dict[tuple[int, str], Bpe] = {}
KEPT["bpe"] = _loaded.clear


def of(vocabulary: bytes, pattern: str) -> Bpe:
    """This process's copy."""
    key = (zlib.crc32(vocabulary), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(vocabulary, pattern)
    return _loaded[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _token_column(encoded: list[bytes], missing: np.ndarray | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(e) // 4 for e in encoded]))).astype(np.int32)
    values = np.frombuffer(b"".join(encoded), "<i4")
    mask = pa.array(missing) if missing is not None and missing.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask), values, offsets


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, tokens: str = "tokens", check: bool = True) -> DataFrame:
    """docs with `tokens` (array<int>), `n_tokens`, and with check `round_trip`: whether decoding gives the text's bytes."""
    spark = docs.sparkSession
    ship(spark)
    raw = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    new = [tokens, "n_tokens", *(["round_trip"] if check else [])]
    kept = [f.name for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in new} or f.name == text_col]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField(tokens, T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.IntegerType()), *([T.StructField("round_trip", T.BooleanType())] if check else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = of(raw.value, pattern)
        for part in pieces(batches, text_col, 2 << 20, owner="bpe"):
            texts = part.column(text_col)
            missing = texts.is_null().to_numpy(zero_copy_only=False)
            column, values, offsets = _token_column(bpe.encode_texts(texts.to_pylist()), missing)
            added = [column, pa.array(np.diff(offsets), mask=missing)]
            if check:
                data, at = text_bytes(texts)
                got = bpe.decode_array(values)
                ends = np.concatenate(([0], np.cumsum(bpe.lengths[values])))[offsets]
                same = np.array_equal(ends, at) and np.array_equal(got, data)
                each = np.ones(part.num_rows, bool) if same else np.array([np.array_equal(got[ends[i] : ends[i + 1]], data[at[i] : at[i + 1]]) for i in range(part.num_rows)], bool)
                added.append(pa.array(each, mask=missing))
            yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *new])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, tokens: str = "tokens", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with `text` decoded from `tokens`; null tokens give null; unknown tokens are an error."""
    spark: SparkSession = df.sparkSession
    ship(spark)
    raw = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != text.lower()])
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = of(raw.value, PATTERN)
        for batch in batches:
            lists = batch.column(tokens)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if ids.size and (ids.min() < 0 or ids.max() >= bpe.lengths.size or not bpe.lengths[ids].all()):
                raise ValueError("unknown token")
            got = bpe.decode_array(ids)
            at = np.concatenate(([0], np.cumsum(bpe.lengths[ids])))[np.concatenate(([0], np.cumsum(size)))]
            raw_bytes = got.tobytes()
            try:
                if got.size:
                    raw_bytes.decode()
                    if (got[at[(at > 0) & (at < got.size)]] & 0xC0 == 0x80).any():  # a text begins within a character
                        raise UnicodeError
                whole = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw_bytes)]).cast(pa.string())
                out = pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), whole)
            except UnicodeError:
                each = [raw_bytes[a:b].decode(errors="replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out = pa.array(each, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, text])

    return kept.mapInArrow(run, schema)
