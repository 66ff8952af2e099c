"""Scorers over tokenizer and parser plug-ins.

A tokenizer is a function from texts to lists of ids. byte_tokens is the built-in stand-in (UTF-8 bytes); tiktoken_tokens loads
a vocabulary file of rank lines from a path.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text as X

Tokenizer = Callable[[Iterable[str]], list[list[int]]]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_tokens(texts: Iterable[str]) -> list[list[int]]:
    return [list(t.encode()) for t in texts]


def tiktoken_tokens(vocabulary: bytes, pattern: str = PATTERN) -> Tokenizer:
    """vocabulary: the content of a rank file, read on the driver."""
    made: list = []

    def tokens(texts: Iterable[str]) -> list[list[int]]:
        if not made:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
            made.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return [made[0].encode_ordinary(t) for t in texts]

    return tokens


#: From texts and a number of tokens to the texts cut to so many, and which were cut.
Limit = Callable[[list[str], int], tuple[list[str], list[bool]]]


def byte_limit(texts: list[str], most: int) -> tuple[list[str], list[bool]]:
    """Bytes as tokens; a character isn't parted."""
    raw = [t.encode() for t in texts]
    return [t if len(b) <= most else b[:most].decode(errors="ignore") for t, b in zip(texts, raw, strict=True)], [len(b) > most for b in raw]


def tiktoken_limit(vocabulary: bytes, pattern: str = PATTERN) -> Limit:
    """Tokens of a rank file's vocabulary; what is left of a parted character goes."""
    encode, of = tiktoken_tokens(vocabulary, pattern), {int(b): base64.b64decode(a) for a, b in map(bytes.split, vocabulary.splitlines()) if a}

    def limit(texts: list[str], most: int) -> tuple[list[str], list[bool]]:
        ids = encode(texts)
        return [t if len(x) <= most else b"".join(of[i] for i in x[:most]).decode(errors="ignore") for t, x in zip(texts, ids, strict=True)], [len(x) > most for x in ids]

    return limit


def token_ids(text: Column, tokenizer: Tokenizer = byte_tokens) -> Column:
    if tokenizer is byte_tokens:  # has a built-in form
        whole = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
        pairs = F.regexp_extract_all(whole, F.lit(".."), F.lit(0))
        return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        return pd.Series(tokenizer([t or "" for t in s]), dtype="object")

    return ids(text)


def _over_tokens(text: Column, tokenizer: Tokenizer, score: Callable[[list[int]], float]) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([score(t) for t in tokenizer([x or "" for x in s])], dtype="float64")

    return run(text)


def token_entropy(text: Column, tokenizer: Tokenizer = byte_tokens) -> Column:
    """Entropy in bits of the distribution of tokens; none: 0."""
    return _over_tokens(text, tokenizer, X.entropy_of)


def token_length(text: Column, tokenizer: Tokenizer = byte_tokens) -> Column:
    if tokenizer is byte_tokens:
        return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
    return _over_tokens(text, tokenizer, len).cast("long")


def unique_ntoken(text: Column, n: int = 2, tokenizer: Tokenizer = byte_tokens) -> Column:
    """Distinct over all n-grams of tokens; fewer than n tokens: 0."""
    return _over_tokens(text, tokenizer, lambda t: X.distinct_share(t, n))


def spacy_heads(model: str) -> Callable[[str], list[int]]:
    """A parser by a spaCy pipeline, where that is installed: each token's head, -1 for roots."""
    loaded: list = []

    def heads(text: str) -> list[int]:
        if not loaded:
            import spacy

            loaded.append(spacy.load(model))
        return [-1 if t.head.i == t.i else t.head.i for t in loaded[0](text)]

    return heads


def chain_heads(text: str) -> list[int]:
    """A stand-in parser: each word hangs on the word before it; head -1 is a root, each sentence has one."""
    heads: list[int] = []
    for sentence in text.replace("!", ".").replace("?", ".").split("."):
        for k, _ in enumerate(sentence.split()):
            heads.append(len(heads) - 1 if k else -1)
    return heads


def tree_shape(heads: list[int]) -> tuple[int, int]:
    """Nodes and greatest depth (a root has 1); heads that form no tree: (0, 0)."""
    depth: dict[int, int] = {}
    for i in range(len(heads)):
        path, at = [], i
        while at not in depth and at != -1:
            if at in path[-len(heads) :] and len(path) > len(heads) or not -1 <= heads[at] < len(heads):
                return 0, 0
            path.append(at)
            at = heads[at]
        base = depth.get(at, 0)
        for x in reversed(path):
            base += 1
            depth[x] = base
    return len(heads), max(depth.values(), default=0)


def tree_instruct(text: Column, parser: Callable[[str], list[int]] = chain_heads) -> Column:
    """struct(nodes, depth) of the dependency parse; empty or failing: 0, 0."""

    @F.pandas_udf("nodes int, depth int")
    def shape(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            try:
                rows.append(tree_shape(parser(t)) if t else (0, 0))
            except Exception:  # noqa: BLE001 - a parser's failure scores 0
                rows.append((0, 0))
        return pd.DataFrame(rows, columns=["nodes", "depth"])

    return shape(text)


def long_cot(total_tokens: Column, limit: int = 4096) -> Column:
    """Whether a sample takes the long chain-of-thought setting."""
    return total_tokens > limit
