"""Column expressions over texts: concatenation rules, words, n-grams, word frequencies.

Strings stay in the JVM. What counts words is an Arrow function over whole batches: Spark interprets functions over array elements
one by one (gram entropy of 10,000 documents took 24 s that way, 3 s this way)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters and digits, or single other signs; the same in Java's and RE2's syntax.
WORD = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
PUNCTUATION = r"[\p{P}\p{S}]"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join_fields(*fields: str | Column) -> Column:
    """All non-empty fields, joined with line feeds."""
    return F.concat_ws("\n", *[F.nullif(col(f).cast("string"), F.lit("")) for f in fields])


def join_sample(instruction: str | Column, input_: str | Column | None, output: str | Column) -> Column:
    """instruction, input and output joined with line feeds; only an empty input is left out."""
    middle = [] if input_ is None else [F.nullif(col(input_), F.lit(""))]
    return F.concat_ws("\n", F.coalesce(col(instruction), F.lit("")), *middle, F.coalesce(col(output), F.lit("")))


def single(field: str | Column = "output") -> Column:
    return F.coalesce(col(field), F.lit(""))


def words(text: Column) -> Column:
    """Lower-case words and signs."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def plain_words(text: Column, ascii_only: bool = False) -> Column:
    """Parts between white space, in lower case, without punctuation; empty ones dropped."""
    parts = F.split(F.regexp_replace(F.lower(text), ASCII_PUNCTUATION if ascii_only else PUNCTUATION, ""), r"\s+")
    return F.filter(parts, lambda x: x != "")


WORDS = regex.compile(r"[\p{L}\p{N}]+|[^ \t\n\x0b\f\r\p{L}\p{N}]")


#: Rows of a batch that are Python objects at a time: a batch has up to 10,000, whose texts may be of any length.
SLICE = 64


def values(column: pa.Array) -> Iterator[Any]:
    """The column's values, of which few at a time are held as Python objects."""
    for k in range(0, len(column), SLICE):
        yield from column.slice(k, SLICE).to_pylist()


def scored(column: Column, score: Callable[[Any], float], parse: Callable[[Any], Any] | None = None, kind: str = "double") -> Column:
    """score(parse(value)) of each value as a double."""
    arrow = {"double": pa.float64(), "int": pa.int32()}[kind]

    @F.arrow_udf(kind)
    def run(s: pa.Array) -> pa.Array:
        got = pa.array([score(parse(x) if parse else x) for x in values(s)], arrow)
        pa.default_memory_pool().release_unused()
        return got

    return run(column)


def over_words(text: Column, score: Callable[[list[str]], float]) -> Column:
    """score of the words and signs of each text, which are those of words()."""
    return scored(F.coalesce(F.lower(text), F.lit("")), score, WORDS.findall)


def over_plain_words(text: Column, score: Callable[[list[str]], float], ascii_only: bool = False) -> Column:
    """score of the parts of each text, which are those of plain_words()."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ASCII_PUNCTUATION if ascii_only else PUNCTUATION, "")
    return scored(bare, score, lambda t: [w for w in ASCII_SPACE(t) if w])


ASCII_SPACE = regex.compile(r"[ \t\n\x0b\f\r]+").split


def counts_of(items: Iterable[Any]) -> np.ndarray:
    return np.array(sorted(Counter(items).values()), np.int64)


def entropy_of(items: Iterable[Any]) -> float:
    """Entropy in bits of the distribution of items; none: 0."""
    n = counts_of(items)
    if n.size < 2:
        return 0.0
    kinds, many = np.unique(n, return_counts=True)
    p = kinds / n.sum()
    return float(-(many * p * np.log2(p)).sum())


def distinct_share(items: Sequence[Any], n: int) -> float:
    """Distinct over all runs of n items; fewer than n: 0."""
    runs = len(items) - n + 1
    return len(set(zip(*(items[k:] for k in range(n)), strict=False))) / runs if runs > 0 else 0.0


def ngrams(items: Column, n: int) -> Column:
    """Runs of n items as strings (parted by U+0001); shorter lists have none."""
    return bind(
        items.cast("array<string>"),
        lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), "\x01"))).otherwise(F.array().cast("array<string>")),
    )
