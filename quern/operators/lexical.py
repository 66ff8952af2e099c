"""Text statistics of single samples. Each takes a text column (see functions.text for the concatenation rules)."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X


def compress_ratio(text: Column, level: int = 9) -> Column:
    """Bytes after deflate over bytes before; empty or null: 0."""

    @F.pandas_udf("double")
    def ratio(s: pd.Series) -> pd.Series:
        raw = [(t or "").encode() for t in s]
        return pd.Series([len(zlib.compress(b, level)) / len(b) if b else 0.0 for b in raw], dtype="float64")

    return ratio(text)


def gram_entropy(text: Column) -> Column:
    """Entropy in bits of the word distribution; no words: 0."""
    return X.over_words(text, X.entropy_of)


def _absent(total: int, kinds: np.ndarray, n: int) -> np.ndarray:
    """For each count in kinds: the probability that none of n words drawn from total is of a type that often."""
    i = np.arange(n)
    return np.prod(np.maximum(total - kinds[:, None] - i, 0) / (total - i), axis=1)


def _hdd(tokens: list[str], sample_size: int) -> float:
    counts = X.counts_of(tokens)
    if not counts.size:
        return 0.0
    total = int(counts.sum())
    n = min(total, sample_size)
    kinds, many = np.unique(counts, return_counts=True)
    return float(((1 - _absent(total, kinds, n)) * many).sum() / n)


def hdd(text: Column, sample_size: float = 42.0, ascii_only: bool = False) -> Column:
    """HD-D: mean share of sample_size drawn words that a type contributes; texts with fewer words draw all of them."""
    return X.over_plain_words(text, lambda t: _hdd(t, int(sample_size)), ascii_only)


def logical_word_count(text: Column, words: list[str], mode: str = "substring") -> Column:
    """Occurrences of the words: of substrings that don't overlap, or of whole tokens. Blank words are ignored."""
    return F.aggregate(F.map_values(logical_word_counts(text, words, mode)), F.lit(0).cast("long"), lambda a, x: a + x)


def logical_word_counts(text: Column, words: list[str], mode: str = "substring") -> Column:
    """map<word, count> of the words; a text is parted into tokens once, however many words there are."""
    listed = list(dict.fromkeys(w.strip().lower() for w in words if w.strip()))
    low = F.lower(F.coalesce(text, F.lit("")))
    if not listed:
        return F.create_map().cast("map<string,bigint>")
    wanted = frozenset(listed)

    @F.pandas_udf("array<long>")
    def count(s: pd.Series) -> pd.Series:
        if mode == "substring":
            return pd.Series([[t.count(w) for w in listed] for t in s], dtype="object")
        found = [Counter(w for w in X.ASCII_SPACE(t) if w in wanted) for t in s]
        return pd.Series([[c[w] for w in listed] for c in found], dtype="object")

    return F.map_from_arrays(F.array(*[F.lit(w) for w in listed]), count(low if mode == "substring" else F.regexp_replace(low, rf"[!-/:-@\[-`{{-~{CJK}]", " ")))


def read_words(lines: list[str]) -> list[str]:
    """The words of a word file: one a line, '#' begins a comment."""
    return list(dict.fromkeys(w.lower() for w in (x.split("#")[0].strip() for x in lines) if w))


CJK = "　-〿＀-／：-＠［-｀｛-･"


def _mtld(tokens: list[str], threshold: float) -> float:
    def one_way(seq: list[str]) -> float:
        factors, seen, n = 0.0, set(), 0
        for t in seq:
            seen.add(t)
            n += 1
            if len(seen) / n <= threshold:
                factors, seen, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(seen) / n) / (1 - threshold)
        return len(seq) / factors if factors else float(len(seq))

    return (one_way(tokens) + one_way(tokens[::-1])) / 2 if tokens else 0.0


def mtld(text: Column, ttr_threshold: float = 0.72, ascii_only: bool = False) -> Column:
    """Mean length of runs whose type-token ratio stays above the threshold, forward and backward; no factor: the word count."""
    return X.over_plain_words(text, lambda t: _mtld(t, ttr_threshold), ascii_only)


def str_length(*fields: str | Column) -> Column:
    return F.char_length(X.join_fields(*fields)).cast("long")


def unique_ngram(text: Column, n: int = 2) -> Column:
    """Distinct over all n-grams of words; fewer than n words: 0."""
    return X.over_words(text, lambda t: X.distinct_share(t, n))


def ttr_curve(d: np.ndarray | float, n: np.ndarray) -> np.ndarray:
    return d / n * (np.sqrt(1 + 2 * n / d) - 1)


def fit_d(sizes: np.ndarray, ttr: np.ndarray) -> np.ndarray:
    """Least-squares D of each row of ttr, by golden section over log D of all rows at once."""
    g = (np.sqrt(5) - 1) / 2
    a, b = np.full(len(ttr), np.log(1e-2)), np.full(len(ttr), np.log(1e5))
    loss = lambda x: ((ttr_curve(np.exp(x)[:, None], sizes) - ttr) ** 2).sum(axis=1)
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = loss(x), loss(y)
    for _ in range(80):
        left = fx < fy
        a, b = np.where(left, a, x), np.where(left, y, b)
        new = np.where(left, b - g * (b - a), a + g * (b - a))
        f = loss(new)
        x, y, fx, fy = np.where(left, new, y), np.where(left, x, new), np.where(left, f, fy), np.where(left, fx, f)
    return np.exp((a + b) / 2)


def expected_ttr(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean type-token ratio of a draw without replacement, exactly."""
    total = int(counts.sum())
    kinds, many = np.unique(counts, return_counts=True)
    i = np.arange(int(sizes.max()))
    absent = np.cumprod(np.maximum(total - kinds[:, None] - i, 0) / (total - i), axis=1)[:, sizes - 1]
    return (many @ (1 - absent)) / sizes


def vocd(text: Column, ntokens: int = 50, within_sample: int = 100, seed: int = 42, mode: str = "expected", ascii_only: bool = False) -> Column:
    """D of the curve that fits mean type-token ratios of samples of 35 to ntokens words; fewer than ntokens words: 0.

    mode 'expected' takes the exact mean that draws approach (the same on every run); 'sampled' the mean of within_sample
    draws of each size, seeded by seed and the text.
    """
    if ntokens < 35:
        raise ValueError("ntokens must be 35 or more")
    sizes = np.arange(35, ntokens + 1)

    def ratios(tokens: list[str]) -> np.ndarray:
        if mode == "expected":
            return expected_ttr(X.counts_of(tokens), sizes)
        rng = np.random.default_rng([seed, zlib.crc32("\n".join(tokens).encode())])
        _, ids = np.unique(tokens, return_inverse=True)
        return np.array([np.mean([len(np.unique(rng.choice(ids, n, replace=False))) / n for _ in range(within_sample)]) for n in sizes])

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        out = np.zeros(len(s))
        tokens = [[w for w in X.ASCII_SPACE(t) if w] for t in s]
        long = [k for k, t in enumerate(tokens) if len(t) >= ntokens]
        if long:
            out[long] = fit_d(sizes, np.array([ratios(tokens[k]) for k in long]))
        return pd.Series(out)

    return score(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), X.ASCII_PUNCTUATION if ascii_only else X.PUNCTUATION, ""))


def gram_entropy_by_shuffle(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The same score by exploding words: for single texts that don't fit a row's expression."""
    rows = df.select(F.col(id_col).alias("id"), F.explode(X.words(text)).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("c"))
    return rows.groupBy("id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s")).select("id", (F.log2("n") - F.col("s") / F.col("n")).alias("score"))
