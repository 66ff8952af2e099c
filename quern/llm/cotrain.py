"""Quality classifier by co-training: a text view and a metadata view exchange confident pseudo-labels.

Target: a document is good when its label says quality 1 and toxic 0. Text view: which words (of a vocabulary found in the
sample) and which shapes (binned shares of signs, capitals, repeats, ...) occur. Metadata view: language, source and length
class. Both are logistic regressions. In each round each view is calibrated on held-out labels and gives a pseudo-label to
every document without label that it is sure of; the other view is fitted again to the labels and to these. At the end the two
calibrated views are combined by a logistic regression on the held-out labels, and every document is scored.

Only labelled rows are sampled: the `labelled` documents with the smallest hashes, which also give the vocabulary. All others
take part in the exchange: their features (of those that tell something by half of the standard errors asked for) are found
once and written to the shared folder (copies with the same metadata once), and in a round each task adds up, by feature, the
pseudo-labels and the gradient of the other view's loss and a bound of its curvature. These sums (one row a feature, whole
numbers, so that their order doesn't matter) bound the loss over all pseudo-labels from above, and the driver lowers that bound together with the loss over the labels. Pseudo-labels together
weigh half of the labels, or less where each would weigh more than a label; so the fit is alike at every size.

Nulls and edge cases: labels with a null doc_id or both labels null are ignored, several labels of a document count as bad if
any is; a null or empty text has no words but a shape of its own; null metadata is a value of its own; without labels of both
classes every document is kept with probability 1 (good only or none) or 0 (bad only); repeated rows get the same score; extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, materialise, pieces, ship, text_bytes

WORD = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"[!-/:-@\[-`{-~]{2,}")


def text_features(text: str | None, wanted: set[str] | None = None) -> set[str]:
    """The distinct words; 'start^k' where k or more (to 3) of them start so; shapes as '#name=bin'. wanted: starts to tell."""
    if not text:
        return {"#empty"}
    found = WORD.findall(text.lower())
    distinct = set(found)
    tokens = text.split()
    n, m = len(text), max(len(found), 1)
    upper = sum(map(str.isupper, tokens)) / max(len(tokens), 1)
    lines = text.split("\n")
    signs = n - sum(map(text.count, (" ", "\n"))) - sum(map(len, found))
    shape = {
        "signs": signs / n * 20,
        "upper": upper * 10,
        "once": len(distinct) / m * 10 if m >= 20 else -1,
        "lines": len(set(lines)) / len(lines) * 5,
        "bars": text.count("|") / m * 20,
        "runs": len(RUN.findall(text)) / m * 20,
        "stops": (text.count(".") + text.count("!") + text.count("?")) / m * 40,
        "top": max(map(len, tokens), default=0) / 8,
        "many": np.log2(len(found) + 1),
    }
    heads = [[w[:n] for w in distinct if len(w) >= n] for n in (5, 7)]
    if wanted is not None:
        heads = [[*filter(wanted.__contains__, x)] for x in heads]
    for start, n in Counter(heads[0] + heads[1]).items():
        distinct.update([f"{start}^{k}" for k in range(1, min(n, 3) + 1)])
    distinct.update(f"#{k}={int(min(v, 20))}" for k, v in shape.items())
    return distinct


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> set[str]:
    size = "none" if n_chars is None else str(int(np.log2(max(n_chars, 0) + 1) * 2))
    return {f"lang={lang}", f"source={source}", f"size={size}", f"lang-size={lang}-{size}"}


@dataclass
class View:
    """A calibrated logistic regression over sets of features (by name, or by number while it is fitted)."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    by_number: np.ndarray | None = None

    def logit(self, features: set[str]) -> float:
        w = self.weights
        return self.slope * (self.bias + sum([w[f] for f in features if f in w])) + self.shift

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.slope * (self.bias + np.array([self.by_number[r].sum() for r in rows])) + self.shift

    def named(self, index: dict[str, int]) -> View:
        """As it is sent to the workers: features of no weight left out."""
        weights = {f: float(self.by_number[i]) for f, i in index.items() if self.by_number[i]}
        return View(weights, self.bias, self.slope, self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Pull:
    """What a view gets of the other one, by feature: shares of pseudo-labels, and gradient and bound of the curvature of their
    loss at the view's weights; the last entry is the bias. weight: that of all of them, where the labels' is 1."""

    good: np.ndarray
    bad: np.ndarray
    gradient: np.ndarray
    curvature: np.ndarray
    weight: float


def _apart(good: np.ndarray, bad: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """By how many standard errors the shares of good of n1 and bad of n0 differ."""
    share = (good + bad) / (n1 + n0)
    return np.abs(good / n1 - bad / n0) / _error(share, n1, n0, np.sqrt)


def _error(share, n1: float, n0: float, sqrt: Callable):
    """The standard error of the difference of two shares."""
    return sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)


def fit(rows: list[np.ndarray], y: np.ndarray, size: int, l2: float, least: int, z: float, steps: int = 400, pull: Pull | None = None, start: View | None = None) -> View:
    """Full-batch AdaGrad on features that at least `least` rows have and whose shares among good and bad rows differ by z
    standard errors or more."""
    every = np.concatenate([*rows, np.zeros(0, np.int32)])
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    count, good = np.bincount(every, minlength=size).astype(float), np.bincount(every, y[row], size)
    n1 = float(y.sum())
    n0 = len(y) - n1
    w0, b0 = np.zeros(size), float(np.log((n1 + 1) / (n0 + 1)))
    b = b0
    if pull is not None:
        as_rows = pull.weight * len(y)
        good = good + as_rows * pull.good[:-1]
        count = count + as_rows * (pull.good + pull.bad)[:-1]
        n1, n0 = n1 + as_rows * pull.good[-1], n0 + as_rows * pull.bad[-1]
        w0, b = start.by_number, start.bias
    tells = (count >= least) & (_apart(good, count - good, n1, n0) >= z)
    number = np.cumsum(tells) - 1
    use = tells[every]
    row, col, k = row[use], number[every[use]], int(tells.sum())
    w0, at = w0[tells], b
    w = w0.copy()
    gw, gb = np.full(k, 1e-8), 1e-8
    for _ in range(steps):
        e = _sigmoid(np.bincount(row, w[col], len(rows)) + b) - y
        g = np.bincount(col, e[row], k) / len(rows) + l2 * w
        d = e.mean() + l2 * (b - b0)
        if pull is not None:
            g += pull.weight * (pull.gradient[:-1][tells] + pull.curvature[:-1][tells] * (w - w0))
            d += pull.weight * (pull.gradient[-1] + pull.curvature[-1] * (b - at))
        gw += g * g
        w -= 0.3 * g / np.sqrt(gw)
        gb += d * d
        b -= 0.3 * d / np.sqrt(gb)
    weights = np.zeros(size)
    weights[tells] = w
    return View(bias=float(b), by_number=weights)


def _platt(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression on a few columns and a constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(y))])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * len(y) * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - target) + l2 * len(y) * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def calibrate(view: View, rows: list[np.ndarray], y: np.ndarray) -> View:
    view.slope, view.shift = 1.0, 0.0
    slope, shift = _platt(view.logits(rows)[:, None], y)
    view.slope, view.shift = max(float(slope), 0.0), float(shift)
    return view


@dataclass
class Model:
    text: View
    meta: View
    combine: tuple[float, float, float] = (1.0, 0.0, 0.0)
    constant: float | None = None
    heldout_accuracy: float = float("nan")
    exchanged: int = 0
    starts: set[str] | None = None

    def score(self, text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> tuple[float, float, float]:
        """Probability of good by the text view, the metadata view and both."""
        if self.constant is not None:
            return (self.constant,) * 3
        if self.starts is None:
            self.starts = {f[:-2] for f in self.text.weights if f[-2:-1] == "^"}
        a, b = self.text.logit(text_features(text, self.starts)), self.meta.logit(meta_features(lang, source, n_chars))
        both = self.combine[0] * a + self.combine[1] * b + self.combine[2]
        return tuple(float(1 / (1 + np.exp(-np.clip(v, -30, 30)))) for v in (a, b, both))


SETTINGS = [(1e-4, 4, 3.0), (1e-3, 5, 2.0)]  # of the text and the metadata view: l2, least, z
UNIT = 1 << 20  # of the gradient's sums


def cotrain(labelled: list[tuple[np.ndarray, np.ndarray, int]], index: tuple[dict[str, int], dict[str, int]], exchange: Callable[[list[View], int], tuple[list[Pull | None], int]], rounds: int = 3) -> Model:
    """labelled: (text features, metadata features, good) by number; every fifth is held out for calibration. exchange: what
    each view gets from the other one's pseudo-labels."""
    y = np.array([g for _, _, g in labelled], float)
    if len(set(y.tolist())) < 2:
        return Model(View(), View(), constant=float(y[0]) if len(y) else 1.0)
    held = np.arange(len(labelled)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(labelled), bool)
    train, check = np.flatnonzero(~held), np.flatnonzero(held if held.any() else ~held)
    data = [[labelled[i][v] for i in train] for v in (0, 1)]
    views: list[View] = []
    pulls: list[Pull | None] = [None, None]
    exchanged = 0
    for r in range(rounds + 1):
        views = [fit(data[v], y[train], len(index[v]), *SETTINGS[v], 200 if pulls[v] else 400, pulls[v], views[v] if views else None) if not r or pulls[v] else views[v] for v in (0, 1)]
        views = [calibrate(views[v], [labelled[i][v] for i in check], y[check]) for v in (0, 1)]
        if r == rounds:
            break
        pulls, exchanged = exchange(views, len(train))
        if pulls == [None, None]:
            break
    logits = np.column_stack([views[v].logits([labelled[i][v] for i in check]) for v in (0, 1)])
    a, b, c = _platt(logits, y[check])
    model = Model(views[0].named(index[0]), views[1].named(index[1]), (float(a), float(b), float(c)), exchanged=exchanged)
    model.heldout_accuracy = float((((logits @ [a, b]) + c > 0) == (y[check] > 0)).mean())
    return model


def _kind(n: int) -> str:
    """The type of numbers below n."""
    return "<u2" if n <= 1 << 16 else "<u4"


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of packed numbers and the row of each."""
    data, at = text_bytes(column)
    return np.frombuffer(data.tobytes(), kind).astype(np.int64), np.repeat(np.arange(len(column)), np.diff(at) // np.dtype(kind).itemsize)


def _sums(views, sure: float, kinds: list[str]):
    """(view, feature, good, bad, gradient, curvature): of the documents that the other view is sure of, how many with the
    feature it takes for good and for bad, and the sums over them of the view's error and of their number of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[View] = views.value
        total = [np.zeros((4, v.by_number.size + 1), np.int64) for v in own]
        for batch in batches:
            n = batch.num_rows
            flat = [_flat(batch.column(c), kind) for c, kind in zip(("t", "m"), kinds, strict=True)]
            z = [v.bias + np.bincount(row, v.by_number[f], n) for v, (f, row) in zip(own, flat, strict=True)]
            for v in (0, 1):
                other, (f, row) = own[1 - v], flat[v]
                p = _sigmoid(other.slope * z[1 - v] + other.shift)
                good, bad = p >= sure, p <= 1 - sure
                error = np.where(good | bad, np.rint((_sigmoid(z[v]) - good) * UNIT), 0)
                size = np.where(good | bad, np.bincount(row, minlength=n) + 1, 0)
                for k, x in enumerate((good, bad, error, size)):
                    total[v][k, :-1] += np.bincount(f, x[row], total[v].shape[1] - 1).astype(np.int64)
                    total[v][k, -1] += int(x.sum())
        for v in (0, 1):
            some = np.flatnonzero(total[v].any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.size, v)), pa.array(some), *(pa.array(x[some]) for x in total[v])], SUMS)

    return run


SUMS = ["v", "f", "good", "bad", "gradient", "curvature"]


def exchange_over(features: DataFrame, sure: float = 0.97) -> Callable[[list[View], int], tuple[list[Pull | None], int]]:
    """The exchange over all rows of features (t binary, m binary: packed numbers of features)."""
    spark = features.sparkSession

    def exchange(views: list[View], labels: int) -> tuple[list[Pull | None], int]:
        sent = spark.sparkContext.broadcast(views)
        rows = features.mapInArrow(_sums(sent, sure, [_kind(v.by_number.size) for v in views]), ", ".join(f"{c} long" for c in SUMS))
        got = rows.groupBy("v", "f").agg(*[F.sum(c).alias(c) for c in SUMS[2:]]).toArrow()
        v, f = got.column("v").to_numpy(), got.column("f").to_numpy()
        pulls: list[Pull | None] = []
        count = 0
        for k in (0, 1):
            total = np.zeros((4, views[k].by_number.size + 1))
            for j, c in enumerate(SUMS[2:]):
                total[j, f[v == k]] = got.column(c).to_numpy()[v == k]
            n = total[0, -1] + total[1, -1]
            count += int(n)
            good, bad, gradient, curvature = total / max(n, 1)
            # p (1 - p) <= 1/4, and a square of a sum of k terms <= k times the sum of squares
            pulls.append(Pull(good, bad, gradient / UNIT, curvature / 4, min(0.5, n / labels)) if n else None)
        return pulls, count

    return exchange


META = (("lang", "string"), ("source", "string"), ("n_chars", "long"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col("text"), *[F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in META]]


def _named_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches, "text", 2 << 20):
        text = [sorted(text_features(t)) for t in part.column("text").to_pylist()]
        meta = [sorted(meta_features(*x)) for x in zip(*(part.column(c).to_pylist() for c, _ in META), strict=True)]
        for v, lists in enumerate((text, meta)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, v)), part.column("good"), pa.array(lists, pa.list_(pa.string()))], ["v", "good", "f"])


def _numbered_features(known, keep: list[str]):
    """The columns `keep`, and the numbers of the features known in each view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, meta, starts = known.value
        kinds = _kind(len(text)), _kind(len(meta))
        pack = lambda found, numbers, kind: np.array(sorted(numbers[x] for x in found if x in numbers), kind).tobytes()
        for part in pieces(batches, "text", 2 << 20):
            t = [pack(text_features(x, starts), text, kinds[0]) for x in part.column("text").to_pylist()]
            m = [pack(meta_features(*x), meta, kinds[1]) for x in zip(*(part.column(c).to_pylist() for c, _ in META), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(t, pa.binary()), pa.array(m, pa.binary())], [*keep, "t", "m"])

    return run


def train(docs: DataFrame, labels: DataFrame, labelled: int = 6000, rounds: int = 3, sure: float = 0.97) -> Model:
    """Fits on the labels of the `labelled` documents with the smallest hashes of doc_id and on all other documents."""
    spark = docs.sparkSession
    ship(spark)
    place = F.xxhash64(F.lit("cotrain"), F.col("doc_id"))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    known = known.groupBy("doc_id").agg(F.min((F.coalesce("quality", F.lit(1)) >= 1) & (F.coalesce("toxic", F.lit(0)) <= 0)).cast("int").alias("good"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    chosen = materialise(ids.join(known, "doc_id").orderBy(place, "doc_id").limit(labelled).select("doc_id", "good"))
    own = docs.select("doc_id", *_columns(docs))
    sample = own.join(F.broadcast(chosen), "doc_id").withColumn("key", F.xxhash64("text"))
    sample = materialise(sample.groupBy("doc_id", "good").agg(F.min_by(F.struct("text", *[c for c, _ in META]), F.struct("key", *[c for c, _ in META])).alias("x")).select("doc_id", "good", "x.*"))
    n1, n0 = (sample.where(F.col("good") == g).count() for g in (1, 0))
    if not n1 or not n0:
        return Model(View(), View(), constant=0.0 if n0 else 1.0)
    # what may come to tell something: features that enough documents have and that tell by half of the standard errors that a
    # view asks for. They are counted in the cluster; those that don't tell never leave it.
    _, least, z = SETTINGS[0]
    each = sample.mapInArrow(_named_features, "v long, good int, f array<string>").select("v", "good", F.explode("f").alias("f"))
    counted = each.groupBy("v", "f").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")).where((F.col("v") == 1) | (F.col("n") >= least)).where(F.abs(F.col("good") / n1 - (F.col("n") - F.col("good")) / n0) >= F.when(F.col("v") == 0, _error(F.col("n") / (n1 + n0), n1, n0, F.sqrt) * z / 2).otherwise(0.0))
    names = [sorted(f for v, f in counted.select("v", "f").collect() if v == k) for k in (0, 1)]
    index = tuple({f: i for i, f in enumerate(x)} for x in names)
    numbers = spark.sparkContext.broadcast((*index, {f[:-2] for f in names[0] if f[-2:-1] == "^"}))
    packed = "t binary, m binary"
    place = F.xxhash64(F.lit("order"), "doc_id").alias("place")
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", place, "good", "text", *[c for c, _ in META]).mapInArrow(_numbered_features(numbers, ["doc_id", "place", "good"]), f"doc_id {kind}, place long, good int, {packed}").toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    lists = [[np.frombuffer(x, _kind(len(i))).astype(np.int64) for x in got.column(c).to_pylist()] for c, i in zip(("t", "m"), index, strict=True)]
    ready = list(zip(*lists, got.column("good").to_pylist(), strict=True))
    others = own.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").select(F.xxhash64("text").alias("key"), "text", *[c for c, _ in META])
    features = materialise(others.mapInArrow(_numbered_features(numbers, ["key"]), f"key long, {packed}").distinct())
    model = cotrain(ready, index, exchange_over(features, sure), rounds)
    for x in (features, sample, chosen):
        discard(x)
    return model


def _apply(model, keep_at: float | None, lang: str | None, source: str | None, chars: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        none = lambda n: [None] * n
        for part in pieces(batches, "text", 2 << 20):
            n = part.num_rows
            extra = [part.column(c).to_pylist() if c else none(n) for c in (lang, source, chars)]
            scores = np.array([m.score(*x) for x in zip(part.column("text").to_pylist(), *extra, strict=True)]).reshape(n, 3)
            if keep_at is not None:
                yield part.filter(pa.array(scores[:, 2] >= keep_at))
            else:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(scores[:, j]) for j in range(3)), pa.array(scores[:, 2] >= 0.5)], ["doc_id", "p_text", "p_meta", "score", "keep"])

    return run


def _parts(docs: DataFrame) -> list[str | None]:
    return [c if c in docs.columns else None for c in ("lang", "source", "n_chars")]


def score(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) for every document; keep: the combined probability of good is at least 1/2."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **params))
    own = docs.select("doc_id", "text", *[c for c in _parts(docs) if c])
    return own.mapInArrow(_apply(model, None, *_parts(docs)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, p_text double, p_meta double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """docs without those that score() rejects; all columns stay."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **params))
    return docs.mapInArrow(_apply(model, 0.5, *_parts(docs)), docs.schema)
