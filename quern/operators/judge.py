"""Judging by a language model: prompts, fan-out, retries, validation, resumption and merging of scores.

The client is a plug-in: client(prompt, temperature, timeout) -> response text, called within tasks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Client = Callable[[str, float, float], str]
ASPECTS = ("Clarity", "Coherence", "Completeness", "Complexity", "Correctness", "Meaningfulness")
METRICS = ("Q_Code_Difficulty", "Q_Math_Difficulty", "QA_Relevance", *(f"{m}_{a}" for m in ("Q", "QA") for a in ASPECTS), "Q_All", "QA_All")
ALIASES = {"Meaningness": "Meaningfulness"}


def metric_name(name: str) -> str:
    """The canonical name; the other spelling is taken too."""
    for a, b in ALIASES.items():
        name = name.replace(a, b)
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}")
    return name


def keys_of(metric: str) -> tuple[str, ...]:
    """The scores a response must have."""
    metric = metric_name(metric)
    return ASPECTS if metric.endswith("_All") else (metric.split("_", 1)[1],)


def retry_plan(retries: int = 3, temperature: float = 0.1, wait: float = 1.0) -> list[tuple[float, float]]:
    """(temperature, seconds to wait before) of each attempt: both double, the temperature up to 1."""
    return [(min(1.0, temperature * 2**k), 0.0 if not k else wait * 2 ** (k - 1)) for k in range(retries + 1)]


def prompts(items: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    """(id, metric, prompt) for each item and metric; the metrics are a handful of literals."""
    rows = F.explode(F.array(*[F.struct(F.lit(metric_name(m)).alias("metric"), F.lit(t).alias("template")) for m, t in templates.items()])).alias("m")
    text = F.replace(F.replace(F.col("m.template"), F.lit("{instruction}"), F.coalesce("instruction", F.lit(""))), F.lit("{output}"), F.coalesce("output", F.lit("")))
    return items.select("id", "instruction", "output", rows).select("id", F.col("m.metric").alias("metric"), text.alias("prompt"))


def _score(raw: Column, key: str) -> Column:
    return F.get_json_object(raw, f"$.{key}")


def validated(responses: DataFrame, low: int = 1, high: int = 10) -> DataFrame:
    """responses (id, metric, raw) with scores map<string,int> and valid: JSON with every key of the metric an integer in bounds."""
    valid, scores = F.lit(None), F.lit(None)
    for m in METRICS:
        keys = keys_of(m)
        found = [F.coalesce(_score(F.col("raw"), k), _score(F.col("raw"), "Meaningness") if k == "Meaningfulness" else F.lit(None)) for k in keys]
        whole = [F.when(x.rlike(r"^-?\d{1,9}$"), x.try_cast("int")) for x in found]
        good = [F.coalesce(x.between(low, high), F.lit(False)) for x in whole]
        ok = good[0]
        for g in good[1:]:
            ok = ok & g
        valid = F.when(F.col("metric") == m, ok).otherwise(valid)
        scores = F.when(F.col("metric") == m, F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*whole))).otherwise(scores)
    out = responses.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return out.withColumn("scores", F.when(F.col("valid"), scores))


def python_valid(raw: str | None, metric: str, low: int = 1, high: int = 10) -> bool:
    """The same rule for one response, which decides about a retry."""
    import json

    try:
        x = json.loads(raw or "")
    except ValueError:
        return False
    if not isinstance(x, dict):
        return False
    if "Meaningness" in x:
        x.setdefault("Meaningfulness", x["Meaningness"])
    return all(isinstance(x.get(k), int) and not isinstance(x.get(k), bool) and low <= x[k] <= high for k in keys_of(metric))


def ask(requests: DataFrame, client: Client, retries: int = 3, temperature: float = 0.1, timeout: float = 30.0, wait: float = 1.0, concurrency: int = 32, chunk: int = 2048) -> DataFrame:
    """requests (id, metric, prompt) with raw and attempts; calls run concurrently within each task, `chunk` requests at a time."""
    kind = requests.schema["id"].dataType.simpleString()
    plan = retry_plan(retries, temperature, wait)

    def one(prompt: str, metric: str) -> tuple[str | None, int]:
        raw = None
        for n, (t, pause) in enumerate(plan, 1):
            time.sleep(pause)
            try:
                raw = client(prompt, t, timeout)
            except Exception:  # noqa: BLE001 - a failing call is tried again
                raw = None
            if python_valid(raw, metric):
                break
        return raw, n

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for f in (whole.iloc[a : a + chunk] for whole in frames for a in range(0, len(whole), chunk)):
                got = list(pool.map(one, f["prompt"], f["metric"]))
                yield f[["id", "metric"]].assign(raw=[r for r, _ in got], attempts=[n for _, n in got])

    return requests.mapInPandas(run, f"id {kind}, metric string, raw string, attempts int")


def grade(requests: DataFrame, model: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """requests with raw: what the model answers to the column prompt, batch by batch; a batch that fails gets empty answers."""

    def answers(part: list[str]) -> list[str]:
        try:
            got = list(model(part))
        except Exception:  # noqa: BLE001 - a failing batch is graded as unknown
            return [""] * len(part)
        return got if len(got) == len(part) else [""] * len(part)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["prompt"].fillna("").tolist()
            yield f.assign(raw=[x for a in range(0, len(texts), batch) for x in answers(texts[a : a + batch])])

    return requests.drop("raw").mapInPandas(run, T.StructType([*requests.drop("raw").schema.fields, T.StructField("raw", T.StringType())]))


def pending(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items whose id isn't tracked as done."""
    return items.join(done.select("id").distinct(), "id", "left_anti")


def split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored, errors)."""
    return judged.where("valid"), judged.where("not valid")


def merge_scores(items: DataFrame, scored: DataFrame) -> DataFrame:
    """items with the scores of each id filled into its scores map, where they are missing or null."""
    each = scored.select("id", "metric", F.explode("scores").alias("k", "v")).groupBy("id", F.concat_ws(".", "metric", "k").alias("k")).agg(F.max("v").alias("v"))
    new = each.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("new_scores"))
    empty = F.create_map().cast("map<string,int>")
    old = F.coalesce(items["scores"].cast("map<string,int>"), empty) if "scores" in items.columns else empty
    kept = F.map_filter(old, lambda _, v: v.isNotNull())
    fresh = F.coalesce("new_scores", empty)
    joined = items.join(new, "id", "left")
    filled = F.map_concat(kept, F.map_filter(fresh, lambda k, _: ~F.map_contains_key(kept, k)))
    nulls = F.map_filter(old, lambda k, v: v.isNull() & ~F.map_contains_key(fresh, k))
    return joined.withColumn("scores", F.map_concat(filled, nulls)).drop("new_scores")
