"""Evaluation reports: verdicts, accuracy, splits, test-set names and order, pivots, summary rules, submissions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = (
    "CV-Bench-2D CV-Bench-3D MathVista_MINI MathVision_MINI MathVerse_MINI Dynamath LogicVista VisuLogic AI2D ScienceQA SEEDBench2 "
    "MMBench_DEV_EN_V11 RealWorldQA MMStar MMMU_VAL MMMU_DEV ChartQA_TEST OCRBench CharXiv_reasoning_val CharXiv_descriptive_val"
).split()
ALIASES = {"AI2D_TEST": "AI2D", "ScienceQA_TEST": "ScienceQA", "MMMU_DEV_VAL": "MMMU_VAL"}
MODEL_PREFIXES = ("Qwen3-VL-8B-Instruct", "Qwen3-VL-8B", "Qwen3-VL")


# --- verdicts --------------------------------------------------------------------------------------------------------


def verdict(raw: Column, mode: str = "compat") -> Column:
    """A, B or C of a grader's answer.

    compat: by first letter, then a letter that stands alone, then words (so CORRECT is C and INCORRECT, unless it stands
    first, A), else its first ten characters. strict: words first, longest first; then letters; else UNKNOWN.
    """
    empty = raw.isNull() | (raw == "")
    up = F.upper(F.trim(F.regexp_replace(raw, r"^\s+|\s+$", "")))
    alone = lambda x: up.contains(f" {x} ") | up.endswith(f" {x}")
    if mode == "compat":
        out = F.when(empty, "UNKNOWN")
        for x in "ABC":
            out = out.when(up.startswith(x), x)
        for x in "ABC":
            out = out.when(alone(x), x)
        return out.when(up.contains("CORRECT"), "A").when(up.contains("INVALID"), "C").otherwise(F.substring(up, 1, 10))
    if mode != "strict":
        raise ValueError(f"unknown mode {mode}")
    out = F.when(empty | (up == ""), "UNKNOWN").when(up.contains("INCORRECT"), "B").when(up.contains("CORRECT"), "A").when(up.contains("INVALID"), "C")
    for x in "ABC":
        out = out.when(up.rlike(rf"(^|[^A-Z0-9]){x}([^A-Z0-9]|$)"), x)
    return out.otherwise("UNKNOWN")


def grader_prompt(question: Column, answer: Column, prediction: Column) -> Column:
    return F.concat(
        F.lit("Compare a candidate's reply with the reference. Reply A if it agrees, B if it doesn't, C if it can't be judged.\nQuestion: "), F.coalesce(question, F.lit("")),
        F.lit("\nReference: "), F.coalesce(answer, F.lit("")), F.lit("\nReply: "), F.coalesce(prediction, F.lit("")),
    )


def chosen_answer(answer: Column, option: Column) -> Column:
    """The option, where there is one, in place of the answer (MathVista_MINI)."""
    return F.when(F.trim(option) != "", F.trim(option)).otherwise(F.coalesce(answer, F.lit("")))


# --- accuracy --------------------------------------------------------------------------------------------------------


def accuracy(judged: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """(by, total, a_count, accuracy); unclear verdicts stay in the total."""
    return judged.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("judge") == "A").alias("a_count")).withColumn("accuracy", F.coalesce(F.try_divide("a_count", "total"), F.lit(0.0)))


def long_metrics(acc: DataFrame, key: str = "test_set") -> DataFrame:
    """(key, metric, value) rows total, A_count, accuracy."""
    return acc.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in (("total", "total"), ("A_count", "a_count"), ("accuracy", "accuracy"))])).alias("m")).select(key, "m.metric", "m.value")


def verdict_counts(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return judged.groupBy(*by, "judge").agg(F.count(F.lit(1)).alias("n"))


def by_split(judged: DataFrame) -> DataFrame:
    """Accuracy of the dev and validation parts of MMMU_DEV_VAL as MMMU_DEV and MMMU_VAL; empty parts don't appear."""
    name = F.when(F.col("split") == "dev", "MMMU_DEV").when(F.col("split") == "validation", "MMMU_VAL")
    return accuracy(judged.withColumn("test_set", name).where("test_set is not null"), ("test_set",))


def overall_accuracy(acc: DataFrame) -> DataFrame:
    """Micro average. One row."""
    return acc.agg(F.sum("a_count").alias("a_count"), F.sum("total").alias("total")).withColumn("accuracy", F.coalesce(F.try_divide("a_count", "total"), F.lit(0.0)))


# --- names and order -------------------------------------------------------------------------------------------------


def test_set_name(file: Column, model_prefix: str | None = None) -> Column:
    """The test set of a file '<model>_<test set>_acc.<ext>': after the given prefix, a known one or 'Instruct', else the
    longest ending of four parts or fewer that is known or ends in _TEST; else the whole."""
    base = F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"_acc\.[A-Za-z0-9]+$", "")
    out = F.when(F.lit(False), "")
    for p in ([model_prefix] if model_prefix else []) + list(MODEL_PREFIXES):
        out = out.when(base.startswith(f"{p}_"), F.substr(base, F.lit(len(p) + 2)))
    after = F.regexp_extract(base, r"(?:^|_)Instruct_(.+)$", 1)
    out = out.when(after != "", after).when(base.rlike("(^|_)Instruct$"), base)
    parts = F.split(base, "_")
    for n in (4, 3, 2, 1):
        tail = F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "_"))
        out = out.when(tail.isin(ORDER) | tail.endswith("_TEST"), tail)
    return F.nullif(out.otherwise(base), F.lit(""))


def rank(name: Column) -> Column:
    """Place in the report: by exact or alias name, without or with _TEST, by partial match; unknown ones last."""
    known = F.array(*[F.lit(x) for x in ORDER])
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    norm = F.coalesce(alias[name], name)
    norm = F.when(norm.contains("MMMU_DEV_VAL"), "MMMU_VAL").otherwise(norm)
    at = lambda x: F.nullif(F.array_position(known, x), F.lit(0))
    partial = F.nullif(F.array_position(F.transform(known, lambda x: norm.startswith(x) | norm.contains(x)), F.lit(True)), F.lit(0))
    return (F.coalesce(at(norm), at(F.replace(norm, F.lit("_TEST"), F.lit(""))), at(F.concat(norm, F.lit("_TEST"))), partial, F.lit(len(ORDER) + 1)) - 1).cast("int")


def transposed(acc: DataFrame, names: Sequence[str], key: str = "test_set") -> DataFrame:
    """One row per metric, test sets as columns in the given order."""
    return long_metrics(acc, key).groupBy("metric").pivot(key, list(names)).agg(F.first("value"))


# --- summary rules ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    key: str
    dataset: str
    metric: str | None = None
    prefix: bool = False
    average: bool = False


def _rule(text: str) -> Rule:
    """key=dataset/metric; no key: the data set's name; '^' after the data set: a prefix; no metric: any; '~' at the end: the mean."""
    key, _, rest = text.rpartition("=")
    name, _, metric = rest.rstrip("~").partition("/")
    prefix = name.endswith("^")
    name = name.rstrip("^")
    return Rule(key or name, name, metric or None, prefix, text.endswith("~"))


#: In the order of the summary's columns.
RULES = tuple(
    map(
        _rule,
        "drop/accuracy IFEval~ agieval/naive_average mmlu_pro^/accuracy~ gsm8k/accuracy math/accuracy math_prm800k_500/accuracy OmniMath OlympiadBench_OE_TO_maths_en_COMP/accuracy "
        "aime2024_accuracy=aime2024^/accuracy~ openai_humaneval sanitized_mbpp_score=sanitized_mbpp/score lcb_code_generation humaneval_plus "
        "ARC-c/accuracy bbh_naive_average=bbh/naive_average GPQA_diamond/accuracy calm_Accuracy=calm^/Accuracy~ korbench^/accuracy~".split(),
    )
)


def summarise(rows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(file, one text column per rule); rows (file, pos, dataset, metric, value string), pos the order within a file.

    No row: 'N/A'. Average: mean of the numeric values, 'error' if none is. Else: the first numeric value, 'error' if none is
    but some are there, 'N/A' if all are null.
    """
    out = []
    number = F.col("value").try_cast("double")
    for r in rules:
        hit = F.coalesce((F.col("dataset").startswith(r.dataset) if r.prefix else F.col("dataset") == r.dataset) & (F.lit(True) if r.metric is None else F.col("metric") == r.metric), F.lit(False))
        some, n = F.count_if(hit), F.count_if(hit & number.isNotNull())
        got = F.avg(F.when(hit, number)) if r.average else F.min(F.when(hit & number.isNotNull(), F.struct("pos", number.alias("x"))))["x"]
        bad = F.lit("error") if r.average else F.when(F.count_if(hit & F.col("value").isNotNull()) > 0, "error").otherwise("N/A")
        out.append(F.when(some == 0, "N/A").when(n == 0, bad).otherwise(got.cast("string")).alias(r.key))
    return rows.groupBy("file").agg(*out)


def summary_label(path: Column) -> Column:
    """'<prefix>-<time>-<suffix>.csv' of '.../<prefix>_<x>_<suffix>/<time>/summary/summary_*.csv'; other paths: null."""
    pattern = r"([^/]*)_[^_/]*_([^_/]*)/([^/]*)/summary/summary_[^/]*\.csv$"
    # a top folder with one underscore only keeps all before it as the prefix
    short = r"(?:^|/)([^_/]*)_([^_/]*)/([^/]*)/summary/summary_[^/]*\.csv$"
    name = lambda p: F.concat(F.regexp_extract(path, p, 1), F.lit("-"), F.regexp_extract(path, p, 3), F.lit("-"), F.regexp_extract(path, p, 2), F.lit(".csv"))
    return F.when(path.rlike(pattern), name(pattern)).when(path.rlike(short), name(short))


# --- submissions -----------------------------------------------------------------------------------------------------


def submission(rows: DataFrame) -> DataFrame:
    """(questionId, answer): rows without an index go, a missing prediction is empty; the index may be written as a decimal."""
    number = F.col("index").try_cast("double").cast("long")
    return rows.where(number.isNotNull()).select(number.alias("questionId"), F.coalesce(F.col("prediction").cast("string"), F.lit("")).alias("answer"))


#: Benchmarks by domain, with what grades them: a rule, a verifier model or a run of the code.
CATALOGUE = tuple(
    (domain, name, grader)
    for domain, graders in {
        "general": {"verifier": "DROP AGIEval MMLU-Pro", "rule": "IFEval"},
        "math": {"verifier": "OmniMath OlympiadBenchMath GSM8K MATH MATH-500 AIME_2024 AIME_2025 HMMT_Feb_2025 CMIMC_2025 BRUMO_2025"},
        "code": {"run": "HumanEval HumanEval+ MBPP LiveCodeBench"},
        "reasoning": {"verifier": "ARC-c BBH Kor-Bench GPQA", "rule": "CaLM"},
    }.items()
    for grader, names in graders.items()
    for name in names.split()
)
