"""Score arithmetic over what models return. Inference itself is a plug-in (see plans.registry.Backend)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import vectors as V


def ask_llm(logprobs: Column) -> Column:
    """Mean log-probability of the yes tokens; none: -100."""
    return F.coalesce(V.mean(logprobs), F.lit(-100.0))


def class_expectation(logits: Column, first: float = 0.0) -> Column:
    """Cleanliness, Professionalism, Readability, Reasoning (from 0), Deita complexity and quality (from 1)."""
    return V.softmax_mean(logits, first)


def complexity(raw: Column, low: int = 1, high: int = 10) -> Column:
    """The first number of the generated text between its optional markers, clamped; none: null."""
    found = F.nullif(F.regexp_extract(raw, r"^\s*(?:<bos>)?\s*(\d{1,9})", 1), F.lit(""))
    return F.when(found.isNotNull(), F.greatest(F.least(found.cast("int"), F.lit(high)), F.lit(low)))


def argmax(logits: Column) -> Column:
    """The first class with the greatest logit, from 0."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def fail_rate(attempts: DataFrame) -> DataFrame:
    """(id, score): share of wrong attempts; an ungraded attempt counts as wrong."""
    return attempts.groupBy("id").agg((1 - F.avg(F.coalesce("correct", F.lit(False)).cast("int"))).alias("score"))


def boxed_answer(text: Column) -> Column:
    r"""The content of the last \boxed{} without braces inside; none: null."""
    return X.bind(F.regexp_extract_all(text, F.lit(r"\\boxed\{([^{}]*)\}"), F.lit(1)), lambda a: F.get(a, F.size(a) - 1))


def educational(score: Column, threshold: float = 3) -> Column:
    """struct(score, int_score, keep)."""
    whole = F.round(F.greatest(F.least(score, F.lit(5.0)), F.lit(0.0))).cast("int")
    return F.struct(score.alias("score"), whole.alias("int_score"), (whole >= threshold).alias("keep"))


def grand(norms: Column) -> Column:
    """Norm of the gradient from the norms of its parts."""
    return V.norm(norms)


def hes(entropies: Column, cutoff: float = 0.005) -> Column:
    """Sum of the entropies at or above their (1 - cutoff) percentile (linear); none: 0."""

    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(1 - cutoff)
        low = F.floor(place).cast("int")
        return X.bind(F.get(s, low) + (place - low) * (F.coalesce(F.get(s, low + 1), F.get(s, low)) - F.get(s, low)), lambda t: F.aggregate(F.filter(s, lambda v: v >= t), F.lit(0.0), lambda a, v: a + v))

    return F.when(F.size(entropies) > 0, X.bind(F.array_sort(entropies), at)).otherwise(F.lit(0.0))


def ifd(conditioned: Column, direct: Column) -> Column:
    """Perplexity of the answer given the question over that without."""
    return F.exp(V.mean(conditioned) - V.mean(direct))


def instag(raw: Column) -> Column:
    """Tags in generated JSON: the list's length; an object is one; anything else 0."""
    return F.coalesce(F.json_array_length(raw), F.when(F.get_json_object(raw, "$").startswith("{"), F.lit(1)), F.lit(0))


def norm_loss(nll: Column) -> Column:
    """Mean loss in bits."""
    return V.mean(nll) / F.log(F.lit(2.0))


def perplexity(nll: Column, mask: Column | None = None) -> Column:
    """exp of the mean loss; mask leaves padding out."""
    if mask is not None:
        nll = F.filter(F.zip_with(nll, mask, lambda v, m: F.when(m > 0, v)), lambda v: v.isNotNull())
    return F.exp(V.mean(nll))


def qurate(chunks: DataFrame, labels: Sequence[str] = ("writing_style", "required_expertise", "facts_and_trivia", "educational_value")) -> DataFrame:
    """(id, one token-weighted mean and one array of chunk scores per label); chunks (id, chunk_no, n_tokens, scores)."""
    out = [F.array_sort(F.collect_list(F.struct("chunk_no", "n_tokens", "scores"))).alias("x")]
    got = chunks.groupBy("id").agg(*out)
    w = F.aggregate("x", F.lit(0.0), lambda a, c: a + c["n_tokens"])

    def of(k: int, name: str) -> list[Column]:
        total = F.aggregate("x", F.lit(0.0), lambda a, c: a + c["n_tokens"] * F.get(c["scores"], F.lit(k)))
        return [F.try_divide(total, w).alias(name), F.transform("x", lambda c: F.get(c["scores"], F.lit(k))).alias(f"{name}_chunks")]

    return got.select("id", *[c for k, name in enumerate(labels) for c in of(k, name)])


def selectit(ratings: DataFrame, alpha: float = 0.2) -> DataFrame:
    """(id, score): mean rating over prompts / (1 + alpha * population deviation); ratings (id, prompt_no, logits), 1 to 5."""
    each = ratings.select("id", V.softmax_mean(F.col("logits"), 1.0).alias("r"))
    return each.groupBy("id").agg((F.avg("r") / (1 + alpha * F.stddev_pop("r"))).alias("score"))


def selectit_model(ratings: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.2) -> DataFrame:
    """(id, score): selectit() for each model, weighted (equal weights by default); ratings have a model column."""
    each = ratings.select("id", "model", V.softmax_mean(F.col("logits"), 1.0).alias("r")).groupBy("id", "model").agg((F.avg("r") / (1 + alpha * F.stddev_pop("r"))).alias("s"))
    if weights is None:
        return each.groupBy("id").agg(F.avg("s").alias("score"))
    pairs = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return each.groupBy("id").agg(F.sum(F.col("s") * F.coalesce(pairs[F.col("model")], F.lit(0.0))).alias("score"))


def selectit_token(logits: Column) -> Column:
    """Expected rating of one prompt; missing: 3."""
    return F.coalesce(V.softmax_mean(logits, 1.0), F.lit(3.0))


def textbook(low: Column, mid: Column, high: Column) -> Column:
    return 0 * low + 1 * mid + 2 * high


def thinking_prob(p: Column) -> Column:
    """struct(thinking_prob, no_thinking_prob, score)."""
    return F.struct(p.alias("thinking_prob"), (1 - p).alias("no_thinking_prob"), (1 - p).alias("score"))


def upd(nll: Column, entropies: Column, vocabulary: int) -> Column:
    """Mean over tokens of sigmoid(loss) * max(0, 1 - entropy / ln vocabulary); none: 0."""
    import math

    top = math.log(vocabulary)
    return F.coalesce(V.mean(F.zip_with(nll, entropies, lambda v, h: 1 / (1 + F.exp(-v)) * F.greatest(F.lit(0.0), 1 - h / top))), F.lit(0.0))


def overall(*dimensions: Column) -> Column:
    """Arithmetic mean of the dimensions (UniEval)."""
    return sum(dimensions[1:], dimensions[0]) / len(dimensions)


# --- prompts ---------------------------------------------------------------------------------------------------------


def human_assistant(instruction: Column, input_: Column | None, output: Column) -> Column:
    question = instruction if input_ is None else F.concat_ws("\n", instruction, F.nullif(input_, F.lit("")))
    return F.concat(F.lit("\n\nHuman: "), F.coalesce(question, F.lit("")), F.lit("\n\nAssistant: "), F.coalesce(output, F.lit("")))


def instruction_prompt(instruction: Column, input_: Column | None = None) -> Column:
    head = F.concat(F.lit("### Instruction:\n"), F.coalesce(instruction, F.lit("")))
    middle = F.lit("") if input_ is None else F.coalesce(F.concat(F.lit("\n\n### Input:\n"), F.nullif(input_, F.lit(""))), F.lit(""))
    return F.concat(head, middle, F.lit("\n\n### Response:\n"))


def one_shot_prompt(example_question: Column, example_answer: Column, question: Column) -> Column:
    return F.concat(F.lit("Example question:\n"), example_question, F.lit("\nExample answer:\n"), example_answer, F.lit("\n\nQuestion:\n"), question, F.lit("\nAnswer:\n"))


def rating_prompt(template: str, instruction: Column, output: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{instruction}"), F.coalesce(instruction, F.lit(""))), F.lit("{output}"), F.coalesce(output, F.lit("")))
