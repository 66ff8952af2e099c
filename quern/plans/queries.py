"""The operators' queries over the test tables, each over whole tables: (spark, sf_dir) -> DataFrame.

The tables hold no model outputs, so parts of the embeddings stand in for logits, losses and rewards.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import clusters, contamination, evalreport, judge, lexical, novelty, pairwise, reasoning, spectral, tokens
from quern.operators import posterior as P
from quern.plans import registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
VOCABULARY = os.environ.get("QUERN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
LOGICAL_WORDS = ["the", "and", "because", "therefore", "von", "que"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as responses with thinking spans and code blocks."""
    code = F.lit("```python\nx = 1\n```")
    t = F.col("text")
    kind = F.col("doc_id") % 5
    out = (
        F.when(kind == 0, t)
        .when(kind == 1, F.concat(F.lit("<think>"), t, F.lit("</think> plain")))
        .when(kind == 2, F.concat(F.lit("<think>"), code, F.lit("</think>\n"), code))
        .when(kind == 3, F.concat(F.lit("<THINK >"), t, F.lit("</THINK>\n"), code))
        .otherwise(F.concat(F.lit("</redacted_reasoning>"), t))
    )
    return documents(spark, sf_dir).select("doc_id", out.alias("output"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction samples: each user turn with the assistant turn after it."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return a.join(b, ["conv_id", "turn"]).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "instruction", F.lit("").alias("input"), "output")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise.vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, centroid): means by label."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    m = e.groupBy("label", "d").agg(F.avg("x").alias("x"))
    return m.groupBy(F.col("label").alias("cluster_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"))


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for what models return."""
    v = F.col("v")
    absolute = lambda a, n: F.transform(F.slice(v, a, n), lambda x: F.abs(x))
    return embeddings(spark, sf_dir).select(
        "id", "v", F.slice(v, 1, 6).alias("l6"), F.slice(v, 1, 5).alias("l5"), F.slice(v, 1, 3).alias("l3"), F.get(v, F.lit(0)).alias("reward"), absolute(1, 16).alias("nll"), absolute(17, 16).alias("nll2"), absolute(33, 16).alias("entropies"),
        F.transform(F.slice(v, 49, 8), lambda x: -F.abs(x)).alias("logprobs"),
    )


# --- text ------------------------------------------------------------------------------------------------------------


@query
def h01_compress_ratio(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", r6(lexical.compress_ratio(F.col("text"))).alias("score"))


@query
def h02_gram_entropy(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", r6(lexical.gram_entropy(F.col("text"))).alias("score"))


@query
def h03_hdd(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", r6(lexical.hdd(F.col("text"))).alias("score"))


@query
def h04_logical_word_count(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", lexical.logical_word_count(t, LOGICAL_WORDS).alias("substrings"), lexical.logical_word_count(t, LOGICAL_WORDS, "token").alias("tokens"), F.element_at(lexical.logical_word_counts(t, LOGICAL_WORDS), "and").alias("and_count"))


@query
def h05_mtld(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", r6(lexical.mtld(F.col("text"))).alias("score"))


@query
def h06_pure_think(spark, sf_dir):
    return responses(spark, sf_dir).select("doc_id", reasoning.pure_think().alias("score"))


@query
def h07_str_length(spark, sf_dir):
    return samples(spark, sf_dir).select("id", lexical.str_length("instruction", "input", "output").alias("score"))


@query
def h08_think_or_not(spark, sf_dir):
    return responses(spark, sf_dir).select("doc_id", reasoning.think_or_not().alias("score"))


def tokenizer() -> tokens.Tokenizer:
    """A public vocabulary of 50,256 tokens."""
    with open(VOCABULARY, "rb") as f:
        return tokens.tiktoken_tokens(f.read())


@query
def h09_token_entropy(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", r6(tokens.token_entropy(F.col("text"), tokenizer())).alias("score"))


@query
def h10_token_length(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tokens.token_length(F.col("text"), tokenizer()).alias("score"))


@query
def h10_byte_length(spark, sf_dir):
    """Token length with bytes as tokens."""
    return documents(spark, sf_dir).select("doc_id", tokens.token_length(F.col("text")).alias("score"))


@query
def h11_tree_instruct(spark, sf_dir):
    t = tokens.tree_instruct(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", t["nodes"].alias("nodes"), t["depth"].alias("depth"))


@query
def h12_ts_python(spark, sf_dir):
    return responses(spark, sf_dir).select("doc_id", reasoning.ts_python().alias("score"))


@query
def h13_unique_ngram(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", r6(lexical.unique_ngram(F.col("text"), 2)).alias("score"))


@query
def h14_unique_ntoken(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", r6(tokens.unique_ntoken(F.col("text"), 2, tokenizer())).alias("score"))


@query
def h15_vocd(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", r6(lexical.vocd(F.col("text"))).alias("score"))


@query
def fused_scorers(spark, sf_dir):
    """Several scorers in one scan of the instruction samples."""
    names = ["StrLengthScorer", "GramEntropyScorer", "UniqueNgramScorer", "ThinkOrNotScorer", "TokenLengthScorer"]
    got = registry.score(samples(spark, sf_dir), [{"name": n} for n in names])
    return got.select("id", *[(r6(n) if "Entropy" in n or "Ngram" in n else F.col(n)).alias(n) for n in names])


@query
def long_cot_samples(spark, sf_dir):
    """Documents, as responses, of more than 4096 bytes."""
    s = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), tokens.token_length(F.col("text")).alias("total"))
    return s.where(tokens.long_cot(F.col("total")))


# --- datasets and embeddings -----------------------------------------------------------------------------------------


@query
def d01_apjs(spark, sf_dir):
    return pairwise.apjs(documents(spark, sf_dir), "doc_id", F.col("text"), n=3).select(r6("score").alias("score"), "num_samples", "num_pairs", "total_possible_pairs", "is_sampled")


@query
def d01_apjs_minhash(spark, sf_dir):
    return pairwise.apjs(documents(spark, sf_dir), "doc_id", F.col("text"), n=1, similarity_method="minhash").select(r6("score").alias("score"), "num_samples", "num_pairs")


@query
def d02_aps(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    out = None
    for m in ("cosine", "euclidean", "manhattan", "dot_product", "pearson"):
        one = pairwise.aps(e, m).select("similarity_metric", F.round("score", 5).alias("score"), "num_samples", "num_pairs")
        out = one if out is None else out.unionByName(one)
    return out


@query
def d03_cluster_inertia(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("cluster_id"))
    out = None
    for m in V.METRICS:
        one = clusters.cluster_inertia_by_cluster(s, centroids(spark, sf_dir), m).select(F.lit(m).alias("metric"), "cluster_id", "cluster_size", F.round("inertia", 5).alias("inertia"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def d04_facility_location(spark, sf_dir):
    e, sub = embeddings(spark, sf_dir), centroids(spark, sf_dir).select(F.col("cluster_id").cast("long").alias("id"), F.col("centroid").alias("v"))
    out = None
    for m in V.METRICS:
        one = pairwise.facility_location(e, sub, m)
        floats = ["facility_location_score", "avg_min_distance", "max_min_distance", "median_min_distance", "std_min_distance", "subset_ratio"]
        one = one.select("distance_metric", "num_samples", "num_subset_samples", *[F.round(c, 5).alias(c) for c in floats])
        out = one if out is None else out.unionByName(one)
    return out


@query
def d05_knn(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    out = None
    for m in ("euclidean", "cosine", "manhattan"):
        one = pairwise.knn(e, 5, m).select("id", F.lit(m).alias("metric"), r6("score").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def d06_log_det(spark, sf_dir):
    return spectral.log_det(embeddings(spark, sf_dir)).select(F.round("log_det", 3).alias("log_det"), "sign", "is_positive_definite", "num_samples", F.round("similarity_matrix_stats.mean", 6).alias("mean"), F.round("similarity_matrix_stats.min", 6).alias("min"))


@query
def d07_novel_sum(spark, sf_dir):
    got = novelty.novel_sum(embeddings(spark, sf_dir))
    return got.select("num_samples", *[F.round(f"`{c}`", 5).alias(c.replace(".", "_")) for c in got.columns if c != "num_samples"])


@query
def d08_partition_entropy(spark, sf_dir):
    got = clusters.partition_entropy(table(spark, sf_dir, "embeddings"), 12, "label")
    return got.select(r6("entropy").alias("entropy"), r6("normalized_entropy").alias("normalized_entropy"), r6("max_entropy").alias("max_entropy"), "num_samples", "num_clusters_in_subset", F.array_join(F.transform(F.array_sort(F.map_entries("cluster_counts")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("counts"))


@query
def d09_radius(spark, sf_dir):
    got = spectral.radius(embeddings(spark, sf_dir))
    return got.select(*[r6(c).alias(c) for c in ("radius", "geometric_mean_std", "arithmetic_mean_std", "min_std", "max_std", "median_std")], "num_samples", "embedding_dimension", "zero_std_dimensions")


@query
def d10_vendi(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    out = None
    for m in ("cosine", "pearson", "dot_product"):
        one = spectral.vendi(e, m).withColumn("vendi_score", F.round("vendi_score", 5))
        out = one if out is None else out.unionByName(one)
    return out


# --- model outputs ---------------------------------------------------------------------------------------------------

#: name -> output columns over raw_outputs(); those in WHOLE aren't rounded.
ROW_SCORES: dict[str, Callable[[], dict[str, Column]]] = {
    "m01_ask_llm": lambda: {"score": P.ask_llm(F.col("logprobs"))},
    **{n: (lambda: {"score": P.class_expectation(F.col("l6"))}) for n in ("m03_cleanliness", "m23_professionalism", "m26_readability", "m27_reasoning")},
    **{n: (lambda: {"score": P.class_expectation(F.col("l6"), 1.0)}) for n in ("m06_deita_c", "m07_deita_q")},
    "m05_deberta": lambda: {"class": P.argmax(F.col("l3"))},
    "m11_fineweb_edu": lambda: {"score": P.educational(F.col("reward") * 5)["score"], "int_score": P.educational(F.col("reward") * 5)["int_score"], "keep": P.educational(F.col("reward") * 5)["keep"]},
    "m14_grand": lambda: {"score": P.grand(F.col("nll"))},
    "m15_hes": lambda: {"score": P.hes(F.col("entropies"))},
    "m16_ifd": lambda: {"score": P.ifd(F.col("nll2"), F.col("nll"))},
    "m20_norm_loss": lambda: {"score": P.norm_loss(F.col("nll"))},
    "m22_ppl": lambda: {"score": P.perplexity(F.col("nll"))},
    "m30_selectit_token": lambda: {"score": P.selectit_token(F.col("l5"))},
    "m34_textbook": lambda: {"score": P.textbook(F.get("nll", F.lit(0)), F.get("nll", F.lit(1)), F.get("nll", F.lit(2)))},
    "m35_thinking_prob": lambda: {k: P.thinking_prob(F.get("nll", F.lit(0)))[k] for k in ("thinking_prob", "no_thinking_prob", "score")},
    "m36_upd": lambda: {"score": P.upd(F.col("nll"), F.col("entropies"), 32000)},
    "m37_unieval_d2t": lambda: {"overall": P.overall(*[F.get("nll", F.lit(k)) for k in range(2)])},
    "m38_unieval_dialog": lambda: {"overall": P.overall(*[F.get("nll", F.lit(k)) for k in range(5)])},
    "m40_unieval_sum": lambda: {"overall": P.overall(*[F.get("nll", F.lit(k)) for k in range(4)])},
}
WHOLE = {"class", "int_score", "keep"}


def _row_score(make: Callable[[], dict[str, Column]]) -> Query:
    return lambda spark, sf_dir: raw_outputs(spark, sf_dir).select("id", *[(c if n in WHOLE else r6(c)).alias(n) for n, c in make().items()])


QUERIES.update({n: _row_score(f) for n, f in ROW_SCORES.items()})


#: Scorers whose score is what their model returns.
REWARDS = ("AtheneScorer", "Gpt2HarmlessScorer", "Gpt2HelpfulScorer", "InfOrmScorer", "RMDeBERTaScorer", "SkyworkLlamaScorer", "SkyworkQwenScorer")


@query
def m_rewards(spark, sf_dir):
    """The reward scorers and the factual one, each over an output of its own."""
    v = embeddings(spark, sf_dir)
    raw = v.select("id", *[r6(F.get("v", F.lit(k))).alias(f"reward_{k}") for k in range(len(REWARDS))], r6(F.abs(F.get("v", F.lit(9)))).alias("consistency"))
    return registry.score(raw, [*({"name": n, "column": f"reward_{k}"} for k, n in enumerate(REWARDS)), {"name": "UniEvalFactScorer"}])


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated texts of several forms."""
    n = F.col("doc_id")
    kind = n % 6
    tags = (
        F.when(kind == 0, F.concat(F.lit('[{"tag": "a"}, {"tag": "b'), n.cast("string"), F.lit('"}]'))).when(kind == 1, F.lit('{"tag": "a"}')).when(kind == 2, F.lit("[]")).when(kind == 3, F.lit("not json")).when(kind == 4, F.lit("")).otherwise(F.lit("[1, 2, 3]"))
    )
    number = F.when(kind == 0, F.concat((n % 20).cast("string"), F.lit("\n<bor>"))).when(kind == 1, F.lit("<bos>0</eos>")).when(kind == 2, F.lit(" 7")).when(kind == 3, F.lit("none")).when(kind == 4, F.lit("")).otherwise(F.lit("4.5"))
    return documents(spark, sf_dir).select("doc_id", tags.alias("tags"), number.alias("number"))


@query
def m04_complexity(spark, sf_dir):
    return generated(spark, sf_dir).select("doc_id", P.complexity(F.col("number")).cast("double").alias("score"), F.col("number").alias("raw_output"))


@query
def m18_instag(spark, sf_dir):
    return generated(spark, sf_dir).select("doc_id", P.instag(F.col("tags")).alias("score"))


def _matrices(spark, sf_dir):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8))
    e = embeddings(spark, sf_dir).select("id", rows.alias("m"))
    each = e.select("id", F.explode(F.array(*[F.struct(F.lit(p).alias("projection"), F.lit(y).alias("layer")) for p in "QKVO" for y in (0, 1)])).alias("x"), "m")
    return each.select("id", "x.layer", "x.projection", F.when(F.col("x.layer") == 0, F.col("m")).otherwise(F.slice("m", 1, 4)).alias("m"))


@query
def m08_effective_rank(spark, sf_dir):
    return spectral.per_projection(_matrices(spark, sf_dir), "effective_rank").select("id", *[r6(p).alias(p) for p in "QKVO"])


@query
def m09_embed_svd_entropy(spark, sf_dir):
    return _matrices(spark, sf_dir).where("layer = 0 and projection = 'Q'").select("id", r6(spectral.spectrum_score(F.col("m"), "svd_entropy")).alias("score"))


@query
def m10_fail_rate(spark, sf_dir):
    e = raw_outputs(spark, sf_dir).select("id", F.explode(F.transform(F.slice("v", 1, 8), lambda x: x > 0)).alias("correct"))
    return P.fail_rate(e).select("id", r6("score").alias("score"))


@query
def m19_miwv(spark, sf_dir):
    losses = raw_outputs(spark, sf_dir).select("id", F.get("nll", F.lit(0)).alias("zero_shot"), F.get("nll", F.lit(1)).alias("one_shot"))
    return pairwise.miwv(embeddings(spark, sf_dir), losses).select("id", r6("score").alias("score"), "most_similar_id")


@query
def m21_nuclear_norm(spark, sf_dir):
    return spectral.per_projection(_matrices(spark, sf_dir), "nuclear_norm").select("id", *[r6(p).alias(p) for p in "QKVO"])


@query
def m24_qurate(spark, sf_dir):
    e = raw_outputs(spark, sf_dir)
    chunks = e.select("id", F.posexplode(F.array(*[F.slice("v", 4 * k + 1, 4) for k in range(3)])).alias("chunk_no", "scores")).withColumn("n_tokens", F.lit(512) - F.col("chunk_no") * 100)
    got = P.qurate(chunks, ("style", "expertise", "facts", "value"))
    return got.select("id", *[r6(c).alias(c) for c in ("style", "expertise", "facts", "value")], r6(F.get("style_chunks", F.lit(2))).alias("style_last"))


def _ratings(spark, sf_dir):
    e = raw_outputs(spark, sf_dir)
    return e.select("id", F.posexplode(F.array(*[F.slice("v", 5 * k + 1, 5) for k in range(10)])).alias("p", "logits")).select("id", F.when(F.col("p") < 5, "a").otherwise("b").alias("model"), (F.col("p") % 5).alias("prompt_no"), "logits")


@query
def m28_selectit_model(spark, sf_dir):
    return P.selectit_model(_ratings(spark, sf_dir), {"a": 0.7, "b": 0.3}).select("id", r6("score").alias("score"))


@query
def m29_selectit_sentence(spark, sf_dir):
    return P.selectit(_ratings(spark, sf_dir).where("model = 'a'")).select("id", r6("score").alias("score"))


@query
def m33_task2vec(spark, sf_dir):
    return pairwise.task2vec(embeddings(spark, sf_dir)).select(r6("score").alias("score"), "num_samples")


@query
def prompt_builders(spark, sf_dir):
    s = samples(spark, sf_dir)
    q, a = F.col("instruction"), F.col("output")
    return s.select("id", P.human_assistant(q, F.col("input"), a).alias("human"), P.instruction_prompt(q, F.col("input")).alias("instruct"), P.one_shot_prompt(q, a, q).alias("one_shot"), P.rating_prompt("Rate: {instruction} => {output}", q, a).alias("rating"))


# --- judging ---------------------------------------------------------------------------------------------------------


@query
def j01_prompts(spark, sf_dir):
    return judge.prompts(samples(spark, sf_dir), {"Q_Clarity": "Clear? {instruction}", "QA_Correctness": "Right? {instruction} / {output}"})


def _judged(spark, sf_dir):
    n = F.col("doc_id")
    raw = F.when(n % 5 == 0, F.concat(F.lit('{"Clarity": '), (n % 13).cast("string"), F.lit("}"))).when(n % 5 == 1, F.lit('{"Clarity": 4.5}')).when(n % 5 == 2, F.lit("no json")).when(n % 5 == 3, F.lit('{"Other": 3}')).otherwise(F.lit('{"Clarity": 10, "x": 1}'))
    return documents(spark, sf_dir).select(n.alias("id"), F.lit("Q_Clarity").alias("metric"), raw.alias("raw"))


@query
def j02_validation(spark, sf_dir):
    return judge.validated(_judged(spark, sf_dir)).select("id", "valid", F.element_at("scores", "Clarity").cast("double").alias("clarity"))


@query
def j03_resume(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return judge.pending(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source"), done)


@query
def j04_merge(spark, sf_dir):
    scored, _ = judge.split(judge.validated(_judged(spark, sf_dir)))
    items = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source")
    return judge.merge_scores(items, scored).select("id", "source", F.element_at("scores", "Q_Clarity.Clarity").cast("double").alias("clarity"))


# --- evaluation ------------------------------------------------------------------------------------------------------

ANSWERS = ["A", "b.", "CORRECT", "INCORRECT", "INVALID", "The grade is B", "The answer is correct", "hmm maybe so", "", "   ", "it is c here", "grade: incorrect"]


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graders' answers of every form, by document; source stands for the test set, lang for the split."""
    raw = F.get(F.array(*[F.lit(a) for a in ANSWERS]), (F.col("doc_id") % len(ANSWERS)).cast("int"))
    part = F.when(F.col("lang") == "en", "dev").when(F.col("lang") == "fr", "validation").otherwise("test")
    return documents(spark, sf_dir).select("doc_id", F.col("source").alias("file"), part.alias("split"), raw.alias("raw")).withColumn("judge", evalreport.verdict(F.col("raw")))


@query
def e01_verdicts(spark, sf_dir):
    return graded(spark, sf_dir).select("doc_id", "judge", evalreport.verdict(F.col("raw"), "strict").alias("strict"))


@query
def e02_accuracy(spark, sf_dir):
    return evalreport.accuracy(graded(spark, sf_dir)).withColumn("accuracy", r6("accuracy"))


@query
def e03_verdict_counts(spark, sf_dir):
    return evalreport.verdict_counts(graded(spark, sf_dir))


@query
def e04_split_accuracy(spark, sf_dir):
    return evalreport.by_split(graded(spark, sf_dir)).withColumn("accuracy", r6("accuracy"))


@query
def e05_overall(spark, sf_dir):
    return evalreport.overall_accuracy(evalreport.accuracy(graded(spark, sf_dir))).withColumn("accuracy", r6("accuracy"))


@query
def e06_transposed(spark, sf_dir):
    acc = evalreport.accuracy(graded(spark, sf_dir)).withColumnRenamed("file", "test_set")
    got = evalreport.transposed(acc, [f"src{k}" for k in range(20)])
    return got.select("metric", *[r6(c).alias(c) for c in got.columns if c != "metric"])


@query
def e07_test_set_names(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("Qwen3-VL-8B-Instruct_AI2D_TEST", "Qwen3-VL_MMMU_DEV_VAL", "My-Model_CV-Bench-2D", "Other_Instruct_OCRBench", "x_y_ChartQA_TEST", "unknown")])
    path = F.concat(F.lit("/out/"), F.get(names, (F.col("doc_id") % 6).cast("int")), F.lit("_acc.csv"))
    d = documents(spark, sf_dir).select("doc_id", evalreport.test_set_name(path).alias("test_set"))
    return d.withColumn("rank", evalreport.rank(F.col("test_set")))


def _numbers(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Each column as a number (9 places) and, where it is none, as what it says."""
    number = lambda k: F.round(F.col(f"`{k}`").try_cast("double"), 9) + F.lit(0.0)
    return summary.select("file", *[c for k in keys for c in (number(k).alias(k), F.when(number(k).isNull(), F.col(f"`{k}`")).alias(f"{k}_status"))])


@query
def e08_summary(spark, sf_dir):
    """Events as benchmark rows: the type is the data set, the user the file."""
    v = F.when(F.col("event_id") % 7 == 0, F.lit("bad")).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value").cast("decimal(18,3)").cast("string"))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("pos"), F.col("event_type").alias("dataset"), F.when(F.col("event_id") % 2 == 0, "accuracy").otherwise("score").alias("metric"), v.alias("value"))
    rules = [evalreport.Rule("click_first", "click", "accuracy"), evalreport.Rule("c_average", "c", None, True, True), evalreport.Rule("none", "no such")]
    return _numbers(evalreport.summarise(rows, rules), [r.key for r in rules])


@query
def e10_rule_table(spark, sf_dir):
    """All rules in their order, over events as rows of summary files whose names are derived from their paths."""
    n, u = F.col("event_id"), F.col("user_id")
    names = [r.dataset for r in evalreport.RULES] + ["mmlu_pro_law", "aime2024_ii", "calm_x", "korbench_logic", "math_500"]
    metrics = [r.metric or "pass" for r in evalreport.RULES] + ["accuracy", "accuracy", "Accuracy", "score", "accuracy"]
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (n % len(names)).cast("int"))
    path = F.concat(F.lit("/runs/lab_"), (u % 3).cast("string"), F.lit("_s"), (u % 4).cast("string"), F.lit("/20"), (u % 5).cast("string"), F.lit("/summary/summary_a.csv"))
    v = F.when(n % 7 == 0, F.lit("-")).when(n % 11 == 0, F.lit(None)).otherwise(F.col("value").cast("decimal(18,3)").cast("string"))
    rows = table(spark, sf_dir, "events").select(evalreport.summary_label(path).alias("file"), n.alias("pos"), pick(names).alias("dataset"), pick(metrics).alias("metric"), v.alias("value"))
    return _numbers(evalreport.summarise(rows), [r.key for r in evalreport.RULES])


@query
def e09_submission(spark, sf_dir):
    n = F.col("doc_id")
    index = F.when(n % 3 == 0, F.lit(None)).when(n % 3 == 1, n.cast("string")).otherwise(F.concat(n.cast("string"), F.lit(".0")))
    return evalreport.submission(documents(spark, sf_dir).select(index.alias("index"), F.when(n % 4 == 0, F.lit(None)).otherwise(F.col("text")).alias("prediction")))


@query
def x01_contamination(spark, sf_dir):
    """Share of each benchmark item's 8-grams that a document holds, for pairs that share any."""
    return contamination.shares(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), 8).select("doc_id", "item_id", r6("share").alias("share"))


@query
def report(spark, sf_dir):
    """Documents, characters and mean word entropy by source and language."""
    d = documents(spark, sf_dir).select("source", "lang", lexical.str_length("text").alias("n"), lexical.gram_entropy(F.col("text")).alias("e"))
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chars"), r6(F.avg("e")).alias("mean_entropy"))
