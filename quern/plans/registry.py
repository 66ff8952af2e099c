"""Scorers by name, configured by dicts or YAML; all sample-level scorers of a call share one scan and one projection."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import clusters, lexical, novelty, pairwise, reasoning, spectral, tokens
from quern.operators import posterior as P

IGNORED = {"max_workers", "batch_size", "device", "device_batch_size", "model_dtype", "cache_dir", "encoder", "name", "type", "model", "max_length", "chunk_size"}
FIELDS = ("instruction", "input", "output")


def _f(c: Mapping[str, Any]) -> Column:
    return X.join_fields(*c.get("fields", FIELDS))


def _i(c: Mapping[str, Any]) -> Column:
    return X.join_sample(*FIELDS)


Make = Callable[[Mapping[str, Any]], Mapping[str, Column]]


def _one(make: Callable[[Mapping[str, Any]], Column]) -> Make:
    return lambda c: {"score": make(c)}


def _counts(c: Mapping[str, Any]) -> Mapping[str, Column]:
    words = list(c.get("logical_words", []) or c.get("fine_words", []))
    path = c.get("logical_words_path") or c.get("fine_words_path")
    if path:
        with open(path, encoding="utf-8") as f:
            words += lexical.read_words(f.read().splitlines())
    mode = c.get("match_mode", "substring")
    out = {"score": lexical.logical_word_count(_f(c), words, mode)}
    return out | ({"counts": lexical.logical_word_counts(_f(c), words, mode)} if c.get("return_counts") else {})


def _tree(c: Mapping[str, Any]) -> Mapping[str, Column]:
    got = tokens.tree_instruct(X.join_fields(*c.get("text_fields", FIELDS)), c.get("parser", tokens.chain_heads))
    return {"TreeInstruct_Nodes": got["nodes"], "TreeInstruct_Depth": got["depth"]}


#: Sample-level scorers over text fields.
SAMPLE: dict[str, Make] = {
    "CompressRatioScorer": _one(lambda c: lexical.compress_ratio(_f(c), c.get("level", 9))),
    "GramEntropyScorer": _one(lambda c: lexical.gram_entropy(_i(c))),
    "HddScorer": _one(lambda c: lexical.hdd(_i(c), c.get("sample_size", 42.0))),
    "LogicalWordCountScorer": _counts,
    "MtldScorer": _one(lambda c: lexical.mtld(_i(c), c.get("ttr_threshold", 0.72))),
    "PureThinkScorer": _one(lambda c: reasoning.pure_think(c.get("field", "output"))),
    "StrLengthScorer": _one(lambda c: lexical.str_length(*c.get("fields", FIELDS))),
    "ThinkOrNotScorer": _one(lambda c: reasoning.think_or_not(c.get("field", "output"))),
    "TokenEntropyScorer": _one(lambda c: tokens.token_entropy(_i(c), c.get("tokenizer", tokens.byte_tokens))),
    "TokenLengthScorer": _one(lambda c: tokens.token_length(_f(c), c.get("tokenizer", tokens.byte_tokens))),
    "TreeInstructScorer": _tree,
    "TsPythonScorer": _one(lambda c: reasoning.ts_python(c.get("field", "output"))),
    "UniqueNgramScorer": _one(lambda c: lexical.unique_ngram(_i(c), c.get("n", 2))),
    "UniqueNtokenScorer": _one(lambda c: tokens.unique_ntoken(_i(c), c.get("n", 2), c.get("tokenizer", tokens.byte_tokens))),
    "VocdDScorer": _one(lambda c: lexical.vocd(_i(c), c.get("ntokens", 50), c.get("within_sample", 100), c.get("seed", 42), c.get("mode", "expected"))),
}


def _logits(first: float = 0.0) -> Make:
    return _one(lambda c: P.class_expectation(F.col(c.get("column", "logits")), first))


def _same(column: str = "reward") -> Make:
    return _one(lambda c: F.col(c.get("column", column)))


def _struct(make: Callable[[Mapping[str, Any]], Column], names: Sequence[str]) -> Make:
    return lambda c: {n: make(c)[n] for n in names}


def _unieval(dimensions: Sequence[str], with_overall: bool = True) -> Make:
    def make(c: Mapping[str, Any]) -> Mapping[str, Column]:
        own = [d for d in c.get("dimensions", dimensions)]
        out = {f"UniEval_{d.capitalize()}": F.col(d) for d in own}
        return out | ({"UniEval_Overall": P.overall(*[F.col(d) for d in own])} if with_overall and c.get("overall", True) else {})

    return make


#: Score arithmetic over columns that a backend has put beside the samples.
POSTERIOR: dict[str, Make] = {
    "AskLlmScorer": _one(lambda c: P.ask_llm(F.col("logprobs"))),
    **{n: _same() for n in ("AtheneScorer", "Gpt2HarmlessScorer", "Gpt2HelpfulScorer", "InfOrmScorer", "RMDeBERTaScorer", "SkyworkLlamaScorer", "SkyworkQwenScorer")},
    **{n: _logits() for n in ("CleanlinessScorer", "ProfessionalismScorer", "ReadabilityScorer", "ReasoningScorer")},
    **{n: _logits(1.0) for n in ("DeitaCScorer", "DeitaQScorer")},
    "ComplexityScorer": lambda c: {"score": P.complexity(F.col("raw"), c.get("min_score", 1), c.get("max_score", 10)), "raw_output": F.col("raw")},
    "DebertaScorer": _one(lambda c: P.argmax(F.col("logits"))),
    "EffectiveRankScorer": _one(lambda c: spectral.spectrum_score(F.col("m"), "effective_rank")),
    "EmbedSVDEntropyScorer": _one(lambda c: spectral.spectrum_score(F.col("m"), "svd_entropy", c.get("svd_max_tokens", 512), c.get("svd_token_strategy", "tail"), c.get("eps", 1e-10))),
    "NuclearNormScorer": _one(lambda c: spectral.spectrum_score(F.col("m"), "nuclear_norm")),
    "FinewebEduScorer": _struct(lambda c: P.educational(F.col("reward"), c.get("threshold", 3)), ("score", "int_score", "keep")),
    "GraNdScorer": _one(lambda c: P.grand(F.col("norms"))),
    "HESScorer": _one(lambda c: P.hes(F.col("entropies"), c.get("percentile_cutoff", 0.005))),
    "IFDScorer": _one(lambda c: P.ifd(F.col("nll_conditioned"), F.col("nll"))),
    "InstagScorer": _one(lambda c: P.instag(F.col("raw"))),
    "NormLossScorer": _one(lambda c: P.norm_loss(F.col("nll"))),
    "PPLScorer": _one(lambda c: P.perplexity(F.col("nll"))),
    "SelectitTokenScorer": _one(lambda c: P.selectit_token(F.col("logits"))),
    "TextbookScorer": _one(lambda c: P.textbook(F.col("low"), F.col("mid"), F.col("high"))),
    "ThinkingProbScorer": _struct(lambda c: P.thinking_prob(F.col("p")), ("thinking_prob", "no_thinking_prob", "score")),
    "UPDScorer": _one(lambda c: P.upd(F.col("nll"), F.col("entropies"), c.get("vocabulary", 32000))),
    "UniEvalD2tScorer": _unieval(("naturalness", "informativeness")),
    "UniEvalDialogScorer": _unieval(("naturalness", "coherence", "engagingness", "groundedness", "understandability")),
    "UniEvalFactScorer": _unieval(("consistency",), False),
    "UniEvalSumScorer": _unieval(("coherence", "consistency", "fluency", "relevance")),
}

#: Scorers over frames of several rows per sample, or of whole datasets.
DATASET: dict[str, Callable[..., DataFrame]] = {
    "ApjsScorer": lambda df, c: pairwise.apjs(df, "id", _i(c), c.get("n", 1), c.get("similarity_method", "direct"), c.get("num_perm", 128), tokens.token_ids(_i(c), c.get("tokenizer", tokens.byte_tokens)) if c.get("tokenization_method") == "token" else None, c.get("sample_pairs")),
    "ApsScorer": lambda df, c: pairwise.aps(df, c.get("similarity_metric", "cosine"), c.get("sample_pairs")),
    "ClusterInertiaScorer": lambda df, c: clusters.cluster_inertia(df, c["centroids"], c.get("distance_metric", "cosine")),
    "FacilityLocationScorer": lambda df, c: pairwise.facility_location(df, c["subset"], c.get("distance_metric", "euclidean")),
    "KNNScorer": lambda df, c: pairwise.knn(df, c.get("k", 5), c.get("distance_metric", "euclidean")),
    "LogDetDistanceScorer": lambda df, c: spectral.log_det(df, c.get("ridge_alpha", 1e-10), c.get("extremes", True)),
    "NovelSumScorer": lambda df, c: novelty.novel_sum(df, c.get("reference"), c.get("density_powers", (0, 0.25, 0.5)), c.get("neighbors", (5, 10)), c.get("distance_powers", (0, 1, 2))),
    "PartitionEntropyScorer": lambda df, c: clusters.partition_entropy(df, c["num_clusters"]),
    "RadiusScorer": lambda df, c: spectral.radius(df),
    "VendiScorer": lambda df, c: spectral.vendi(df, c.get("similarity_metric", "cosine")),
    "Task2VecScorer": lambda df, c: pairwise.task2vec(df),
    "FailRateScorer": lambda df, c: P.fail_rate(df),
    "MIWVScorer": lambda df, c: pairwise.miwv(df, c["losses"], c.get("distance_metric", "cosine")),
    "QuRateScorer": lambda df, c: P.qurate(df, c.get("labels", ("writing_style", "required_expertise", "facts_and_trivia", "educational_value"))),
    "SelectitModelScorer": lambda df, c: P.selectit_model(df, c.get("model_weights"), c.get("alpha", 0.2)),
    "SelectitSentenceScorer": lambda df, c: P.selectit(df, c.get("alpha", 0.2)),
}


class Backend(Protocol):
    """A model: adds raw output columns to a batch of samples. schema: DDL of those columns."""

    schema: str

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def with_backend(df: DataFrame, backend: Backend) -> DataFrame:
    """df beside what the backend returns for it, batch by batch."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(backend.schema).fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.concat([f.reset_index(drop=True), backend.predict(f).reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, schema)


def configs(source: str | Mapping[str, Any] | Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """Scorer configurations of YAML text, a mapping or a list; the nested form {scorers: [{name, type, config}]} too."""
    if isinstance(source, str):
        import yaml

        source = yaml.safe_load(source)
    if isinstance(source, Mapping):
        source = source["scorers"] if "scorers" in source else [source]
    return [{"name": c.get("type", c["name"]), **c["config"]} if "config" in c else dict(c) for c in source]


def _checked(c: Mapping[str, Any]) -> Mapping[str, Any]:
    unused = sorted(IGNORED & set(c) - {"name", "type"})
    if unused:
        warnings.warn(f"{c['name']}: {', '.join(unused)} have no effect here; use the session's settings", stacklevel=3)
    return c


def score(df: DataFrame, scorers: str | Mapping[str, Any] | Sequence[Mapping[str, Any]], id_col: str = "id") -> DataFrame:
    """(id, one column per scorer output) in a single projection over df, which may be a stream.

    A lone 'score' output is named after its scorer; further ones are '<scorer>_<output>'. A scorer used twice needs 'as'.
    """
    present = {c.lower() for c in df.columns}
    full = df.select("*", *[F.lit(None).cast("string").alias(f) for f in FIELDS if f not in present])
    out: list[Column] = []
    for c in configs(scorers):
        make = SAMPLE.get(c["name"]) or POSTERIOR.get(c["name"])
        if make is None:
            raise ValueError(f"unknown sample scorer {c['name']}")
        label = c.get("as", c["name"])
        out += [x.alias(label if k == "score" else f"{label}_{k}") for k, x in make(_checked(c)).items()]
    return full.select(id_col, *out)


def evaluate(df: DataFrame, config: str | Mapping[str, Any]) -> DataFrame:
    """The dataset scorer's result for df, in the columns that its operator takes."""
    (c,) = configs(config)
    if c["name"] not in DATASET:
        raise ValueError(f"unknown dataset scorer {c['name']}")
    return DATASET[c["name"]](df, _checked(c))


def embed(df: DataFrame, id_col: str, text: Column, embedder: Callable[[list[str]], Any], dimension: int | None = None, max_tokens: int = 32_768, limit: tokens.Limit = tokens.byte_limit, batch: int = 16_384, report: bool = False) -> DataFrame:
    """(id, v): embeddings by a plug-in from texts to a matrix, `batch` texts at a time, each cut to max_tokens by limit; with
    report also `truncated`, whether it was cut. Embeddings of another width than dimension, if that is given, go."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                texts, cut = limit(part["t"].fillna("").tolist(), max_tokens)
                yield pd.DataFrame({"id": part["id"].tolist(), "v": [list(map(float, v)) for v in embedder(texts)], "truncated": cut})

    out = df.select(F.col(id_col).alias("id"), text.alias("t")).mapInPandas(run, f"id {kind}, v array<double>, truncated boolean")
    out = out if dimension is None else out.where(F.size("v") == dimension)
    return out if report else out.drop("truncated")


def hashing_embedder(dimension: int = 64) -> Callable[[list[str]], Any]:
    """A stand-in for tests: signed hashes of words."""
    import zlib

    import numpy as np

    def embed_(texts: list[str]):
        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimension] += 1 if h & 0x10000 else -1
        return out

    return embed_


SCORERS = sorted({*SAMPLE, *POSTERIOR, *DATASET})
