"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

from quern.operators.evalreport import Rule

ORACLES: dict[str, str] = {}

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"
ALL_DOCS = "SELECT doc_id FROM documents"

ORACLES["h02_gram_entropy"] = f"""
WITH t AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY ALL),
n AS (SELECT doc_id, c, sum(c) OVER (PARTITION BY doc_id) AS n FROM c), e AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS e FROM n GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(e, 0.0), 6) + 0.0 AS score FROM documents d LEFT JOIN e USING (doc_id)
"""

ORACLES["h03_hdd"] = r"""
WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[\p{P}\p{S}]', '', 'g'), '\s+'), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS k FROM t GROUP BY ALL), n AS (SELECT doc_id, sum(k)::BIGINT AS n FROM c GROUP BY doc_id),
g AS (SELECT doc_id, n, k, count(*) AS m FROM c JOIN n USING (doc_id) GROUP BY ALL),
p AS (SELECT doc_id, n, m, list_product(list_transform(range(0, least(42, n)), lambda i: greatest(n - k - i, 0)::DOUBLE / (n - i))) AS p0 FROM g),
s AS (SELECT doc_id, sum(m * (1 - p0)) / least(42, any_value(n)) AS s FROM p GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(s, 0.0), 6) + 0.0 AS score FROM documents d LEFT JOIN s USING (doc_id)
"""

WORDS = ["the", "and", "because", "therefore", "von", "que"]
_sub = lambda w: f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}"
_tok = r"string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~　-〿＀-／：-＠［-｀｛-･]', ' ', 'g'), '\s+')"
ORACLES["h04_logical_word_count"] = f"""
SELECT doc_id, CAST({" + ".join(map(_sub, WORDS))} AS BIGINT) AS substrings,
  CAST(len(list_filter({_tok}, lambda x: x IN ({", ".join(f"'{w}'" for w in WORDS)}))) AS BIGINT) AS tokens, CAST({_sub("and")} AS BIGINT) AS and_count FROM documents
"""

RESPONSES = r"""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '<think>' || text || '</think> plain'
  WHEN 2 THEN '<think>' || code || '</think>' || chr(10) || code WHEN 3 THEN '<THINK >' || text || '</THINK>' || chr(10) || code
  ELSE '</redacted_reasoning>' || text END AS output
FROM documents, (SELECT '```python' || chr(10) || 'x = 1' || chr(10) || '```' AS code)
"""
SPAN = r"(?is)<think\s*>.*?</think\s*>|<redacted_reasoning\s*>.*?</redacted_reasoning\s*>"
FENCE = r"(?s)```[^\n`]*\n.*?```"
ORACLES["h06_pure_think"] = f"""
WITH r AS ({RESPONSES}), s AS (SELECT doc_id, regexp_matches(output, '{SPAN}') AS has, regexp_matches(regexp_replace(output, '{SPAN}', '', 'g'), '{FENCE}') AS outside,
  regexp_matches(array_to_string(regexp_extract_all(output, '{SPAN}'), chr(10)), '{FENCE}') AS inside FROM r)
SELECT doc_id, CAST(CASE WHEN NOT has THEN -2 WHEN NOT outside THEN -1 WHEN inside THEN 0 ELSE 1 END AS DOUBLE) AS score FROM s
"""
ORACLES["h08_think_or_not"] = rf"SELECT doc_id, CAST(regexp_matches(output, '(?i)</?(think|redacted_reasoning)\s*>') AS INTEGER) AS score FROM ({RESPONSES})"

SAMPLES = """SELECT CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS id, a.text AS instruction, '' AS input, b.text AS output
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"""
FIELDS = "concat_ws(chr(10), nullif(instruction, ''), nullif(input, ''), nullif(output, ''))"
SAMPLE = "concat_ws(chr(10), coalesce(instruction, ''), nullif(input, ''), coalesce(output, ''))"
ORACLES["h07_str_length"] = f"SELECT id, CAST(length({FIELDS}) AS BIGINT) AS score FROM ({SAMPLES})"
ORACLES["h10_byte_length"] = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS score FROM documents"
ORACLES["long_cot_samples"] = "SELECT doc_id AS id, CAST(strlen(text) AS BIGINT) AS total FROM documents WHERE strlen(text) > 4096"
# bytes of UTF-8, from the hexadecimal form
_hex = "hex(encode(text))"
BYTES = f"list_transform(range(0, strlen(text)), lambda i: substr({_hex}, 2 * i + 1, 2))"
_bigrams = "SELECT {k}, list_transform(range(1, len(t)), lambda i: t[i] || chr(1) || t[i + 1]) AS g FROM (SELECT {k}, {tokens} AS t FROM {source})"
ORACLES["h13_unique_ngram"] = f"SELECT doc_id, round(CASE WHEN len(g) > 0 THEN len(list_distinct(g)) / len(g) ELSE 0.0 END, 6) + 0.0 AS score FROM ({_bigrams.format(k='doc_id', tokens=TOKENS, source='documents')})"
ORACLES["fused_scorers"] = f"""
WITH s AS (SELECT id, {FIELDS} AS f, {SAMPLE} AS text, coalesce(output, '') AS output FROM ({SAMPLES})), t AS (SELECT id, unnest({TOKENS}) AS w FROM s),
c AS (SELECT id, w, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT id, c, sum(c) OVER (PARTITION BY id) AS n FROM c), e AS (SELECT id, -sum(c / n * log2(c / n)) AS e FROM n GROUP BY id),
g AS ({_bigrams.format(k="id", tokens=TOKENS, source="s")})
SELECT s.id, CAST(length(f) AS BIGINT) AS StrLengthScorer, round(coalesce(e, 0.0), 6) + 0.0 AS GramEntropyScorer, round(CASE WHEN len(g) > 0 THEN len(list_distinct(g)) / len(g) ELSE 0.0 END, 6) + 0.0 AS UniqueNgramScorer,
  CAST(regexp_matches(output, '(?i)</?(think|redacted_reasoning)\\s*>') AS INTEGER) AS ThinkOrNotScorer, CAST(strlen(f) AS BIGINT) AS TokenLengthScorer
FROM s LEFT JOIN e USING (id) JOIN g USING (id)
"""

# --- datasets --------------------------------------------------------------------------------------------------------

ORACLES["d01_apjs"] = f"""
WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || chr(1) || t[i + 1] || chr(1) || t[i + 2])) AS g FROM t),
x AS (SELECT doc_id, len(g) AS s, unnest(g) AS w FROM g),
c AS (SELECT a.doc_id AS i, b.doc_id AS j, a.s AS si, b.s AS sj, count(*) AS c FROM x a JOIN x b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents)
SELECT round((SELECT coalesce(sum(c / (si + sj - c)), 0.0) FROM c) / (n * (n - 1) // 2), 6) + 0.0 AS score, n AS num_samples, CAST(n * (n - 1) // 2 AS BIGINT) AS num_pairs, CAST(n * (n - 1) // 2 AS BIGINT) AS total_possible_pairs, false AS is_sampled FROM n
"""

E = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"
CENTROIDS = f"""SELECT label AS cluster_id, list(x ORDER BY d) AS centroid FROM (SELECT label, d, avg(x) AS x FROM (SELECT label, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM ({E})) GROUP BY label, d) GROUP BY label"""
_n = lambda x: f"sqrt(list_dot_product({x}, {x}))"
_zip = lambda x, y, f: f"list_sum(list_transform(list_zip({x}, {y}), lambda z: {f}))"


def distance(x: str, y: str, metric: str) -> str:
    return {
        "cosine": f"(1 - list_dot_product({x}, {y}) / ({_n(x)} * {_n(y)}))",
        "euclidean": f"list_distance({x}, {y})",
        "squared_euclidean": f"power(list_distance({x}, {y}), 2)",
        "manhattan": _zip(x, y, "abs(z[1] - z[2])"),
    }[metric]


_centred = "list_transform(v, lambda q: q - list_avg(v))"
_pairs = {
    "cosine": f"list_dot_product(a.v, b.v) / ({_n('a.v')} * {_n('b.v')})",
    "euclidean": distance("a.v", "b.v", "euclidean"),
    "manhattan": distance("a.v", "b.v", "manhattan"),
    "dot_product": "list_dot_product(a.v, b.v)",
    "pearson": f"list_dot_product(a.c, b.c) / ({_n('a.c')} * {_n('b.c')})",
}
ORACLES["d02_aps"] = f"WITH e AS (SELECT id, v, {_centred} AS c FROM ({E})), p AS (SELECT {', '.join(f'avg({x}) AS {m}' for m, x in _pairs.items())}, count(*) AS k FROM e a JOIN e b ON a.id < b.id), n AS (SELECT count(*) AS n FROM e) " + " UNION ALL ".join(
    f"SELECT '{m}' AS similarity_metric, round({m}, 5) AS score, n AS num_samples, k AS num_pairs FROM p, n" for m in _pairs
)
METRICS = ("cosine", "euclidean", "squared_euclidean", "manhattan")
ORACLES["d03_cluster_inertia"] = f"WITH e AS ({E}), c AS ({CENTROIDS}) " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, cluster_id, count(e.id) AS cluster_size, round(coalesce(sum({distance('v', 'centroid', m)}), 0.0), 5) AS inertia FROM c LEFT JOIN e ON e.label = c.cluster_id GROUP BY cluster_id" for m in METRICS
)
ORACLES["d04_facility_location"] = f"WITH e AS ({E}), c AS ({CENTROIDS}) " + " UNION ALL ".join(
    f"""SELECT '{m}' AS distance_metric, count(*) AS num_samples, (SELECT count(*) FROM c) AS num_subset_samples, round(sum(d), 5) AS facility_location_score, round(avg(d), 5) AS avg_min_distance, round(max(d), 5) AS max_min_distance,
  round(quantile_cont(d, 0.5), 5) AS median_min_distance, round(stddev_pop(d), 5) AS std_min_distance, round((SELECT count(*) FROM c) / count(*), 5) AS subset_ratio
FROM (SELECT id, min({distance("v", "centroid", m)}) AS d FROM e, c GROUP BY id)"""
    for m in METRICS
)
ORACLES["d05_knn"] = f"WITH e AS ({E}) " + " UNION ALL ".join(
    f"SELECT id, '{m}' AS metric, round(avg(d), 6) + 0.0 AS score FROM (SELECT a.id, {distance('a.v', 'b.v', m)} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {distance('a.v', 'b.v', m)}, b.id) AS r FROM e a JOIN e b ON a.id <> b.id) WHERE r <= 5 GROUP BY id" for m in ("euclidean", "cosine", "manhattan")
)


def _novel() -> str:
    combos = [(nb, dp) for nb in (5, 10) for dp in (0, 0.25, 0.5)]
    rho = ", ".join(f"power(greatest(m{nb}, 0.0) + 1e-10, -{dp}) AS r{k}" for k, (nb, dp) in enumerate(combos))
    ranks = ", ".join(f"d * r{k} AS w{k}, row_number() OVER (PARTITION BY i ORDER BY d * r{k}) AS k{k}" for k in range(len(combos)))
    names, each, out = [], [], []
    for k, (nb, dp) in enumerate(combos):
        for q in (0, 1, 2):
            name = f"neighbor_{nb}_density_{dp:g}_distance_{q}".replace(".", "_")
            names.append(name)
            each.append(f"sum(w{k} * power(k{k}, -{q}.0)) / sum(power(k{k}, -{q}.0)) AS {name}")
            out.append(f"round(avg({name}), 5) AS {name}")
    return f"""WITH e AS ({E}), p AS (SELECT a.id AS i, b.id AS j, {distance("a.v", "b.v", "cosine")} AS d FROM e a JOIN e b ON a.id <> b.id),
n AS (SELECT j, d, row_number() OVER (PARTITION BY j ORDER BY d, i) AS r FROM p), m AS (SELECT j, avg(d) FILTER (WHERE r <= 5) AS m5, avg(d) FILTER (WHERE r <= 10) AS m10 FROM n GROUP BY j),
f AS (SELECT j, {rho} FROM m), x AS (SELECT i, d, {ranks} FROM p JOIN f USING (j)), y AS (SELECT i, sum(d) AS d, count(*) AS n, {", ".join(each)} FROM x GROUP BY i)
SELECT count(*) AS num_samples, round(sum(d) / sum(n), 5) AS cos_distance, {", ".join(out)} FROM y"""


ORACLES["d07_novel_sum"] = _novel()
ORACLES["d08_partition_entropy"] = """
WITH c AS (SELECT label, count(*) AS c FROM embeddings WHERE label IS NOT NULL GROUP BY label), n AS (SELECT sum(c) AS n FROM c), e AS (SELECT -sum(c / n * ln(c / n)) AS e FROM c, n)
SELECT round(e, 6) + 0.0 AS entropy, round(e / ln(12.0), 6) + 0.0 AS normalized_entropy, round(ln(12.0), 6) + 0.0 AS max_entropy, CAST(n AS BIGINT) AS num_samples, (SELECT count(*) FROM c) AS num_clusters_in_subset,
  (SELECT string_agg(CAST(label AS VARCHAR) || ':' || CAST(c AS VARCHAR), ',' ORDER BY label) FROM c) AS counts FROM e, n
"""
ORACLES["d09_radius"] = f"""
WITH x AS (SELECT id, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM ({E})), r AS (SELECT d, stddev_pop(x) AS raw FROM x GROUP BY d), s AS (SELECT raw, CASE WHEN raw = 0 THEN 1e-10 ELSE raw END AS s FROM r)
SELECT round(exp(avg(ln(s))), 6) + 0.0 AS radius, round(exp(avg(ln(s))), 6) + 0.0 AS geometric_mean_std, round(avg(s), 6) + 0.0 AS arithmetic_mean_std, round(min(s), 6) + 0.0 AS min_std, round(max(s), 6) + 0.0 AS max_std,
  round(quantile_cont(s, 0.5), 6) + 0.0 AS median_std, (SELECT count(*) FROM embeddings) AS num_samples, count(*) AS embedding_dimension, count(*) FILTER (WHERE raw = 0) AS zero_std_dimensions FROM s
"""

# --- model outputs ---------------------------------------------------------------------------------------------------

_abs = lambda a, n: f"list_transform(list_slice(v, {a}, {a + n - 1}), lambda q: abs(q))"
RAW = f"""SELECT id, v, list_slice(v, 1, 6) AS l6, list_slice(v, 1, 5) AS l5, list_slice(v, 1, 3) AS l3, v[1] AS reward, {_abs(1, 16)} AS nll, {_abs(17, 16)} AS nll2, {_abs(33, 16)} AS entropies,
  list_transform(list_slice(v, 49, 56), lambda q: -abs(q)) AS logprobs FROM ({E})"""
_soft = lambda x, first: f"list_dot_product(list_transform({x}, lambda q: exp(q)), list_transform(range({first}, len({x}) + {first}), lambda q: CAST(q AS DOUBLE))) / list_sum(list_transform({x}, lambda q: exp(q)))"
_r = lambda x, name="score": f"round({x}, 6) + 0.0 AS {name}"
_edu = "CAST(round(greatest(least(reward * 5, 5.0), 0.0)) AS INTEGER)"
ROWS: dict[str, str] = {
    "m01_ask_llm": _r("list_avg(logprobs)"),
    **{n: _r(_soft("l6", 0)) for n in ("m03_cleanliness", "m23_professionalism", "m26_readability", "m27_reasoning")},
    **{n: _r(_soft("l6", 1)) for n in ("m06_deita_c", "m07_deita_q")},
    "m05_deberta": "CAST(list_position(l3, list_max(l3)) - 1 AS INTEGER) AS class",
    "m11_fineweb_edu": f"{_r('reward * 5')}, {_edu} AS int_score, {_edu} >= 3 AS keep",
    "m14_grand": _r(_n("nll")),
    "m15_hes": _r("list_sum(list_filter(entropies, lambda h: h >= quantile))"),
    "m16_ifd": _r("exp(list_avg(nll2)) / exp(list_avg(nll))"),
    "m20_norm_loss": _r("list_avg(nll) / ln(2.0)"),
    "m22_ppl": _r("exp(list_avg(nll))"),
    "m30_selectit_token": _r(_soft("l5", 1)),
    "m34_textbook": _r("nll[2] + 2 * nll[3]"),
    "m35_thinking_prob": f"{_r('nll[1]', 'thinking_prob')}, {_r('1 - nll[1]', 'no_thinking_prob')}, {_r('1 - nll[1]')}",
    "m36_upd": _r("list_avg(list_transform(list_zip(nll, entropies), lambda z: 1 / (1 + exp(-z[1])) * greatest(0.0, 1 - z[2] / ln(32000.0))))"),
    "m37_unieval_d2t": _r("(nll[1] + nll[2]) / 2", "overall"),
    "m38_unieval_dialog": _r("(nll[1] + nll[2] + nll[3] + nll[4] + nll[5]) / 5", "overall"),
    "m40_unieval_sum": _r("(nll[1] + nll[2] + nll[3] + nll[4]) / 4", "overall"),
}
for _name, _x in ROWS.items():
    ORACLES[_name] = f"SELECT id, {_x} FROM ({RAW})"
_rewards = ("AtheneScorer", "Gpt2HarmlessScorer", "Gpt2HelpfulScorer", "InfOrmScorer", "RMDeBERTaScorer", "SkyworkLlamaScorer", "SkyworkQwenScorer")
ORACLES["m_rewards"] = "SELECT id, " + ", ".join(_r(f"v[{k + 1}]", n) for k, n in enumerate(_rewards)) + f", {_r('abs(v[10])', 'UniEvalFactScorer_UniEval_Consistency')} FROM ({RAW})"
ORACLES["m15_hes"] = f"WITH h AS (SELECT id, unnest(entropies) AS h FROM ({RAW})), q AS (SELECT id, h, quantile_cont(h, 0.995) OVER (PARTITION BY id) AS t FROM h) SELECT id, {_r('sum(h) FILTER (WHERE h >= t)')} FROM q GROUP BY id"
ORACLES["m10_fail_rate"] = f"SELECT id, round(1 - len(list_filter(list_slice(v, 1, 8), lambda q: q > 0)) / 8, 6) + 0.0 AS score FROM ({RAW})"
ORACLES["m04_complexity"] = r"""
WITH g AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CAST(doc_id % 20 AS VARCHAR) || chr(10) || '<bor>' WHEN 1 THEN '<bos>0</eos>' WHEN 2 THEN ' 7' WHEN 3 THEN 'none' WHEN 4 THEN '' ELSE '4.5' END AS raw FROM documents),
n AS (SELECT doc_id, raw, TRY_CAST(nullif(regexp_extract(raw, '^\s*(?:<bos>)?\s*(\d{1,9})', 1), '') AS INTEGER) AS n FROM g)
SELECT doc_id, CASE WHEN n IS NOT NULL THEN CAST(greatest(least(n, 10), 1) AS DOUBLE) END AS score, raw AS raw_output FROM n
"""
ORACLES["m18_instag"] = "SELECT doc_id, CAST(CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 5 THEN 3 ELSE 0 END AS INTEGER) AS score FROM documents"
ORACLES["m19_miwv"] = f"""
WITH r AS ({RAW}), p AS (SELECT a.id, b.id AS o, row_number() OVER (PARTITION BY a.id ORDER BY {distance("a.v", "b.v", "cosine")}, b.id) AS k FROM r a JOIN r b ON a.id <> b.id)
SELECT p.id, round(nll[2] - nll[1], 6) + 0.0 AS score, o AS most_similar_id FROM p JOIN r ON p.id = r.id WHERE k = 1
"""
_q = lambda k: f"(512 * v[{k}] + 412 * v[{4 + k}] + 312 * v[{8 + k}]) / 1236"
ORACLES["m24_qurate"] = f"SELECT id, {_r(_q(1), 'style')}, {_r(_q(2), 'expertise')}, {_r(_q(3), 'facts')}, {_r(_q(4), 'value')}, {_r('v[9]', 'style_last')} FROM ({RAW})"
RATINGS = f"SELECT id, k, {_soft('list_slice(v, 5 * k + 1, 5 * k + 5)', 1)} AS r FROM ({RAW}), (SELECT unnest(range(0, 10)) AS k)"
ORACLES["m28_selectit_model"] = f"WITH r AS ({RATINGS}), s AS (SELECT id, k < 5 AS a, avg(r) / (1 + 0.2 * stddev_pop(r)) AS s FROM r GROUP BY ALL) SELECT id, round(sum(s * CASE WHEN a THEN 0.7 ELSE 0.3 END), 6) + 0.0 AS score FROM s GROUP BY id"
ORACLES["m29_selectit_sentence"] = f"WITH r AS ({RATINGS}) SELECT id, round(avg(r) / (1 + 0.2 * stddev_pop(r)), 6) + 0.0 AS score FROM r WHERE k < 5 GROUP BY id"
ORACLES["m33_task2vec"] = f"WITH e AS ({E}) SELECT round(avg({distance('a.v', 'b.v', 'cosine')}), 6) + 0.0 AS score, (SELECT count(*) FROM e) AS num_samples FROM e a JOIN e b ON a.id < b.id"
_q0 = "chr(10) || chr(10)"
ORACLES["prompt_builders"] = f"""
SELECT id, {_q0} || 'Human: ' || instruction || {_q0} || 'Assistant: ' || output AS human, '### Instruction:' || chr(10) || instruction || {_q0} || '### Response:' || chr(10) AS instruct,
  'Example question:' || chr(10) || instruction || chr(10) || 'Example answer:' || chr(10) || output || {_q0} || 'Question:' || chr(10) || instruction || chr(10) || 'Answer:' || chr(10) AS one_shot,
  replace(replace('Rate: {{instruction}} => {{output}}', '{{instruction}}', instruction), '{{output}}', output) AS rating FROM ({SAMPLES})
"""

# --- judging ---------------------------------------------------------------------------------------------------------

ORACLES["j01_prompts"] = f"SELECT id, 'Q_Clarity' AS metric, 'Clear? ' || instruction AS prompt FROM ({SAMPLES}) UNION ALL SELECT id, 'QA_Correctness', 'Right? ' || instruction || ' / ' || output FROM ({SAMPLES})"
JUDGED = "SELECT doc_id AS id, source, CASE WHEN doc_id % 5 = 0 AND doc_id % 13 BETWEEN 1 AND 10 THEN CAST(doc_id % 13 AS INTEGER) WHEN doc_id % 5 = 4 THEN 10 END AS clarity FROM documents"
ORACLES["j02_validation"] = f"SELECT id, clarity IS NOT NULL AS valid, CAST(clarity AS DOUBLE) AS clarity FROM ({JUDGED})"
ORACLES["j03_resume"] = "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"
ORACLES["j04_merge"] = f"SELECT id, source, CAST(clarity AS DOUBLE) AS clarity FROM ({JUDGED})"

# --- evaluation ------------------------------------------------------------------------------------------------------

ANSWERS = [("A", "A", "A"), ("b.", "B", "B"), ("CORRECT", "C", "A"), ("INCORRECT", "A", "B"), ("INVALID", "C", "C"), ("The grade is B", "B", "B"), ("The answer is correct", "A", "A"), ("hmm maybe so", "HMM MAYBE ", "UNKNOWN"), ("", "UNKNOWN", "UNKNOWN"), ("   ", "", "UNKNOWN"), ("it is c here", "C", "C"), ("grade: incorrect", "A", "B")]
GRADED = "SELECT doc_id, source AS file, lang, CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '{a}'" for k, (_, a, _) in enumerate(ANSWERS)) + " END AS judge, CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '{a}'" for k, (_, _, a) in enumerate(ANSWERS)) + " END AS strict FROM documents"
ORACLES["e01_verdicts"] = f"SELECT doc_id, judge, strict FROM ({GRADED})"
_acc = "count(*) AS total, count(*) FILTER (WHERE judge = 'A') AS a_count, round(count(*) FILTER (WHERE judge = 'A') / count(*), 6) + 0.0 AS accuracy"
ORACLES["e02_accuracy"] = f"SELECT file, {_acc} FROM ({GRADED}) GROUP BY file"
ORACLES["e03_verdict_counts"] = f"SELECT judge, count(*) AS n FROM ({GRADED}) GROUP BY judge"
ORACLES["e04_split_accuracy"] = f"SELECT CASE lang WHEN 'en' THEN 'MMMU_DEV' ELSE 'MMMU_VAL' END AS test_set, {_acc} FROM ({GRADED}) WHERE lang IN ('en', 'fr') GROUP BY test_set"
ORACLES["e05_overall"] = f"SELECT count(*) FILTER (WHERE judge = 'A') AS a_count, count(*) AS total, round(count(*) FILTER (WHERE judge = 'A') / count(*), 6) + 0.0 AS accuracy FROM ({GRADED})"
_cols = lambda x: ", ".join(f"CAST(max(CASE WHEN file = 'src{k}' THEN {x} END) AS DOUBLE) AS src{k}" for k in range(20))
ORACLES["e06_transposed"] = f"WITH a AS (SELECT file, {_acc} FROM ({GRADED}) GROUP BY file) " + " UNION ALL ".join(f"SELECT '{n}' AS metric, {_cols(x)} FROM a" for n, x in (("total", "total"), ("A_count", "a_count"), ("accuracy", "accuracy")))
_sets = [("AI2D_TEST", 8), ("MMMU_DEV_VAL", 14), ("CV-Bench-2D", 0), ("OCRBench", 17), ("x_y_ChartQA_TEST", 16), ("unknown", 20)]
ORACLES["e07_test_set_names"] = "SELECT doc_id, CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in enumerate(_sets)) + " END AS test_set, CAST(CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN {r}" for k, (_, r) in enumerate(_sets)) + " END AS INTEGER) AS rank FROM documents"


def _summary(rows: str, rules) -> str:
    """rows: SQL for (file, pos, dataset, metric, value)."""
    out = []
    for r in rules:
        hit = (f"starts_with(dataset, '{r.dataset}')" if r.prefix else f"dataset = '{r.dataset}'") + (f" AND metric = '{r.metric}'" if r.metric else "")
        got = f"avg(num) FILTER (WHERE {hit})" if r.average else f"first(num ORDER BY pos) FILTER (WHERE {hit} AND num IS NOT NULL)"
        bad = "'error'" if r.average else f"CASE WHEN count(value) FILTER (WHERE {hit}) > 0 THEN 'error' ELSE 'N/A' END"
        out.append(f"""round({got}, 9) + 0.0 AS "{r.key}", CASE WHEN count(*) FILTER (WHERE {hit}) = 0 THEN 'N/A' WHEN count(num) FILTER (WHERE {hit}) = 0 THEN {bad} END AS "{r.key}_status" """)
    return f"WITH r AS ({rows}), x AS (SELECT *, TRY_CAST(value AS DOUBLE) AS num FROM r) SELECT file, {', '.join(out)} FROM x GROUP BY file"


ORACLES["e08_summary"] = _summary(
    """SELECT 'u' || CAST(user_id AS VARCHAR) AS file, event_id AS pos, event_type AS dataset, CASE WHEN event_id % 2 = 0 THEN 'accuracy' ELSE 'score' END AS metric,
  CASE WHEN event_id % 7 = 0 THEN 'bad' WHEN event_id % 11 = 0 THEN NULL ELSE CAST(CAST(value AS DECIMAL(18, 3)) AS VARCHAR) END AS value FROM events""",
    [Rule("click_first", "click", "accuracy"), Rule("c_average", "c", None, True, True), Rule("none", "no such")],
)
# written out, not taken from RULES: the order and what each rule asks for are what is checked
_E10 = (
    "drop,accuracy IFEval,pass agieval,naive_average mmlu_pro,accuracy gsm8k,accuracy math,accuracy math_prm800k_500,accuracy OmniMath,pass OlympiadBench_OE_TO_maths_en_COMP,accuracy aime2024,accuracy "
    "openai_humaneval,pass sanitized_mbpp,score lcb_code_generation,pass humaneval_plus,pass ARC-c,accuracy bbh,naive_average GPQA_diamond,accuracy calm,Accuracy korbench,accuracy "
    "mmlu_pro_law,accuracy aime2024_ii,accuracy calm_x,Accuracy korbench_logic,score math_500,accuracy"
).split()
_E10_MEAN, _E10_PREFIX = {"IFEval", "mmlu_pro", "aime2024", "calm", "korbench"}, {"mmlu_pro", "aime2024", "calm", "korbench"}
_E10_KEY = {"aime2024": "aime2024_accuracy", "sanitized_mbpp": "sanitized_mbpp_score", "bbh": "bbh_naive_average", "calm": "calm_Accuracy"}
_list = lambda k: "[" + ", ".join(f"'{x.split(',')[k]}'" for x in _E10) + "]"
ORACLES["e10_rule_table"] = _summary(
    f"""SELECT 'lab-20' || CAST(user_id % 5 AS VARCHAR) || '-s' || CAST(user_id % 4 AS VARCHAR) || '.csv' AS file, event_id AS pos, {_list(0)}[1 + event_id % {len(_E10)}] AS dataset, {_list(1)}[1 + event_id % {len(_E10)}] AS metric,
  CASE WHEN event_id % 7 = 0 THEN '-' WHEN event_id % 11 = 0 THEN NULL ELSE CAST(CAST(value AS DECIMAL(18, 3)) AS VARCHAR) END AS value FROM events""",
    [Rule(_E10_KEY.get(d, d), d, None if m == "pass" else m, d in _E10_PREFIX, d in _E10_MEAN) for d, m in (x.split(",") for x in _E10[:19])],
)
ORACLES["e09_submission"] = "SELECT doc_id AS questionId, CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(text, '') END AS answer FROM documents WHERE doc_id % 3 <> 0"
_g8 = "list_distinct(list_transform(range(1, len(t) - 6), lambda i: array_to_string(list_slice(t, i, i + 7), chr(1))))"
ORACLES["x01_contamination"] = f"""
WITH d AS (SELECT doc_id, unnest({_g8}) AS g FROM (SELECT doc_id, {TOKENS} AS t FROM documents)), b AS (SELECT item_id, {_g8} AS gs FROM (SELECT item_id, {TOKENS} AS t FROM benchmark)), i AS (SELECT item_id, len(gs) AS n, unnest(gs) AS g FROM b)
SELECT doc_id, item_id, round(count(*) / any_value(n), 6) + 0.0 AS share FROM d JOIN i USING (g) GROUP BY doc_id, item_id
"""
ORACLES["report"] = f"""
WITH t AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT doc_id, c, sum(c) OVER (PARTITION BY doc_id) AS n FROM c),
e AS (SELECT doc_id, -sum(c / n * log2(c / n)) AS e FROM n GROUP BY doc_id)
SELECT source, lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(coalesce(e, 0.0)), 6) + 0.0 AS mean_entropy FROM documents d LEFT JOIN e USING (doc_id) GROUP BY source, lang
"""
