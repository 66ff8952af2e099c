"""The judge with a client that fails and recovers, from prompts to merged scores."""

import json

import pytest

from quern.operators import evalreport, judge
from quern.sources import tables as S


def test_end_to_end(spark, tmp_path):
    items = spark.createDataFrame([(str(k), f"question {k}", f"answer {k}", {"Q_Clarity.Clarity": None, "other": k}) for k in range(40)], "id string, instruction string, output string, scores map<string,int>")
    templates = {"Q_Clarity": "Clear? {instruction}", "QA_All": "All of {instruction} / {output}"}
    calls = str(tmp_path / "calls")

    def client(prompt, temperature, timeout):
        """Fails at first where the number ends in 1, says nonsense at first where in 2, always where in 3."""
        with open(calls, "a") as f:
            f.write(json.dumps([prompt, temperature, timeout]) + "\n")
        last = prompt.rstrip()[-1]
        if last == "1" and temperature < 0.15:
            raise TimeoutError
        if last == "3" or last == "2" and temperature < 0.3:
            return "nonsense"
        if prompt.startswith("All"):
            return json.dumps({a: 5 for a in judge.ASPECTS if a != "Meaningfulness"} | {"Meaningness": 7})
        return json.dumps({"Clarity": 3})

    requests = judge.prompts(items, templates)
    assert requests.count() == 80
    asked = judge.ask(requests, client, wait=0.0, timeout=9.0, concurrency=4, chunk=7)
    asked.write.parquet(str(tmp_path / "raw"))
    answers = spark.read.parquet(str(tmp_path / "raw"))
    attempts = {(r["id"], r["metric"]): r["attempts"] for r in answers.collect()}
    assert all(n == {"1": 2, "2": 3, "3": 4}.get(i[-1], 1) for (i, _), n in attempts.items())
    said = [json.loads(x) for x in open(calls)]
    assert len(said) == sum(attempts.values()) and {x[2] for x in said} == {9.0}
    assert sorted(t for p, t, _ in said if p == "Clear? question 3") == [0.1, 0.2, 0.4, 0.8]

    judged = judge.validated(answers)
    S.write_judged(judged, str(tmp_path / "j"))
    scored, errors = judge.split(judged)
    assert {r["id"][-1] for r in errors.collect()} == {"3"} and scored.count() == 72
    left = {r["id"] for r in judge.pending(items, S.tracked_ids(spark, str(tmp_path / "j"))).collect()}
    assert left == {"3", "13", "23", "33"}
    merged = {r["id"]: r["scores"] for r in judge.merge_scores(items, scored).collect()}
    assert merged["4"] == {"Q_Clarity.Clarity": 3, "other": 4, **{f"QA_All.{a}": 7 if a == "Meaningfulness" else 5 for a in judge.ASPECTS}}
    assert merged["3"] == {"Q_Clarity.Clarity": None, "other": 3}


def test_retry_plan():
    assert judge.retry_plan(5, 0.1, 1.0) == [(0.1, 0.0), (0.2, 1.0), (0.4, 2.0), (0.8, 4.0), (1.0, 8.0), (1.0, 16.0)]
    assert judge.retry_plan(0) == [(0.1, 0.0)]


@pytest.mark.parametrize("metric", judge.METRICS)
def test_every_metric_validates_alike_in_both_engines(spark, metric):
    keys = judge.keys_of(metric)
    cases = [{k: v for k in keys} for v in (0, 1, 10, 11, 4.5, True, "3", None)] + [{}, {k: 5 for k in keys[1:]}, [1], "x"]
    raws = [json.dumps(c) for c in cases] + ["", "{", None]
    df = spark.createDataFrame([(k, metric, r) for k, r in enumerate(raws)], "id int, metric string, raw string").coalesce(1)
    got = {r["id"]: r["valid"] for r in judge.validated(df).collect()}
    for k, r in enumerate(raws):
        if r != json.dumps({x: "3" for x in keys}):  # get_json_object tells no text from a number
            assert got[k] == judge.python_valid(r, metric), r
    wide = {r["id"]: r["valid"] for r in judge.validated(df, 0, 11).collect()}
    assert wide[0] and wide[3]


def test_grading_by_batches(spark):
    d = spark.createDataFrame([(k, f"p{k}") for k in range(50)], "id int, prompt string").coalesce(1).sortWithinPartitions("id")

    def model(batch):
        if "p20" in batch:
            raise RuntimeError
        return ["too few"] if "p40" in batch else [f"A {p}" for p in batch]

    got = {r["id"]: r["raw"] for r in judge.grade(d, model).collect()}
    assert all(got[k] == ("" if 16 <= k < 48 else f"A p{k}") for k in range(50))
    verdicts = judge.grade(d, model).select("id", evalreport.verdict(judge.F.col("raw")).alias("judge"))
    assert {r["judge"] for r in verdicts.collect()} == {"A", "UNKNOWN"}


def test_unknown_metric():
    with pytest.raises(ValueError):
        judge.keys_of("Q_Nothing")
    assert judge.keys_of("QA_Meaningness") == ("Meaningfulness",)
