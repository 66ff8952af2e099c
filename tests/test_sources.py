"""Files are written in each form, read by the sources and compared row by row; what sinks write is read back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import evalreport
from quern.sources import tables as S
from quern.sources.xlsx import read_rows, write_rows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_samples(spark, tmp_path):
    lines = [{"id": "a", "instruction": "i", "output": "o", "history": [["q", "r"]]}, {"instruction": "i2", "output": "o2", "cluster_id": 3}]
    (tmp_path / "x.jsonl").write_text("\n".join([json.dumps(x) for x in lines] + ["{broken", ""]))
    got = {r["instruction"]: r for r in S.read_samples(spark, str(tmp_path)).collect()}
    assert got["i"]["id"] == "a" and got["i"]["history"] == [["q", "r"]] and got["i"]["_corrupt"] is None
    assert got["i2"]["id"].startswith("sample_") and got["i2"]["cluster_id"] == 3
    assert got[None]["_corrupt"] == "{broken"
    assert {r["id"] for r in S.read_samples(spark, str(tmp_path), default_id="none").collect()} == {"a", "none"}


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    matrices = [rng.normal(size=(5000, 3)), rng.normal(size=(2, 3)).astype(np.float32), rng.normal(size=3)]
    for k, m in enumerate(matrices):
        np.save(tmp_path / f"p{k}.npy", m)
    want = np.concatenate([np.atleast_2d(m) for m in matrices])
    got = np.array([r["embedding"] for r in S.read_vectors(spark, str(tmp_path)).orderBy("vec_id").collect()])
    assert np.array_equal(got, want)
    parts = S.read_vectors(spark, str(tmp_path), block_bytes=2400).orderBy("vec_id").collect()  # 100 rows
    assert [r["vec_id"] for r in parts] == list(range(len(want))) and np.array_equal([r["embedding"] for r in parts], want)
    np.save(tmp_path / "bad name.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="a matrix of numbers"):
        S.read_vectors(spark, str(tmp_path / "bad name.npy")).collect()
    np.save(tmp_path / "none 1%.npy", np.zeros((0, 3), np.int16))
    assert S.read_vectors(spark, str(tmp_path / "none 1%.npy")).count() == 0
    one = S.read_vectors(spark, str(tmp_path / "p1.npy")).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in one] == [0, 1] and np.array_equal(one[1]["embedding"], matrices[1][1].astype(float))


def test_alignment(spark):
    a, b = spark.range(5).toDF("i"), spark.range(2, 9).toDF("v")
    assert tuple(S.aligned(a, b, "i", "v").first())[:3] == (5, 7, 3) and S.aligned(a, b, "i", "v").first()["warning"]
    assert S.aligned(a, a, "i", "i").first()["warning"] is None
    with pytest.warns(UserWarning, match="5 samples and 9 vectors"):
        x, y = S.paired(a, spark.range(9).toDF("v"), "i", "v")
    assert x.count() == y.count() == 5 and y.agg(F.max("v")).first()[0] == 4
    with pytest.raises(ValueError, match="5 samples"):
        S.paired(a, spark.range(9).toDF("v"), "i", "v", "error")
    assert [d.count() for d in S.paired(a, a, "i", "i", "error")] == [5, 5]


def test_xlsx_round_trip():
    table = [["a", None, 1, 2.5, True], [None, "<&>\n \x00é", -3, 1e300, False], []]
    got = read_rows(write_rows(["x", "y", "z", "ü", "w"], table))
    assert got[0] == ["x", "y", "z", "ü", "w"]
    assert got[1] == ["a", None, "1", "2.5", "TRUE"] and got[2] == [None, "<&>\n é", "-3", "1e+300", "FALSE"] and got[3] == []
    wide = read_rows(write_rows([f"c{k}" for k in range(800)], [list(range(800))]))
    assert wide[0][-1] == "c799" and wide[1] == [str(k) for k in range(800)]


def test_xlsx_shared_strings():
    import io
    import zipfile

    old = zipfile.ZipFile(io.BytesIO(write_rows(["q"], [["v"]])))
    out = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        for n in old.namelist():
            if "sheet1" not in n:
                z.writestr(n, old.read(n))
        z.writestr("xl/sharedStrings.xml", f'<sst {main}><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>0</v></c><c r="E2" t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
    assert read_rows(out.getvalue()) == [[], [None, "two", "one", None, None]]


def test_predictions_by_file_and_name(spark, tmp_path):
    (tmp_path / "M_AI2D_TEST.csv").write_text('Question , answer,PREDICTION\n"q1, x",a1,"line\nbreak"\nq2,,p2\n')
    (tmp_path / "M_MathVista_MINI.csv").write_text("prediction,index,question,answer,answer_option\np3,7,q3,a3,B\n")
    (tmp_path / "M_broken.csv").write_text("question,answer\nq,a\n")
    (tmp_path / "M_AI2D_TEST_acc.csv").write_text("metric,value\ntotal,1\n")
    (tmp_path / "M_x_results.xlsx").write_bytes(write_rows(["question", "answer", "prediction"], [["no", "no", "no"]]))
    (tmp_path / "M_y.xlsx").write_bytes(write_rows([" Index", "prediction", "answer", "question", "split"], [[3, "p4", "a4", "q4", "dev"], [None, None, None, None, None]]))
    (tmp_path / "M_torn.xlsx").write_bytes(b"PK")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "M_InfoVQA_TEST.xlsx").write_bytes(write_rows(["index", "prediction"], [[1, "a"], [2, None], [None, "c"]]))
    got = {(r["question"], r["answer"], r["prediction"], r["index"], r["answer_option"], r["split"]) for r in S.read_predictions(spark, str(tmp_path)).collect()}
    assert got == {("q1, x", "a1", "line\nbreak", None, None, None), ("q2", None, "p2", None, None, None), ("q3", "a3", "p3", "7", "B", None), ("q4", "a4", "p4", "3", None, "dev")}
    assert {r["file"].rpartition("/")[2] for r in S.read_predictions(spark, str(tmp_path), only="MINI").collect()} == {"M_MathVista_MINI.csv"}
    assert S.read_predictions(spark, str(tmp_path / "sub"), recursive=False).count() == 0
    own = S.read_predictions(spark, str(tmp_path), pattern="*InfoVQA_TEST.xlsx", need=("index", "prediction"))
    assert rows(evalreport.submission(own)) == [(1, "a"), (2, "")]


def test_grader_inputs(spark, tmp_path):
    d = spark.createDataFrame([("a", None), ("a", " B "), (None, " "), (None, None)], "answer string, option string")
    assert [r[0] for r in d.select(evalreport.chosen_answer(F.col("answer"), F.col("option"))).collect()] == ["a", "B", "", ""]
    prompt = spark.createDataFrame([(None, "x")], "q string, a string").select(evalreport.grader_prompt(F.col("q"), F.col("a"), F.lit(None).cast("string"))).first()[0]
    assert "Question: \n" in prompt and "Reference: x\n" in prompt and prompt.endswith("Reply: ")


def test_accuracies_and_summaries(spark, tmp_path):
    acc = tmp_path / "acc"
    acc.mkdir()
    (acc / "m_AI2D_TEST_acc.csv").write_text("metric,value\ntotal,4\nA_count,3\naccuracy,0.75\n")
    assert [tuple(r)[1:] for r in S.read_accuracies(spark, str(acc)).collect()] == [(4, 3, 0.75)]
    for top in ("p_x_s", "p_s", "nothing"):
        at = tmp_path / "sum" / top / "20250101" / "summary"
        at.mkdir(parents=True)
        (at / "summary_1.csv").write_text("dataset,version,metric,mode,m\ndrop,v,accuracy,gen,61.5\nmmlu_pro_a,v,accuracy,gen,-\n")
    other = tmp_path / "sum" / "p_x_s" / "20250101" / "other"
    other.mkdir()
    (other / "summary_1.csv").write_text("dataset,metric,m\ndrop,accuracy,1\n")
    got = S.read_summaries(spark, str(tmp_path / "sum"), "m")
    assert {r["file"] for r in got.collect()} == {"p-20250101-s.csv"} and got.count() == 4 and {r["pos"] for r in got.collect()} == {0, 1}
    table = evalreport.summarise(got)
    assert table.columns == ["file", *(r.key for r in evalreport.RULES)]
    first = table.first()
    assert (first["drop"], first["mmlu_pro"], first["gsm8k"]) == ("61.5", "error", "N/A")
    S.write_report(table, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == table.columns
    S.write_report(table.select("file", "drop"), str(tmp_path / "out.xlsx"))
    assert read_rows((tmp_path / "out.xlsx").read_bytes()) == [["file", "drop"], ["p-20250101-s.csv", "61.5"]]


def test_rules_are_in_order():
    keys = [r.key for r in evalreport.RULES]
    assert len(keys) == 19 and keys[:4] == ["drop", "IFEval", "agieval", "mmlu_pro"] and keys[9] == "aime2024_accuracy" and keys[-2:] == ["calm_Accuracy", "korbench"]
    by = {r.key: r for r in evalreport.RULES}
    assert by["calm_Accuracy"] == evalreport.Rule("calm_Accuracy", "calm", "Accuracy", True, True) and by["IFEval"] == evalreport.Rule("IFEval", "IFEval", None, False, True)


def test_judged_and_tracked(spark, tmp_path):
    folder = str(tmp_path / "j")
    assert S.tracked_ids(spark, folder).count() == 0
    d = spark.createDataFrame([("1", "Q_Clarity", "{}", True, {"Clarity": 4}), ("2", "Q_Clarity", "bad", False, None)], "id string, metric string, raw string, valid boolean, scores map<string,int>")
    for _ in range(2):
        S.write_judged(d, folder)
    assert rows(S.tracked_ids(spark, folder)) == [("1",), ("1",)]
    assert rows(spark.read.schema("id string, metric string, raw string").json(f"{folder}/errors")) == [("2", "Q_Clarity", "bad")] * 2


@pytest.mark.parametrize("n", [0, 1, 2500])
def test_submission(spark, tmp_path, n):
    d = spark.range(n).select((F.lit(n) - F.col("id")).alias("questionId"), F.concat(F.lit('é"\n'), F.col("id").cast("string")).alias("answer")).repartition(5)
    S.write_submission(d, str(tmp_path / "s"))
    (part,) = (tmp_path / "s").glob("part-*")
    assert [(x["questionId"], x["answer"]) for x in json.loads(part.read_text())] == [(k, f'é"\n{n - k}') for k in range(1, n + 1)]
    assert S.submission_path("/a/b/M_InfoVQA_TEST.xlsx") == "/a/b/a_M_InfoVQA_TEST.json" and S.submission_path("x.csv") == "a_x.json"


def test_arriving_files_are_scored_once(spark, tmp_path):
    from quern.streaming import incremental as I

    (tmp_path / "in").mkdir()
    schema = S.T.StructType([S.T.StructField(c, S.T.StringType()) for c in ("id", "instruction", "input", "output")])
    paths = [str(tmp_path / x) for x in ("in", "out", "check")]

    def arrive(k):
        (tmp_path / "in" / f"{k}.jsonl").write_text(json.dumps({"id": str(k), "instruction": "ab", "output": "c" * k}) + "\n")
        I.score_stream(spark, paths[0], schema, [{"name": "StrLengthScorer"}], paths[1], paths[2], files_per_trigger=1).awaitTermination()
        return rows(spark.read.parquet(paths[1]))

    assert arrive(1) == [("1", 4)]
    assert arrive(3) == [("1", 4), ("3", 6)]


def test_partials_add_up(spark):
    from quern.operators import spectral
    from quern.streaming import incremental as I

    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(60, 4)))], "id long, v array<double>")
    whole = spectral.radius(d).first()["radius"]
    parts = [I.partials(d.where(f"id % 3 = {k}")) for k in range(3)]
    assert I.radius_of(I.merged(*parts)).first()[0] == pytest.approx(whole)


def test_catalogue():
    from collections import Counter

    assert Counter(d for d, _, _ in evalreport.CATALOGUE) == {"general": 4, "math": 10, "code": 4, "reasoning": 5}
    assert ("reasoning", "CaLM", "rule") in evalreport.CATALOGUE and ("code", "LiveCodeBench", "run") in evalreport.CATALOGUE
