"""Readers and writers of samples, embeddings, evaluation tables and reports."""

from __future__ import annotations

import io
import warnings
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.xlsx import MOST, read_rows, write_rows

_TEXTS = "id instruction input output answer reference context".split()
SAMPLE = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in _TEXTS), T.StructField("cluster_id", T.IntegerType()), T.StructField("system", T.StringType()),
        T.StructField("history", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("images", T.ArrayType(T.StringType())),
    ]
)


def read_samples(spark: SparkSession, path: str, schema: T.StructType = SAMPLE, default_id: str | None = None) -> DataFrame:
    """JSON lines; a malformed line is kept in _corrupt. A missing id becomes default_id, else a hash of the whole sample."""
    raw = spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    if "id" not in schema.names:
        return raw
    made = F.lit(default_id) if default_id is not None else F.concat(F.lit("sample_"), F.sha2(F.to_json(F.struct(*[c for c in raw.columns if c != "id"])), 256))
    return raw.withColumn("id", F.coalesce("id", made))


def _open(path: str):
    """A random-access stream of a URI as Spark writes it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(unquote(urlsplit(path).path))
    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for p in b.column("path").to_pylist():
            with _open(p) as f:
                version = np.lib.format.read_magic(f)
                shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                shape = shape if len(shape) > 1 else (1, *shape)
                if len(shape) != 2 or dtype.hasobject or by_column and 1 not in shape:
                    raise ValueError(f"{p}: a matrix of numbers in C order is needed")
                rows.append((p, shape[0], shape[1], dtype.str, f.tell()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["path", "n", "width", "kind", "at"])


def read_vectors(spark: SparkSession, path: str, block_bytes: int = 16 << 20) -> DataFrame:
    """(vec_id, embedding) of a .npy matrix or of all .npy files of a folder, rows numbered in order of file name and place.

    Only headers are read at first; a file is then read in blocks of about block_bytes by many tasks, whatever its size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path")
    heads = files.mapInArrow(_headers, "path string, n long, width long, kind string, at long")
    before = F.coalesce(F.sum("n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per file
    rows = F.greatest(F.lit(block_bytes) / 8 / F.greatest("width", F.lit(1)), F.lit(1)).cast("long")
    blocks = heads.withColumn("base", before).where("n > 0").withColumn("rows", rows).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("rows"))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                kind, n = np.dtype(r["kind"]), min(r["rows"], r["n"] - r["first"])
                with _open(r["path"]) as f:
                    f.seek(r["at"] + r["first"] * r["width"] * kind.itemsize)
                    m = np.frombuffer(f.read(n * r["width"] * kind.itemsize), kind).astype("<f8")
                offsets = np.arange(n + 1, dtype=np.int32) * r["width"]
                number = np.arange(n, dtype=np.int64) + (r["base"] + r["first"])
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.ListArray.from_arrays(pa.array(offsets), pa.array(m))], ["vec_id", "embedding"])

    return blocks.repartition("path", "first").mapInArrow(run, "vec_id long, embedding array<double>")


def aligned(samples: DataFrame, vectors: DataFrame, sample_id: str, vector_id: str) -> DataFrame:
    """(n_samples, n_vectors, n_matched, warning) of the join by key. One row."""
    a, b = samples.select(F.col(sample_id).alias("k")), vectors.select(F.col(vector_id).alias("k"))
    both = a.join(b, "k").agg(F.count(F.lit(1)).alias("n_matched"))
    out = a.agg(F.count(F.lit(1)).alias("n_samples")).crossJoin(b.agg(F.count(F.lit(1)).alias("n_vectors"))).crossJoin(both)
    whole = (F.col("n_samples") == F.col("n_matched")) & (F.col("n_vectors") == F.col("n_matched"))
    return out.withColumn("warning", F.when(~whole, "samples and vectors don't match one to one: only matched rows count"))


def paired(samples: DataFrame, vectors: DataFrame, sample_no: str, vector_no: str, mode: str = "truncate") -> tuple[DataFrame, DataFrame]:
    """Both with rows numbered from 0 that the other has a counterpart for. Where the counts differ: 'truncate' keeps the first
    rows of the longer one, with a warning; 'error' raises a ValueError."""
    if mode not in ("truncate", "error"):
        raise ValueError(f"unknown mode {mode}")
    n, m = samples.count(), vectors.count()
    if n != m:
        said = f"{n} samples and {m} vectors"
        if mode == "error":
            raise ValueError(said)
        warnings.warn(f"{said}: the first {min(n, m)} of each are used", stacklevel=2)
    return samples.where(F.col(sample_no) < min(n, m)), vectors.where(F.col(vector_no) < min(n, m))


def normalised(df: DataFrame, need: tuple[str, ...] = ()) -> DataFrame | None:
    """df with trimmed lower-case column names; None if a needed one is missing."""
    out = df.toDF(*[c.strip().lower() for c in df.columns])
    return out if set(need) <= set(out.columns) else None


def table_rows(name: str, raw: bytes) -> list[dict[str, str | None]]:
    """The rows of a CSV or spreadsheet file by trimmed lower-case column name; empty cells are None."""
    import csv

    if name.lower().endswith(".xlsx"):
        rows = read_rows(raw)
    else:
        rows = [[x if x != "" else None for x in r] for r in csv.reader(io.StringIO(raw.decode("utf-8-sig", errors="replace"), newline=""))]
    if not rows:
        return []
    header = [(c or "").strip().lower() for c in rows[0]]
    return [{h: (r[k] if k < len(r) else None) for k, h in enumerate(header) if h} for r in rows[1:] if any(x is not None for x in r)]


PREDICTION = ("index", "question", "answer", "prediction", "answer_option", "split")


def read_predictions(spark: SparkSession, path: str, only: str | None = None, pattern: str = "*.{csv,xlsx}", recursive: bool = True, need: tuple[str, ...] = ("question", "answer", "prediction")) -> DataFrame:
    """(file, row, index, question, answer, prediction, answer_option, split) of all prediction tables under path but results
    of earlier runs. Each file is read by its own header; one that lacks a needed column or can't be read gives no rows.

    only: what a file's name must hold. read_predictions(..., pattern="*InfoVQA_TEST.xlsx", need=("index", "prediction")) finds
    the files of a submission.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path)
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    keep = ~base.rlike(r"(_acc|_results)\.(csv|xlsx)$")
    if only:
        keep = keep & base.contains(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    rows = table_rows(name, raw.as_py())
                except Exception:  # noqa: BLE001 - a broken file is skipped, as one without the columns is
                    continue
                if not rows or any(c not in rows[0] for c in need):
                    continue
                for a in range(0, len(rows), 4096):
                    part = rows[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(a, a + len(part)), pa.int64()), *(pa.array([r.get(c) for r in part], pa.string()) for c in PREDICTION)], ["file", "row", *PREDICTION])

    return files.where(keep).select("path", "content").mapInArrow(run, f"file string, row long, {', '.join(f'`{c}` string' for c in PREDICTION)}")


def read_accuracies(spark: SparkSession, path: str) -> DataFrame:
    """(file, total, a_count, accuracy) of '*_acc.csv' files with metric,value rows."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_acc.csv").schema("metric string, value double").csv(path)
    got = raw.withColumn("file", F.input_file_name()).groupBy("file").pivot("metric", ["total", "A_count", "accuracy"]).agg(F.first("value"))
    return got.select("file", F.col("total").cast("long").alias("total"), F.col("A_count").cast("long").alias("a_count"), "accuracy")


def read_summaries(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(file, pos, dataset, metric, value) of all '**/summary/summary_*.csv' under path; files whose path is malformed go."""
    from quern.operators.evalreport import summary_label

    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "summary_*.csv").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        for b in batches:
            rows = []
            for p, text in zip(b.column("path").to_pylist(), b.column("value").to_pylist(), strict=True):
                for k, r in enumerate(csv.DictReader(io.StringIO(text or ""))):
                    rows.append((p, k, r.get("dataset"), r.get("metric"), r.get(model) or None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["path", "pos", "dataset", "metric", "value"])

    rows = lines.where(F.col("path").contains("/summary/")).select("path", "value").mapInArrow(run, "path string, pos long, dataset string, metric string, value string")
    return rows.withColumn("file", summary_label(F.col("path"))).where("file is not null").drop("path")


# --- sinks -----------------------------------------------------------------------------------------------------------


def write_judged(judged: DataFrame, folder: str) -> None:
    """Appends `<folder>/scored` and `<folder>/errors` as JSON lines."""
    judged.where("valid").select("id", "metric", "scores").write.mode("append").json(f"{folder}/scored")
    judged.where("not valid").select("id", "metric", "raw").write.mode("append").json(f"{folder}/errors")


def tracked_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids already scored in the folder; none if it doesn't exist."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/scored")
    if not java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(java):
        return spark.createDataFrame([], "id string")
    return spark.read.schema("id string").json(f"{folder}/scored")


def write_report(df: DataFrame, path: str) -> None:
    """A report (a few rows) as one CSV file, or as a spreadsheet if path ends in .xlsx."""
    if not path.endswith(".xlsx"):
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return
    rows = df.limit(MOST).collect()
    _put(df.sparkSession, path, write_rows(df.columns, [tuple(r) for r in rows]))


def _put(spark: SparkSession, path: str, raw: bytes) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def submission_path(path: str) -> str:
    """Where the submission of a prediction table goes: beside it, as a_<name>.json."""
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}a_{name.rpartition('.')[0] or name}.json"


def write_submission(rows: DataFrame, path: str) -> None:
    """A submission as one JSON array of {questionId, answer}, in order, in one part file; rows are streamed, not gathered."""
    lines = rows.orderBy("questionId", "answer").select(F.to_json(F.struct("questionId", "answer")).alias("value")).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = "["  # a line waits for the comma that the next one brings
        for b in batches:
            for x in b.column("value").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([held])], ["value"])
                held = ("" if held == "[" else ",") + x
        yield pa.RecordBatch.from_arrays([pa.array([held, "]"])], ["value"])

    whole = rows.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1) if rows.isEmpty() else lines.mapInArrow(run, "value string")
    whole.write.mode("overwrite").text(path)
