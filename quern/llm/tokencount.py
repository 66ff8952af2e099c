"""Token counts of documents in flat token files by a separator scan.

A token file is a run of fixed-width little-endian token ids in which each document ends with a separator id; there is no
index. Files are cut into blocks of `block_tokens`; each block is read and searched for separators at once (vectorised). A
document may span blocks: a prefix scan over the blocks of a file (a window over one small row per block) carries the number
of separators and the place of the last one into each block, which gives every document's number, start and length.

Edge cases: an empty file has no documents; two separators in a row are an empty document; tokens after the last separator
are a document with closed = false; trailing bytes that make no whole token are ignored. write_token_files() writes a null
text as an empty document, takes the other columns as they are and skips none; an empty table gives no files.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import bpe as B
from quern.llm.common import materialise, pieces, shared_dir, ship

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50256


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, folder: str, text_col: str = "text", vocabulary: str = VOCABULARY, separator: int = SEPARATOR) -> DataFrame:
    """(file, path, n_bytes), one row for each flat uint16 file; file is the partition's number.

    A separator that is a token of the vocabulary, or ids that don't fit 16 bits, are an error.

    A file's name is unique to the attempt that writes it, and only attempts that end well have a row here, so a lost or
    repeated task leaves nothing that is read.
    """
    spark = docs.sparkSession
    ship(spark)
    content = B.read_vocabulary(vocabulary)
    ids = {int(line.split()[1]) for line in content.splitlines() if line}
    if separator in ids:
        raise ValueError(f"the separator {separator} is a token of the vocabulary")
    if max(ids | {separator}) >= 1 << 16:
        raise ValueError("token ids above 65,535 don't fit the files")
    raw = spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = B.of(raw.value, B.PATTERN)
        number = TaskContext.get().partitionId()
        out, path, size = None, f"{folder}/tokens-{number:06d}-{uuid.uuid4().hex}.u16", 0
        end = np.array([separator], "<u2").tobytes()
        for part in pieces(batches, text_col, 2 << 20, owner="bpe"):
            if out is None:
                where, name = _open(path)
                where.create_dir(name.rpartition("/")[0], recursive=True)
                out = where.open_output_stream(name)
            got = io.BytesIO()
            for ids in bpe.encode_texts(part.column(text_col).to_pylist()):
                got.write(np.frombuffer(ids, "<i4").astype("<u2").tobytes())
                got.write(end)
            out.write(got.getbuffer())
            size += got.tell()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([path]), pa.array([size], pa.int64())], ["file", "path", "n_bytes"])

    return materialise(docs.select(F.col(text_col)).mapInArrow(run, "file long, path string, n_bytes long"))


def _scan(separator: int, dtype: str):
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                where, name = _open(r["path"])
                with where.open_input_file(name) as f:
                    f.seek(r["first"] * width)
                    block = np.frombuffer(f.read(r["n"] * width), dtype)
                ends = np.flatnonzero(block == separator) + r["first"]
                tail = r["first"] + r["n"] == r["total"] and block[-1] != separator
                rows.append((r["file"], r["block"], ends.size, int(ends[-1]) if ends.size else None, ends.tolist() + ([r["total"]] if tail else []), bool(tail)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["file", "block", "n_ends", "last_end", "ends", "tail"])

    return run


def count_tokens(files: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2", block_tokens: int = 4 << 20) -> DataFrame:
    """(file, doc_no, first_token, n_tokens, closed) for each document of files (file long, path string, n_bytes long)."""
    ship(files.sparkSession)
    width = np.dtype(dtype).itemsize
    total = F.floor(F.col("n_bytes") / width).cast("long")
    blocks = files.withColumn("total", total).where("total > 0").select("file", "path", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / block_tokens).cast("long"))).alias("block"))
    blocks = blocks.withColumn("first", F.col("block") * block_tokens).withColumn("n", F.least(F.lit(block_tokens).cast("long"), F.col("total") - F.col("first")))
    found = blocks.repartition("path", "block").mapInArrow(_scan(separator, dtype), "file long, block long, n_ends long, last_end long, ends array<long>, tail boolean")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = found.withColumn("done", F.coalesce(F.sum("n_ends").over(before), F.lit(0))).withColumn("from", F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)))
    each = carried.select("file", "done", "from", "ends", "tail", F.posexplode("ends").alias("i", "end"))
    first = F.when(F.col("i") == 0, F.col("from")).otherwise(F.get("ends", F.col("i") - 1) + 1)
    return each.select("file", (F.col("done") + F.col("i")).alias("doc_no"), first.alias("first_token"), (F.col("end") - first).alias("n_tokens"), (~(F.col("tail") & (F.col("i") == F.size("ends") - 1))).alias("closed"))


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Writes docs as flat token files in the shared folder and counts the tokens of each document there."""
    spark: SparkSession = docs.sparkSession
    return count_tokens(write_token_files(docs, shared_dir(spark), text_col))
