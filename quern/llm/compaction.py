"""Sharding by size-tiered compaction: small immutable shards, merges of similar sizes, an atomically committed manifest.

A store is a folder with `data/` (Parquet files, never changed once written) and `versions/` (one JSON manifest per version:
the files that make up the table, with bytes and rows). A writer makes its files first, then commits version v + 1 by creating
its manifest under a temporary name and renaming it, which fails if the version exists already; the loser reads the new state
and tries again (append) or gives up (compact). Readers use the newest manifest and so see whole versions only; files of tasks
or jobs that were lost are in no manifest.

Compaction groups files into tiers by size (each tier `fanout` times the one below; files of `target` bytes or more are done).
A tier with `fanout` or more files is merged into as many files of at least about `target` bytes as it fills or, if it has
less than that, into one; so every merge lowers the number of files, and every row is rewritten a logarithmic number of times.
Row order within a merged file is that of its parts.

A writer announces the folder that it writes to in `intents/` and withdraws that after its commit. retire() looks at the files
first, then at the intents, then at the manifests, so that a file is either of a writer at work, or in a manifest if that
writer committed. An intent older than `grace` seconds is one of a writer that died.

Nulls and edge cases: rows are stored as they are, repeated rows and null columns included; the schema is that of the first
append and later ones must have the same columns (any order); appending an empty table commits a version without new files;
a store without versions reads as an error, one without files as an empty table; retire() deletes files that no
manifest from `keep` versions back has and no writer at work announced.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import fresh, shared_dir


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class File:
    path: str
    size: int


@dataclass(frozen=True)
class Version:
    number: int
    files: tuple[File, ...]
    schema: str


class Store:
    def __init__(self, spark: SparkSession, folder: str, target: int = 256 << 20, fanout: int = 4):
        self.spark, self.folder, self.target, self.fanout = spark, folder.rstrip("/"), target, fanout
        self.java = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.java.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.java.Path(f"{self.folder}/{name}")

    def _list(self, path) -> list:
        return list(self.fs.listStatus(path)) if self.fs.exists(path) else []

    def _text(self, path) -> str:
        rows = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self.fs.open(path)
        try:
            return rows.toString(stream, "UTF-8")
        finally:
            stream.close()

    def current(self) -> Version | None:
        numbers = sorted(int(n[1:-5]) for n in (s.getPath().getName() for s in self._list(self._path("versions"))) if n.endswith(".json") and n[0] == "v")
        return self.version(numbers[-1]) if numbers else None

    def version(self, number: int) -> Version:
        x = json.loads(self._text(self._path(f"versions/v{number:010d}.json")))
        return Version(number, tuple(File(p, n) for p, n in x["files"]), x["schema"])

    def commit(self, base: Version | None, files: tuple[File, ...], schema: str) -> Version:
        """Makes the version after base; Conflict if there is one already."""
        number = base.number + 1 if base else 1
        final, draft = self._path(f"versions/v{number:010d}.json"), self._path(f"versions/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"files": [[f.path, f.size] for f in files], "schema": schema}).encode()))
        finally:
            out.close()
        # a rename doesn't replace an existing file on HDFS; where a file system would, the check narrows it to this call
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise Conflict(f"version {number} exists")
        return Version(number, files, schema)

    def _written(self, folder: str) -> tuple[File, ...]:
        found, todo = [], [self.java.Path(folder)]
        while todo:
            for s in self._list(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                elif s.getPath().getName().endswith(".parquet"):
                    found.append(File(s.getPath().toString(), int(s.getLen())))
        return tuple(sorted(found, key=lambda f: f.path))

    def append(self, df: DataFrame) -> Version:
        """Adds df as new small shards."""
        return self.append_each(df, None)[0]

    def append_each(self, df: DataFrame, arrival: str | None) -> list[Version]:
        """Adds the rows of each value of the column `arrival` (not stored) as an arrival of its own, in order, written in one pass."""
        base = self.current()
        kept = df.drop(arrival) if arrival else df
        schema = base.schema if base else kept.schema.json()
        names = [f.name for f in T.StructType.fromJson(json.loads(schema)).fields]
        if sorted(names) != sorted(kept.columns):
            raise ValueError(f"columns differ from the store's: {kept.columns}")
        folder, intent = self._announce()
        ordered = df.select(*[F.col(f"`{n}`") for n in names], *([F.col(f"`{arrival}`")] if arrival else []))
        done = []
        try:
            (ordered.write.partitionBy(arrival) if arrival else ordered.write).parquet(folder)
            parts: dict[str, list[File]] = {}
            for f in self._written(folder):
                parts.setdefault(f.path[: f.path.rindex("/")] if arrival else "", []).append(f)
            for _, files in sorted(parts.items()) or [("", [])]:
                while True:
                    base = self.current()
                    try:
                        done.append(self.commit(base, (*(base.files if base else ()), *files), schema))
                        break
                    except Conflict:
                        continue
        finally:
            self.fs.delete(intent, False)
        return done

    def _announce(self):
        """A new folder for data and the intent that announces it."""
        name = uuid.uuid4().hex
        intent = self._path(f"intents/{name}")
        self.fs.create(intent, False).close()
        return f"{self.folder}/data/{name}", intent

    def _tier(self, size: int) -> int:
        tier, top = 0, 1 << 16
        while size > top:
            tier, top = tier + 1, top * self.fanout
        return tier

    def plan(self, version: Version) -> list[list[File]]:
        """The runs to merge: the files of each tier that has enough of them."""
        tiers: dict[int, list[File]] = {}
        for f in version.files:
            if f.size < self.target:
                tiers.setdefault(self._tier(f.size), []).append(f)
        return [files for _, files in sorted(tiers.items()) if len(files) >= self.fanout]

    def compact(self) -> Version | None:
        """Merges until no tier is full; each merge is a version. Returns the newest."""
        base = self.current()
        while base and (runs := self.plan(base)):
            merged, gone, intents = [], set(), []
            try:
                for run in runs:
                    folder, intent = self._announce()
                    intents.append(intent)
                    full = max(1, sum(f.size for f in run) // self.target)  # fewer than files, each of which is smaller than target
                    self._load(tuple(run), base.schema).coalesce(full).write.parquet(folder)
                    merged += self._written(folder)
                    gone |= {f.path for f in run}
                base = self.commit(base, (*(f for f in base.files if f.path not in gone), *merged), base.schema)
            finally:
                for intent in intents:
                    self.fs.delete(intent, False)
        return base

    def _load(self, files: tuple[File, ...], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f.path for f in files])

    def read(self, number: int | None = None) -> DataFrame:
        found = self.version(number) if number else self.current()
        if found is None:
            raise FileNotFoundError(self.folder)
        return self._load(found.files, found.schema)

    def retire(self, keep: int = 1, grace: float = 86_400) -> int:
        """Deletes files that none of the newest `keep` versions has and that no writer announced within `grace` seconds; older
        versions can't be read then. Returns how many."""
        files = self._written(f"{self.folder}/data")
        since = (time.time() - grace) * 1000
        busy = {s.getPath().getName() for s in self._list(self._path("intents")) if s.getModificationTime() >= since}
        now = self.current()
        if not now:
            return 0
        used = {f.path for n in range(max(1, now.number - keep + 1), now.number + 1) for f in self.version(n).files}
        root = len(self.fs.makeQualified(self._path("data")).toString()) + 1
        gone = [f for f in files if f.path not in used and f.path[root:].split("/")[0] not in busy]
        for f in gone:
            self.fs.delete(self.java.Path(f.path), False)
        return len(gone)


def shard(df: DataFrame, key: str = "doc_id", arrivals: int = 4, target: int = 128 << 20, fanout: int = 4) -> DataFrame:
    """Puts df into a new store in the shared folder, as `arrivals` arrivals by the hash of key, compacts it and reads it back."""
    store = Store(df.sparkSession, shared_dir(df.sparkSession), target, fanout)
    arrival = fresh("__arrival", df.columns)
    store.append_each(df.withColumn(arrival, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(arrivals)).cast("int")), arrival)
    store.compact()
    store.retire()
    return store.read()
