"""Versioned tables of immutable files, and processing just what changed.

A table is a folder of Parquet files and numbered manifests.  Manifest *n*
lists the files of version *n*, each with the names of its deletion vectors
(Parquet tables of file and position, written once), and what its writer wants
remembered, such as the version of a source that it has taken in.  A manifest
appears under its name in one step or not at all, and never changes: a run that
dies before leaves files that no manifest names, and the next run starts from
the same version.  The driver holds names of files, never positions.

:func:`delta` diffs two manifests into added files, removed files and newly
deleted rows, and so into record deltas of sign +1 and -1.  :func:`run_once`
processes the delta since the last commit and saves the processed version in
the commit of its output, so a record is neither skipped nor repeated.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Manifest:
    version: int
    #: file -> names of its deletion vectors
    files: dict[str, tuple[str, ...]] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm
        self._read: dict[int, Manifest] = {}  # manifests never change

    def _name(self, version: int) -> str:
        return f"{self.path}/_manifests/{version:012d}.json"

    def latest(self) -> int:
        """The newest version, 0 if there is none."""
        at = self._jpath(f"{self.path}/_manifests")
        if not self._fs.exists(at):
            return 0
        return max([0, *(int(n[:12]) for s in self._fs.listStatus(at) if (n := s.getPath().getName()).endswith(".json") and n[:12].isdigit())])

    def manifest(self, version: int) -> Manifest:
        if version == 0:
            return Manifest(0)
        if version in self._read:
            return self._read[version]
        stream = self._fs.open(self._jpath(self._name(version)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        raw = json.loads(text)
        self._read = {version: Manifest(version, {k: tuple(v) for k, v in raw["files"].items()}, raw["meta"]), **{k: m for k, m in self._read.items() if k > version - 2}}
        return self._read[version]

    def commit(self, files: dict[str, tuple[str, ...]], meta: dict, base: int) -> int:
        """Makes version ``base`` + 1; :class:`Conflict` if it is there already."""
        version = base + 1
        self._fs.mkdirs(self._jpath(f"{self.path}/_manifests"))
        draft = self._jpath(f"{self.path}/_drafts/{version:012d}-{self._jvm.java.util.UUID.randomUUID()}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"files": {k: list(v) for k, v in files.items()}, "meta": meta}).encode()))
        out.close()
        if not self._publish(draft, self._jpath(self._name(version))):
            self._fs.delete(draft, False)
            raise Conflict(version)
        return version

    def _publish(self, draft, target) -> bool:  # noqa: ANN001
        """Gives the draft its name in one step that fails if the name is taken: of two writers, one wins."""
        try:
            if self._fs.getUri().getScheme() == "file":  # here a rename replaces, but a link does not
                java = self._jvm.java.nio.file.Paths
                local = lambda p: java.get(p.toUri())
                self._jvm.java.nio.file.Files.createLink(local(self._fs.makeQualified(target)), local(self._fs.makeQualified(draft)))
                self._fs.delete(draft, False)
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(draft, target, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def write_files(self, df: DataFrame, by: str | None = None, under: str = "data") -> list[str]:
        """Writes ``df`` as new files, one folder for each value of ``by``, and gives their names under the table's folder; commits nothing."""
        folder = f"{under}/{self._jvm.java.util.UUID.randomUUID()}"
        w = df.write.option("compression", "zstd")
        (w.partitionBy(by) if by else w).parquet(f"{self.path}/{folder}")
        found, it = [], self._fs.listFiles(self._jpath(f"{self.path}/{folder}"), True)
        while it.hasNext():
            name = it.next().getPath().toString()
            if name.endswith(".parquet"):
                found.append(folder + name.split(folder, 1)[1])
        return sorted(found)

    def append(self, df: DataFrame, meta: dict | None = None) -> int:
        base = self.latest()
        old = self.manifest(base)
        return self.commit(old.files | {f: () for f in self.write_files(df)}, meta or {}, base)

    def delete(self, condition: str, meta: dict | None = None) -> int:
        """Writes a deletion vector of the matching rows; a file none of whose rows is left is removed."""
        base = self.latest()
        files = dict(self.manifest(base).files)
        if files:
            live = self.read_files(files, position=True)
            hits = self.write_files(live.filter(condition).select("file", "pos"), under="vectors")
            name = hits[0].rsplit("/", 1)[0] if hits else ""
            hit = {r.file: r.n for r in self._vectors([name]).groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()} if name else {}  # one row for each file
            had = {r.file: r.n for r in self.read_files({f: files[f] for f in hit}, position=True).groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()} if hit else {}
            for f, n in hit.items():
                if n == had[f]:
                    del files[f]
                else:
                    files[f] = (*files[f], name)
        return self.commit(files, meta or {}, base)

    def _vectors(self, names: list[str]) -> DataFrame:
        """(vector, file, pos) of deletion vectors."""
        df = self.spark.read.schema("file string, pos bigint").parquet(*(f"{self.path}/{n}" for n in names))
        return df.select(F.regexp_extract(F.col("_metadata.file_path"), r"(vectors/[^/]+)/[^/]*$", 1).alias("vector"), "file", "pos")

    def read_files(self, files: dict[str, tuple[str, ...]], position: bool = False, only: bool = False) -> DataFrame:
        """Rows of files without those in the vectors named for each; with ``only``, just those."""
        schema = T.StructType([*self.schema.fields, T.StructField("file", T.StringType()), T.StructField("pos", T.LongType())]) if position else self.schema
        pairs = [(v, f) for f, names in files.items() for v in names]
        if not files or (only and not pairs):
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
        df = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in files))
        if not position and not pairs:
            return df
        name = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/.*)$", 1)
        df = df.select(*(F.col(f"`{c}`") for c in self.schema.fieldNames()), name.alias("__file"), F.col("_metadata.row_index").alias("__pos"))
        if pairs:  # names of files; the positions stay in their tables
            named = self.spark.createDataFrame(pairs, "vector string, file string")
            gone = self._vectors(sorted({v for v, _ in pairs})).join(named, ["vector", "file"], "left_semi").select("file", "pos")
            df = df.join(gone, (F.col("__file") == gone["file"]) & (F.col("__pos") == gone["pos"]), "left_semi" if only else "left_anti")
        return df.withColumnsRenamed({"__file": "file", "__pos": "pos"}) if position else df.drop("__file", "__pos")

    def read(self, version: int | None = None) -> DataFrame:
        return self.read_files(self.manifest(self.latest() if version is None else version).files)

    def delta(self, start: int, end: int) -> DataFrame:
        """Record deltas between two versions: the table's columns and ``sign``."""
        added, removed, gone, back = diff(self.manifest(start), self.manifest(end))
        parts = [(added, False, 1), (removed, False, -1), (gone, True, -1), (back, True, 1)]
        read = [self.read_files(files, only=only).withColumn("sign", F.lit(sign)) for files, only, sign in parts if files]
        return reduce(DataFrame.unionByName, read) if read else self.read_files({}).withColumn("sign", F.lit(1))


def diff(a: Manifest, b: Manifest) -> tuple[dict, dict, dict, dict]:
    """(added files, removed files, rows newly deleted in kept files, rows restored), each file -> vectors."""
    kept = [f for f in a.files if f in b.files]
    less = lambda x, y: tuple(v for v in x if v not in y)
    return (
        {f: v for f, v in b.files.items() if f not in a.files},
        {f: v for f, v in a.files.items() if f not in b.files},
        {f: v for f in kept if (v := less(b.files[f], a.files[f]))},
        {f: v for f in kept if (v := less(a.files[f], b.files[f]))},
    )


def net(deltas: DataFrame) -> DataFrame:
    """The rows that are more often added than taken away, once each."""
    columns = [c for c in deltas.columns if c != "sign"]
    return deltas.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.sum("sign").alias("sign")).filter("sign > 0").drop("sign")


def processed(out: VersionedTable) -> int:
    """The source's version that the output's last commit has taken in."""
    return int(out.manifest(out.latest()).meta.get("processed", 0))


def run_once(source: VersionedTable, out: VersionedTable, step: Callable[[DataFrame], DataFrame], to: int | None = None, meta: dict | None = None) -> tuple[int, int] | None:
    """Processes the deltas since the last successful run, up to version ``to`` (the newest); (from, to), or None if there are none.

    The rows and the processed version become visible in one commit.  Should the run fail anywhere
    before, nothing is visible and the next run takes the same deltas; should two runs race, one gets
    :class:`Conflict` and its files stay unnamed.
    """
    base = out.latest()
    start, end = processed(out), source.latest() if to is None else to
    if start == end:
        return None
    files = out.write_files(step(source.delta(start, end)))
    out.commit(out.manifest(base).files | {f: () for f in files}, {**(meta or {}), "processed": end}, base)
    return start, end


NEVER = -(2**63)


def replay(feed: DataFrame, runs: list[tuple[int, object, bool]], arrived: str, key: str, modified: str, root: str) -> VersionedTable:
    """Logged runs over a feed of states, each by :func:`run_once`: a table (run_no, key, m) of what each took.

    ``runs``: (number, start, whether it succeeded), a fixed small log.  Before each run the feed's table has a
    version with all rows that arrived before its start; a run takes in the difference between the version it
    sees and the one that the output's last commit has saved.  Of these rows, it takes a key that no run took
    before, or whose latest ``modified`` it reads is later than all taken before; null is earlier than any.
    ``m``, that time, is the output's own record of what was taken.  A failed run commits nothing, so the next
    one finds the version processed where it was.

    Null keys are no records.  Rows at or after the last start, or without ``arrived``, are not read by any run.
    """
    spark = feed.sparkSession
    runs = sorted(runs, key=lambda r: (r[1], r[0]))
    time = F.unix_micros(modified) if isinstance(feed.schema[modified].dataType, T.TimestampType) else F.col(modified).cast("bigint")
    states = feed.filter(F.col(arrived).isNotNull() & F.col(key).isNotNull()).select(key, F.coalesce(time, F.lit(NEVER)).alias("m"), arrived)
    source = VersionedTable(spark, f"{root}/feed", states.select(key, "m").schema)
    taken = VersionedTable(spark, f"{root}/taken", T.StructType([T.StructField("run_no", T.LongType()), states.schema[key], T.StructField("m", T.LongType())]))
    if not runs:
        return taken
    starts = F.array(*(F.lit(r[1]) for r in runs))
    # the first version that has a row: one more than the number of starts up to its arrival
    version = F.aggregate(starts, F.lit(1), lambda n, s: n + F.when(s <= F.col(arrived), 1).otherwise(0))
    rows = states.select(key, "m", version.alias("version")).filter(F.col("version") <= len(runs))
    by_version: dict[int, list[str]] = {}
    for f in source.write_files(rows.repartitionByRange("version", key), "version"):  # few files, and a large version in several
        by_version.setdefault(int(f.split("version=")[1].split("/")[0]), []).append(f)
    files: dict[str, tuple[str, ...]] = {}
    for v in range(1, len(runs) + 1):
        files = files | {f: () for f in by_version.get(v, [])}
        source.commit(files, {}, v - 1)

    for v, (number, _, ok) in enumerate(runs, 1):
        if not ok:
            continue

        def step(deltas: DataFrame, number: int = number, v: int = v) -> DataFrame:
            only_added = not any(diff(source.manifest(processed(taken)), source.manifest(v))[1:])
            fresh = deltas if only_added else net(deltas)  # a key's latest is the same however often it was added
            both = fresh.select(key, F.col("m").alias("m"), F.lit(None).cast("bigint").alias("before")).unionByName(taken.read().select(key, F.lit(None).cast("bigint").alias("m"), F.col("m").alias("before")))
            latest = both.groupBy(key).agg(F.max("m").alias("m"), F.max("before").alias("before"))  # one shuffle of keys and times
            return latest.filter("m is not null and (before is null or m > before)").select(F.lit(number).cast("bigint").alias("run_no"), key, "m")

        run_once(source, taken, step, v, {"run": number})
    return taken
