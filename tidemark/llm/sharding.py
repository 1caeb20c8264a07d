"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards, as the tasks hold them, without a shuffle. Compaction
sorts the shards into tiers by size, takes runs of neighbouring shards of a tier and merges each into one file of
about the target size. Every append and compaction ends with one commit: a manifest (a Parquet table with a row a
shard) is written under a new name, and renaming a pointer file to the next version number makes it the current
one. The rename fails if that version exists, so of two writers one has to start again. Readers keep the version
they opened until `vacuum`. Nothing is changed in place: a lost executor or driver leaves the last version whole.

The rename is atomic on HDFS and local disks; an object store needs a connector that refuses to rename onto an
existing name. Pointers are never deleted, as they are what makes a number taken.

One compaction job merges at most MERGE_SHARDS shards, whose plan is therefore small enough to broadcast; larger
backlogs take several jobs, each with its commit. Runs of neighbours are sought within spans of SPAN places, so that
no task plans the whole manifest.

Defined cases
- empty table: a version without shards; reading gives no rows with the right columns.
- nulls, empty and very long texts, repeated rows: stored and returned as they are. A row larger than the target
  makes a larger file.
- columns with any name are kept; the columns for the merge have names that the table lacks.
- ties in size or arrival: by file name.
- `vacuum` beside other writers: files of an append or merge that is not committed yet are in no manifest and stay,
  unless they are older than `grace_hours`; a commit on a parent whose manifest was vacuumed fails and is started again.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import columns_of, written

MANIFEST = "file string, bytes long, rows long, seq long, tier int"
MERGE_SHARDS = 100_000
#: Places (seq) among which runs of neighbours are sought, as a power of two.
SPAN = 17


@dataclass(frozen=True)
class Tiers:
    """`arrival_rows`: most rows of an arriving shard. A tier's shards are up to `fanout` times as large as the tier below's."""

    arrival_rows: int = 2_000
    target_bytes: int = 64 << 20
    fanout: int = 4
    least_bytes: int = 1 << 20
    least_runs: int = 4


class ShardTable:
    """A folder of shards with its versions."""

    def __init__(self, spark: SparkSession, path: str, tiers: Tiers = Tiers()):
        self.spark, self.path, self.tiers = spark, path.rstrip("/"), tiers
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        where = self._path(self.path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = where.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    # Versions

    def version(self) -> int:
        """The newest version, 0 if there is none."""
        folder = self._path(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([0, *(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())])

    def _pointer(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/_versions/v{version:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self._pointer(version)["manifest"])

    def _commit(self, shards: DataFrame, schema: T.StructType, parent: int) -> int:
        """Makes `shards` the version after `parent`, or fails if another writer has made it."""
        name = f"{self.path}/_manifests/{uuid.uuid4().hex}"
        shards.select("file", "bytes", "rows", "seq", "tier").write.parquet(name)
        draft = self._path(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
        stream.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        self._context.rename(draft, self._path(f"{self.path}/_versions/v{parent + 1:012d}"), self.spark.sparkContext._gateway.new_array(rename, 0))
        return parent + 1

    # Shards

    def _tier(self):
        steps = F.log(F.greatest(F.col("bytes") / self.tiers.least_bytes, F.lit(1.0))) / F.log(F.lit(float(self.tiers.fanout)))
        return F.floor(steps).cast("int")

    def _written(self, folder: str, schema: T.StructType) -> DataFrame:
        """file, bytes and rows of the shards in a folder; files without rows are none."""
        sizes = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
        data = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        rows = data.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
        return written(sizes.select(_uri(F.col("path")).alias("file"), F.col("length").alias("bytes")).join(rows.select(_uri(F.col("file")).alias("file"), "rows"), "file"), "new-shards")

    def append(self, docs: DataFrame) -> int:
        """Adds the rows of `docs` as small shards; the new version."""
        parent = self.version()
        run = f"{self.path}/data/arrival-{parent + 1:012d}-{uuid.uuid4().hex}"
        docs.write.option("compression", "zstd").option("maxRecordsPerFile", self.tiers.arrival_rows).parquet(run)
        old = self.manifest(parent)
        last = old.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        new = self._written(run, docs.schema)
        # Places in the order of file names: a sorted table in as few parts as hold a span each.
        ordered = new.orderBy("file").coalesce(max(1, new.count() >> SPAN))
        new = ordered.withColumn("seq", F.monotonically_increasing_id() + (last + 1)).withColumn("tier", self._tier())
        return self._commit(old.unionByName(new.select(*old.columns)), docs.schema, parent)

    def _plan(self, shards: DataFrame) -> DataFrame:
        """file, seq, tier, span, n: neighbouring shards of a tier, each (tier, span, n) about a target file. Large shards stay."""
        t = self.tiers
        small = shards.where(F.col("bytes") < t.target_bytes // 2).withColumn("span", F.shiftright("seq", SPAN))
        before = Window.partitionBy("tier", "span").orderBy("seq", "file").rowsBetween(Window.unboundedPreceding, -1)
        runs = small.withColumn("n", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / t.target_bytes))
        sized = runs.withColumn("in_run", F.count("*").over(Window.partitionBy("tier", "span", "n")))
        return sized.where(F.col("in_run") >= t.least_runs).select("file", "seq", "tier", "span", "n")

    def compact(self) -> int:
        """Merges similarly sized neighbours until no tier has a run to merge; the last version."""
        while True:
            parent = self.version()
            if not parent:
                return 0
            shards = self.manifest(parent)
            chosen = self._plan(shards).orderBy("tier", "span", "n", "seq", "file").limit(MERGE_SHARDS).collect()
            number: dict[tuple, int] = {}
            for r in chosen:
                number.setdefault((r["tier"], r["span"], r["n"]), len(number))
            if not number:
                return parent
            schema = T.StructType.fromJson(self._pointer(parent)["schema"])
            grp, seq, row, file = _free(schema.names, "shard_grp", "shard_seq", "shard_row", "shard_file")
            steps = self.spark.createDataFrame([(r["file"], number[r["tier"], r["span"], r["n"]], r["seq"]) for r in chosen], f"{file} string, {grp} int, {seq} long")
            data = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[r["file"] for r in chosen])
            read = data.select(*columns_of(data), _uri(F.col("_metadata.file_path")).alias(file), F.col("_metadata.row_index").alias(row))
            merged = read.join(F.broadcast(steps), file).drop(file)
            run = f"{self.path}/data/merge-{parent + 1:012d}-{uuid.uuid4().hex}"
            # One task a group: each writes a file of about the target size.
            (
                merged.repartitionById(len(number), F.col(grp))
                .sortWithinPartitions(grp, seq, row)
                .drop(seq, row)
                .write.option("compression", "zstd")
                .partitionBy(grp)
                .parquet(run)
            )
            new = self._written(run, schema).withColumn(grp, F.regexp_extract("file", rf"/{grp}=(\d+)/", 1).cast("int"))
            first = steps.groupBy(grp).agg(F.min(seq).alias("seq"))
            new = new.join(F.broadcast(first), grp).withColumn("tier", self._tier())
            kept = shards.join(F.broadcast(steps.select(F.col(file).alias("file"))), "file", "left_anti")
            self._commit(kept.unionByName(new.select(*kept.columns)), schema, parent)

    def read(self, version: int | None = None, with_shard: str | None = None) -> DataFrame:
        """The rows of a version; `with_shard` names a column for the file of each."""
        version = self.version() if version is None else version
        schema = T.StructType.fromJson(self._pointer(version)["schema"])
        files = [r["file"] for r in self.manifest(version).select("file").collect()]  # target-sized files: one name for each
        if not files:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn(with_shard, F.lit("")) if with_shard else empty
        data = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*files)
        return data.select("*", _uri(F.col("_metadata.file_path")).alias(with_shard)) if with_shard else data

    def vacuum(self, grace_hours: float = 168.0) -> int:
        """Deletes the files that only older versions name, then those versions' manifests; how many files.

        Folders of data that no version names and that are older than `grace_hours` are leavings of failed writers and
        go too. File names come to the driver one by one, not all at once.
        """
        now, current = self.version(), self.manifest().select("file")
        old = [self._pointer(v)["manifest"] for v in range(1, now)]
        old = [m for m in old if self._fs.exists(self._path(m))]
        gone = 0
        if old:
            named = written(self.spark.read.schema(MANIFEST).parquet(*old).select("file").distinct(), "named-shards")
            for r in named.join(current, "file", "left_anti").toLocalIterator():
                gone += self._fs.delete(self._path(r["file"]), False)
            for m in old:
                self._fs.delete(self._path(m), True)
        runs = {r[0] for r in current.select(F.regexp_extract("file", r"/data/([^/]+)/", 1)).distinct().toLocalIterator()}
        data = self._path(f"{self.path}/data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            age = time.time() - status.getModificationTime() / 1000
            if status.getPath().getName() not in runs and age > grace_hours * 3600:
                self._fs.delete(status.getPath(), True)
        return gone


def _uri(path):
    """One spelling of a local file's URI."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def _free(taken: list[str], *names: str) -> list[str]:
    low = {t.lower() for t in taken}
    return [next(n for n in (name + "_" * k for k in range(len(low) + 1)) if n not in low) for name in names]
