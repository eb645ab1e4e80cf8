"""Size-tiered compaction of a table kept as immutable shards under a versioned manifest.

An append writes its rows as small Parquet shards. Compaction puts the shards below half the target into
tiers by size (each ``fanout`` times the one before), and merges every tier that has ``fanout`` shards or
more into files of up to the target. The list of live shards is a manifest; a new version appears by a
rename that never replaces a file, so of two writers one wins and the other starts again from the new one.
Readers open the shards of one version and see nothing of later ones until they ask again.

All work on rows is DataFrame functions; the driver handles the manifest, one small record a shard.

Defined cases: an empty append writes nothing and leaves the version as it is; a store without shards reads
as no rows of the schema given; nulls, repeated rows and any columns are kept as they are.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

#: Parameters: bytes of a merged file, size ratio of tiers and least number of shards merged; of an appended shard the
#: most rows, and about the bytes before compression.
TARGET_BYTES, FANOUT, APPEND_ROWS, APPEND_BYTES = 128 << 20, 4, 100_000, 4 << 20
#: Below this size shards are one tier.
LEAST_BYTES = 64 << 10
#: Runs that one job merges, a task each, so that its plan stays bounded; and jobs at a time, which together fill a cluster.
RUNS_IN_JOB, JOBS = 64, 32


class Conflict(Exception):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


def tier(size: int, fanout: int) -> int:
    number = 0
    while size > LEAST_BYTES:
        size //= fanout
        number += 1
    return number


def plan(shards: list[Shard], target: int, fanout: int) -> list[list[Shard]]:
    """The runs to merge: shards of a tier in order of size, cut where the target is full; none of one shard."""
    tiers: dict[int, list[Shard]] = {}
    for s in sorted((s for s in shards if s.bytes <= target // 2), key=lambda s: (s.bytes, s.path)):
        tiers.setdefault(tier(s.bytes, fanout), []).append(s)
    runs = []
    for own in (x for x in tiers.values() if len(x) >= fanout):
        run: list[Shard] = []
        for s in own:
            if run and sum(x.bytes for x in run) + s.bytes > target:
                runs.append(run)
                run = []
            run.append(s)
        runs.append(run)
    return [r for r in runs if len(r) > 1]


def row_bytes(rows: DataFrame) -> Column:
    """About the bytes of a row: those of its texts and eight for any other value or element."""

    def of(field: StructField) -> Column:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
        return 8 * F.greatest(F.size(c), F.lit(1)).cast("long") if isinstance(kind, (ArrayType, MapType)) else F.lit(8).cast("long")

    return reduce(Column.__add__, map(of, rows.schema.fields), F.lit(1).cast("long"))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, append_rows: int = APPEND_ROWS, append_bytes: int = APPEND_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fanout, self.append_rows, self.append_bytes = target_bytes, fanout, append_rows, append_bytes
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def version(self) -> int:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifest/{version:020d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def commit(self, based_on: int, shards: list[Shard]) -> int:
        """Publishes version ``based_on + 1``; raises Conflict if it exists."""
        final = f"{self.root}/manifest/{based_on + 1:020d}.json"
        temporary = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(temporary), False)
        out.write(bytearray(json.dumps({"version": based_on + 1, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        never_replace = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(temporary), self._path(final), never_replace)
        except Py4JJavaError as e:
            self._fs.delete(self._path(temporary), False)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                raise Conflict(final) from e
            raise
        return based_on + 1

    def _publish(self, added: list[Shard], removed: set[str]) -> int:
        """Commits on top of whatever is the newest version; gives up if the shards to remove are gone."""
        while True:
            version = self.version()
            now = self.shards(version)
            if not removed <= {s.path for s in now}:
                raise Conflict("another writer has merged these shards")
            try:
                return self.commit(version, [s for s in now if s.path not in removed] + added)
            except Conflict:
                continue

    def _files(self, directory: str) -> list[Shard]:
        found, files = [], self._fs.listFiles(self._path(directory), True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                found.append(Shard(f.getPath().toString(), f.getLen()))
        return sorted(found, key=lambda s: s.path)

    def append(self, rows: DataFrame) -> int:
        """Writes the rows as shards and publishes them. How many rows make a shard follows from their mean size."""
        n, size = rows.agg(F.count(F.lit(1)), F.sum(row_bytes(rows))).first()
        if not n:
            return self.version()
        most = max(1, min(self.append_rows, self.append_bytes * n // size))
        directory = f"{self.root}/data/append-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", most).option("compression", "zstd").parquet(directory)
        return self._publish(self._files(directory), set())

    def compact_once(self) -> bool:
        """One merge of all runs there are now, JOBS jobs of RUNS_IN_JOB of them at a time; False if there are none."""
        runs = plan(self.shards(), self.target, self.fanout)
        if not runs:
            return False
        directory = f"{self.root}/data/merge-{uuid.uuid4().hex}"
        schema = self.spark.read.option("mergeSchema", "true").parquet(*(s.path for run in runs for s in run)).schema

        def merge(at: int) -> None:  # a task reads the shards of a run one after the other and writes one file: no shuffle
            parts = [self.spark.read.schema(schema).parquet(*(s.path for s in run)).coalesce(1) for run in runs[at : at + RUNS_IN_JOB]]
            reduce(DataFrame.union, parts).write.option("compression", "zstd").parquet(f"{directory}/{at}")

        with ThreadPoolExecutor(JOBS) as pool:
            for _ in pool.map(inheritable_thread_target(self.spark)(merge), range(0, len(runs), RUNS_IN_JOB)):
                pass
        gone = {s.path for run in runs for s in run}
        self._publish(self._files(directory), gone)
        return True

    def compact(self) -> int:
        """Merges until no tier is full, and says how often."""
        passes = 0
        while self.compact_once():
            passes += 1
        return passes

    def vacuum(self) -> int:
        """Deletes files that the newest version doesn't list. Only safe when no reader holds an older one."""
        live = {s.path for s in self.shards()}
        dead = [s for s in self._files(f"{self.root}/data") if s.path not in live]
        for s in dead:
            self._fs.delete(self._path(s.path), False)
        return len(dead)

    def read(self, schema: StructType, version: int | None = None) -> DataFrame:
        paths = [s.path for s in self.shards(version)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
