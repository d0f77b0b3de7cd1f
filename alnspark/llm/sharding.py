"""Size-tiered compaction of a sharded table, with versioned manifests.

Arrivals are appended as small immutable shards. Shards of one tier (a tier is a power of FANIN below the target) are
merged into files of up to the target size as soon as FANIN of them have gathered, so a row is written again once a
tier, not once an arrival. A version of the table is a manifest that lists its shards; it is committed by one rename
that fails if the version exists, and tried again upon the newer version then. Readers see a version whole or not at
all, and old versions stay until vacuum is called. A run that dies leaves files that no manifest lists; vacuum finds them.

A merge has no shuffle: each output file is one task that reads its inputs one after the other.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
FANIN = 4
#: Output files that one job makes; further ones go to the next job.
FILES_PER_JOB = 256
#: A shard's path below the table's folder, whatever stands before: the last folder that append or _merge has named.
SHARD_PATH = "^.*(data/(?:append|merge)-[0-9a-f]{32}/.*)$"


@dataclass(frozen=True)
class Shard:
    path: str  # below the table's folder
    bytes: int
    rows: int

    def tier(self, target: int, fanin: int) -> int:
        """0 for a file of half the target or more; k for one up to target / fanin**(k - 1)."""
        return 0 if 2 * self.bytes > target else max(1, math.ceil(math.log(target / max(1, self.bytes), fanin)))


def merge_groups(shards: list[Shard], target: int) -> list[list[Shard]]:
    """Shards of one tier in groups of about the target size: in order of size, a group is closed when it is full.
    What is left over stays as it is."""
    groups: list[list[Shard]] = []
    now: list[Shard] = []
    size = 0
    for s in sorted(shards, key=lambda s: (s.bytes, s.path)):
        if now and size + s.bytes > target:
            groups.append(now)
            now, size = [], 0
        now.append(s)
        size += s.bytes
    groups.append(now)
    return [g for g in groups if len(g) > 1]


class ShardedTable:
    """A table below `root`, any folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanin: int = FANIN):
        self.spark, self.root, self.target, self.fanin = spark, root.rstrip("/"), target_bytes, fanin
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def versions(self) -> list[int]:
        folder = self._fs_path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest_path(self, version: int) -> str:
        return f"{self.root}/_manifests/v{version:09d}.json"

    def shards(self, version: int) -> list[Shard]:
        if not version:
            return []
        return [Shard(x["path"], x["bytes"], x["rows"]) for x in map(json.loads, self._text(self.manifest_path(version)).splitlines())]

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._fs_path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, path, text: str) -> None:
        out = self._fs.create(path, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _commit(self, version: int, shards: list[Shard]) -> int:
        """Write the manifest beside its place and move it there; fails if another writer has made this version."""
        lines = [json.dumps(asdict(s) | {"shard": k, "tier": s.tier(self.target, self.fanin), "version": version}) for k, s in enumerate(sorted(shards, key=lambda s: s.path))]
        draft = self._fs_path(f"{self.root}/_manifests/.draft-{uuid.uuid4().hex}")
        self._write(draft, "\n".join(lines))
        jvm = self.spark._jvm
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        place = self._fs_path(self.manifest_path(version))
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, place, how)
        return version

    def _publish(self, change: Callable[[list[Shard]], list[Shard] | None], tries: int = 50) -> int:
        """Commit change(shards of the newest version) as the next one; anew if another writer was first. None: no
        change, the newest version stays."""
        for attempt in range(tries):
            version = (self.versions() or [0])[-1]
            shards = change(self.shards(version))
            if shards is None:
                return version
            try:
                return self._commit(version + 1, shards)
            except Exception:
                if version + 1 not in self.versions() or attempt + 1 == tries:
                    raise
        raise ValueError("tries has to be positive")

    # data

    def _written(self, folder: str) -> list[Shard]:
        """The files of a folder that has just been written: names and sizes, with the rows of each."""
        # of a column that no file has, so that no column of the rows is in the way
        whole = self.spark.read.option("recursiveFileLookup", "true").schema("`_none` int").parquet(f"{self.root}/{folder}")
        found = whole.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows")).collect()
        return [Shard(folder + r["path"].rpartition(folder)[2], r["bytes"], r["rows"]) for r in found]

    def append(self, rows: DataFrame, arrival: str | None = None) -> int:
        """New shards and a version with them. With the name of a column, each of its values is an arrival of its own,
        with its own shards; the column isn't kept."""
        folder = f"data/append-{uuid.uuid4().hex}"
        if not self._fs.exists(self._fs_path(f"{self.root}/_schema.json")):
            self._write(self._fs_path(f"{self.root}/_schema.json"), (rows.drop(arrival) if arrival else rows).schema.json())
        writer = rows.write.option("compression", "snappy")
        (writer.partitionBy(arrival) if arrival else writer).parquet(f"{self.root}/{folder}")
        made = self._written(folder)
        return self._publish(lambda shards: shards + made)

    def _merge(self, groups: list[list[Shard]]) -> list[Shard]:
        made: list[Shard] = []
        for k in range(0, len(groups), FILES_PER_JOB):
            folder = f"data/merge-{uuid.uuid4().hex}"
            parts = [self._read(g).coalesce(1) for g in groups[k : k + FILES_PER_JOB]]
            union = parts[0]
            for p in parts[1:]:
                union = union.union(p)
            union.write.option("compression", "snappy").option("maxRecordsPerFile", 0).parquet(f"{self.root}/{folder}")
            made += self._written(folder)
        return made

    def _read(self, shards: list[Shard]) -> DataFrame:
        # the folders' names are no columns here: an arrival's name was only for the first write
        return self.spark.read.option("recursiveFileLookup", "true").schema(self._schema()).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def _schema(self):
        return StructType.fromJson(json.loads(self._text(f"{self.root}/_schema.json")))

    def compact(self) -> int:
        """Merge until no tier below the full files has FANIN shards to merge; one version for each round. Only shards of
        one tier go into a file together."""
        while True:
            version = (self.versions() or [0])[-1]
            tiers: dict[int, list[Shard]] = {}
            for s in self.shards(version):
                if t := s.tier(self.target, self.fanin):
                    tiers.setdefault(t, []).append(s)
            groups = [g for t in sorted(tiers) if len(tiers[t]) >= self.fanin for g in merge_groups(tiers[t], self.target)]
            if not groups:
                return version
            made = self._merge(groups)
            gone = {s.path for g in groups for s in g}
            if sum(s.rows for s in made) != sum(s.rows for g in groups for s in g):
                raise RuntimeError("a merge has not as many rows as its inputs")

            def merged(shards: list[Shard], gone: set[str] = gone, made: list[Shard] = made) -> list[Shard] | None:
                # if another compaction took some of the inputs, this one's files are left for vacuum
                return [s for s in shards if s.path not in gone] + made if gone <= {s.path for s in shards} else None

            self._publish(merged)

    def vacuum(self, keep: int = 1, orphans_after: float | None = None) -> None:
        """Delete all but the newest `keep` versions and the shards that only they list; with `orphans_after`, files too
        that no kept version lists and that are so many seconds old (of runs that died; younger ones may be being written)."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        live = {s.path for v in kept for s in self.shards(v)}
        for v in old:
            for path in {s.path for s in self.shards(v)} - live:
                self._fs.delete(self._fs_path(f"{self.root}/{path}"), False)
            self._fs.delete(self._fs_path(self.manifest_path(v)), False)
        data = self._fs_path(f"{self.root}/data")
        if orphans_after is None or not self._fs.exists(data):
            return
        files = self._fs.listFiles(data, True)
        while files.hasNext():
            f = files.next()
            path = f.getPath().toUri().getPath()
            name = "data/" + path.rpartition("/data/")[2]
            if name not in live and f.getModificationTime() < 1000 * (time.time() - orphans_after):
                self._fs.delete(f.getPath(), False)

    def located(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default, as two structs, so that no name clashes: `row` with the table's
        columns and `shard` with number, tier, rows and version of its file. Fails if the files don't have the rows of
        the manifest."""
        version = version or self.versions()[-1]
        manifest = self.spark.read.schema("path string, bytes bigint, rows bigint, shard int, tier int, version int").json(self.manifest_path(version))
        # the driver lists the files anyway, so a row for each is no new burden for it
        named = manifest.select(F.col("path").alias("file"), F.struct(F.col("shard").alias("number"), "tier", "rows", "version").alias("shard"))
        shards = self.shards(version)
        if not shards:  # a version without files has the columns all the same
            none = self.spark.createDataFrame([], self._schema())
            return none.select(F.struct("*").alias("row"), F.lit("").alias("file")).join(named, "file").drop("file")
        found = self._read(shards)
        if found.count() != sum(s.rows for s in shards):  # reads the files' footers only
            raise RuntimeError(f"the files of version {version} have not as many rows as its manifest")
        rows = found.select(F.struct("*").alias("row"), F.regexp_extract(F.input_file_name(), SHARD_PATH, 1).alias("file"))
        joined = rows.join(F.broadcast(named) if len(shards) <= 100_000 else named, "file", "left")
        # no row is dropped: one whose file the manifest doesn't name is an error
        unnamed = F.raise_error(F.concat(F.lit("not in the manifest: "), "file")).cast(joined.schema["shard"].dataType)
        return joined.select("row", F.coalesce("shard", unnamed).alias("shard"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default, in the table's columns."""
        return self.located(version).select("row.*")


def shard(docs: DataFrame, root: str, arrivals: int = 8, target_bytes: int = TARGET_BYTES, fanin: int = FANIN) -> ShardedTable:
    """docs appended to a new table below `root` as `arrivals` arrivals, and compacted. Both versions can be read.

    Rows go in as they are: nulls, empty texts, repeated rows and extra columns, whatever their names, are kept. An empty
    table makes a version without shards.
    """
    table = ShardedTable(docs.sparkSession, root, target_bytes, fanin)
    name = "_arrival" + "_" * max((len(c) for c in docs.columns), default=0)  # longer than any column's
    table.append(docs.withColumn(name, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), name)
    table.compact()
    return table
