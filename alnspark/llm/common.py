"""Shared helpers of the training-data operators: input hygiene, scratch tables, bounded Python batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The definition of a word shared by all operators: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
_local_dir: str | None = None
_tables: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset a temporary folder, which only a local session
    may use: executors elsewhere would write to their own disks."""
    global _local_dir
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    _local_dir = _local_dir or tempfile.mkdtemp(prefix="alnspark-")
    return _local_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later jobs neither recompute it nor depend on the
    executors that made it. The folder is removed when the driver ends."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _tables:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the shared folder's own expiry then applies
            break
    _tables.clear()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get at most this many rows at a time, so a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def sliced(batches: Iterator, rows: int) -> Iterator:
    """The batches of a worker in parts of at most `rows` rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


#: Rows of (id, two integers) that may be sent to every executor: under 64 MB there.
BROADCAST_ROWS = 1_000_000


def keep_by_id(docs: DataFrame, rows: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """docs joined with the few `rows`. While these are counted and small they are broadcast, so that texts stay
    where they are; beyond that both sides are shuffled on the key."""
    small = rows.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(rows) if small else rows, key, how)


#: A key is hot with more rows than this and with more than a HOT_KEYS-th of them all: there are HOT_KEYS such keys at most.
HOT_ROWS, HOT_KEYS = 1_000, 10_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """key, salts for each hot key of a table: HOT_KEYS rows at most. None without any."""
    total = rows.count()
    most = max(HOT_ROWS, total // HOT_KEYS)
    if total <= most:
        return None
    return hot_counts(rows.where(F.col(key).isNotNull()).groupBy(key).count(), key, most)


def hot_counts(counts: DataFrame, key: str, most: int) -> DataFrame | None:
    """The same from key, count: those with more than `most` rows."""
    hot = materialize(counts.where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("salts")), "hot")
    return hot if hot.limit(1).count() else None


def join_salted(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined on `key` with `one`, which has one row for each key at most. The rows of a hot key are dealt over
    several tasks, each of which gets the key's row of `one`; rows with a null key are dealt as any other."""
    nulls = rows.where(F.col(key).isNull()) if how == "left" else None
    rows = rows.where(F.col(key).isNotNull())
    if hot is None:
        found = rows.join(one, key, how)
    else:
        salts = F.coalesce("salts", F.lit(1))
        dealt = rows.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), salts)).drop("salts")
        copies = one.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("salts")
        found = dealt.withColumn("salt", F.col("salt").cast("bigint")).join(copies, [key, "salt"], how).drop("salt")
    return found.unionByName(nulls, allowMissingColumns=True) if nulls is not None else found


def clean(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names do no harm."""
    return docs.select(*[F.col(c) for c in columns])
