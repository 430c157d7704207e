"""Sinks and typed readers: partitioned parquet, keyed upsert with expiry, documents, logs, CSV; checkpoints."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Hours that feature rows live: from the stream, and from batch jobs.
TTL_HOURS = {"stream": 24, "batch": 48}


_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A temporary one on a local master that has none; an error on a cluster."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "folder" not in _made:
        atexit.register(shutil.rmtree, made := tempfile.mkdtemp(prefix="orderlens-"), ignore_errors=True)
        _made["folder"] = f"file://{made}"
    return _made["folder"]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


#: Folders to delete, of each `scratch` that is open.
_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, computed once and kept in the shared folder as compressed columns, which take a fraction of a checkpoint's rows; what was shuffled for it
    is deleted at once. Within `scratch` it goes when that ends; keep: when the one around that ends, if there is one."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    if open_ := _scratch.get()[: -1 if keep else None]:
        open_[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is `staged` within is deleted at its end: by then what reads it must have been written."""
    paths: list[str] = []
    token = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed load, no inference; malformed rows fail."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def with_week(df: DataFrame, when: str = "placed_at") -> DataFrame:
    """The Monday of the ISO week, the partition column of order tables."""
    return df.withColumn("placed_week", F.date_trunc("week", F.col(when)).cast("date"))


def write_weekly(df: DataFrame, path: str, when: str = "placed_at", mode: str = "append") -> None:
    """One folder a week; rows of a week meet in few files."""
    with_week(df, when).repartition("placed_week").write.mode(mode).partitionBy("placed_week").parquet(path)


def read_weeks(spark: SparkSession, path: str, start, end, when: str = "placed_at") -> DataFrame:
    """Half-open time window; the week predicate prunes folders, the time predicate rows."""
    week = F.date_trunc("week", F.lit(start)).cast("date")
    return spark.read.parquet(path).where((F.col("placed_week") >= week) & (F.col("placed_week") <= F.lit(end).cast("date")) & (F.col(when) >= F.lit(start)) & (F.col(when) < F.lit(end)))


def write_run(df: DataFrame, path: str, run_id: str) -> str:
    """A training set under its run id; an existing run fails."""
    out = f"{path}/run_id={run_id}"
    df.write.mode("error").parquet(out)
    return out


def write_splits(df: DataFrame, path: str) -> None:
    """Train, val and test in folders of their own."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_document(df: DataFrame, path: str) -> None:
    """A findings or metrics document; these are report-sized."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only JSON lines."""
    df.coalesce(1).write.mode("append").json(path)


def upsert(current: DataFrame, new: DataFrame, keys: Sequence[str], kind: str = "stream") -> DataFrame:
    """Latest row of each key, with the moment it expires (`alive` leaves expired ones out). Needs updated_at; at equal times a new row comes before
    a current one. As a table that streams write to: `keyed.KeyedTable`."""
    life = F.make_interval(hours=F.lit(TTL_HOURS[kind]))
    rows = current.drop("expires_at").withColumn("_new", F.lit(False)).unionByName(new.drop("expires_at").withColumn("_new", F.lit(True)))
    rest = [c for c in rows.columns if c not in (*keys, "_new")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "_new")).alias("r")).select(*keys, "r.*")
    return last.withColumn("expires_at", F.col("updated_at") + life)


def alive(features: DataFrame, as_of) -> DataFrame:
    return features.where(F.col("expires_at") > F.lit(as_of))
