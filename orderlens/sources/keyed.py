"""Tables that are changed in place, partition by partition, so that what is written follows what changed.

Both kinds here, features by key (S10) and archived weeks (L8), first write the new rows of the partitions concerned to a folder
of the batch's own. Only when that is complete are the table's partitions overwritten from it. So a run that breaks off is repeated from
the start or from that folder, and at no moment are the only copies of rows deleted. One writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .io import TTL_HOURS


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    files, at = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()] if files.exists(at) else []


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has finished."""
    return exists(spark, f"{path}/_SUCCESS")


def replace_parts(rows: DataFrame, path: str, part: str, touched: Sequence) -> None:
    """The table's partitions `touched` become the rows (which are in none but those); a partition without rows is removed. Repeating it changes nothing."""
    spark = rows.sparkSession
    rows.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    there = {r[part] for r in rows.select(part).distinct().collect()}
    for value in touched:
        if value not in there:
            delete(spark, f"{path}/{part}={value}")


class KeyedTable:
    """The latest row of each key, until it expires.

    Keys are dealt to `buckets` folders. A batch rewrites the buckets that its keys fall into and, in turn, `sweep` others, so that
    expired rows leave the files of buckets that nothing comes to. Of rows of a key the one with the latest updated_at holds; at equal times a new
    one comes before an old one. Time is the latest updated_at that any batch has brought. A batch that is repeated changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str], kind: str = "stream", buckets: int = 256, sweep: int = 1) -> None:
        empty = spark.createDataFrame([], schema)
        self.spark, self.path, self.keys, self.buckets, self.sweep = spark, path.rstrip("/"), list(keys), buckets, sweep
        self.columns = [c for c in empty.columns if c != "expires_at"]
        self.life = F.make_interval(hours=F.lit(TTL_HOURS[kind]))
        self.schema = StructType(empty.select(*self.columns, (F.col("updated_at") + self.life).alias("expires_at"), F.lit(0).alias("bucket")).schema.fields)

    @property
    def rows_path(self) -> str:
        return f"{self.path}/rows"

    def _stored(self) -> DataFrame:
        if not exists(self.spark, self.rows_path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.rows_path)

    def read(self, as_of=None) -> DataFrame:
        """The rows that have not expired at as_of (default: the table's time)."""
        as_of = F.lit(as_of) if as_of is not None else F.timestamp_micros(F.lit(self._time()))
        return self._stored().where(F.col("expires_at") > as_of).drop("bucket")

    def _time(self, before: int | None = None) -> int:
        """The latest updated_at of the batches, in microseconds."""
        done = [n for n in self._batches() if (before is None or n < before) and complete(self.spark, f"{self.path}/batches/{n}/info")]
        return self.spark.read.json(f"{self.path}/batches/{max(done)}/info").first()["time_us"] if done else 0

    def _batches(self) -> list[int]:
        return sorted(int(name) for name in folders(self.spark, f"{self.path}/batches"))

    def _prepare(self, new: DataFrame, batch_id: int, work: str) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        fresh = new.select(*self.columns).withColumn("bucket", bucket)
        seen = fresh.groupBy("bucket").agg(F.max(F.unix_micros("updated_at")).alias("us")).collect()
        time_us = max([self._time(batch_id), *(r["us"] for r in seen)])
        swept = {(batch_id * self.sweep + i) % self.buckets for i in range(self.sweep)}
        touched = sorted({r["bucket"] for r in seen} | swept)
        old = self._stored().where(F.col("bucket").isin(touched)).select(*self.columns, "bucket", F.lit(False).alias("_new"))
        rest = [c for c in self.columns if c not in self.keys]
        order = F.struct("updated_at", "_new", F.xxhash64(*rest))
        last = old.unionByName(fresh.withColumn("_new", F.lit(True))).groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
        kept = last.select("bucket", *self.keys, "r.*").withColumn("expires_at", F.col("updated_at") + self.life).where(F.col("expires_at") > F.timestamp_micros(F.lit(time_us)))
        kept.select(*self.schema.names).write.mode("overwrite").parquet(f"{work}/rows")
        info = self.spark.createDataFrame([(time_us, touched)], "time_us long, touched array<int>")
        info.coalesce(1).write.mode("overwrite").json(f"{work}/info")

    def write(self, new: DataFrame, batch_id: int) -> None:
        """For `foreachBatch`."""
        work = f"{self.path}/batches/{batch_id}"
        if not complete(self.spark, f"{work}/info"):
            self._prepare(new, batch_id, work)
        touched = self.spark.read.json(f"{work}/info").first()["touched"]
        replace_parts(self.spark.read.schema(self.schema).parquet(f"{work}/rows"), self.rows_path, "bucket", touched)
        for n in self._batches():
            if n < batch_id - 1:
                delete(self.spark, f"{self.path}/batches/{n}")
