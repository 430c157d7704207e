"""Archive passes that move rows by week, with a ledger.

Hot tables have a folder a week of their order's placement. A pass takes the oldest archivable orders, up to `batch`, writes what
leaves and what stays of the weeks concerned to a folder of its own, adds the former to the cold tables and replaces the hot weeks by the latter; then
it goes into the ledger. Other weeks are neither read beyond finding candidates nor written. A pass that the ledger
holds is a no-op; one that was interrupted is done again from its folder, or from the start if that isn't complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.io import with_week
from ..sources.keyed import complete, delete, exists, folders, replace_parts
from .labels import is_archivable
from .windows import cumulative

LEDGER = "pass long, table string, moved long, as_of_us long"


def oldest(candidates: DataFrame, batch: int) -> DataFrame:
    """The `batch` first rows by (terminal_us, order_id), without sorting them all in one task: whole times below the cut, and of the cut's own time the first."""
    times = cumulative(candidates.groupBy("terminal_us").agg(F.count(F.lit(1)).alias("n")), "terminal_us", ["n"])
    cut = times.where(F.col("upto_n") >= batch).agg(F.min(F.struct("terminal_us", "upto_n", "n")).alias("c")).first()["c"]
    if cut is None:
        return candidates
    tied = candidates.where(F.col("terminal_us") == cut["terminal_us"]).orderBy("order_id").limit(batch - (cut["upto_n"] - cut["n"]))
    return candidates.where(F.col("terminal_us") < cut["terminal_us"]).unionByName(tied)


class Archive:
    """Hot and cold tables of orders and their children under one folder: hot/<table>/placed_week=, cold/<table>/placed_week=/pass=, and the ledger.

    Children carry order_id and placed_us of their order, as in the reference's composite keys.
    """

    def __init__(self, spark: SparkSession, path: str, children: tuple[str, ...] = ("items", "events")) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), ("orders", *children)

    def load(self, tables: dict[str, DataFrame]) -> None:
        """Writes the hot tables for the first time."""
        for name in self.tables:
            rows = self._week(tables[name])
            rows.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema/{name}")
            rows.repartition("placed_week").write.mode("error").partitionBy("placed_week").parquet(f"{self.path}/hot/{name}")

    @staticmethod
    def _week(rows: DataFrame) -> DataFrame:
        return with_week(rows.withColumn("_at", F.timestamp_micros("placed_us")), "_at").drop("_at")

    def hot(self, name: str, weeks: list[str] | None = None) -> DataFrame:
        """Rows that are not archived; weeks: of these only, without a look at other folders."""
        table = f"{self.path}/hot/{name}"
        parts = [table] if weeks is None else [f"{table}/{x}" for x in sorted({f"placed_week={w}" for w in weeks} & set(folders(self.spark, table)))]
        schema = self._schema(name)
        return self.spark.read.schema(schema).option("basePath", table).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def cold(self, name: str) -> DataFrame:
        """Archived rows and the pass that moved them; before the first pass an empty table."""
        schema = self._schema(name).add("pass", "long")
        if not exists(self.spark, f"{self.path}/cold/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/cold/{name}")

    def _schema(self, name: str) -> StructType:
        return self.spark.read.parquet(f"{self.path}/schema/{name}").schema

    def ledger(self) -> DataFrame:
        """(pass, table, moved, as_of_us)."""
        if not exists(self.spark, f"{self.path}/ledger"):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")

    def _prepare(self, number: int, as_of: int, batch: int, work: str) -> None:
        chosen = oldest(self.hot("orders").where(is_archivable(as_of)), batch).select("order_id", "placed_us", "placed_week")
        chosen.write.mode("overwrite").parquet(f"{work}/chosen")
        chosen = self.spark.read.parquet(f"{work}/chosen")
        weeks = sorted(str(r[0]) for r in chosen.select("placed_week").distinct().collect())
        marks, keys = chosen.select("order_id", "placed_us"), ["order_id", "placed_us"]
        for name in self.tables:
            rows = self.hot(name, weeks)
            rows.join(marks, keys, "left_semi").withColumn("pass", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{work}/leaving/{name}")
            rows.join(marks, keys, "left_anti").write.mode("overwrite").parquet(f"{work}/staying/{name}")
            moved, stay = (self.spark.read.parquet(f"{work}/{side}/{name}").count() for side in ("leaving", "staying"))
            if moved + stay != rows.count():
                raise RuntimeError(f"{name}: rows were lost or doubled")
        info = self.spark.createDataFrame([(number, as_of, weeks)], "pass long, as_of_us long, weeks array<string>")
        info.coalesce(1).write.mode("overwrite").json(f"{work}/info")

    def run_pass(self, number: int, as_of: int, batch: int = 10_000) -> int:
        """Moves up to `batch` orders and what hangs on them; returns how many orders (0 if the ledger has this pass already, or none is left)."""
        if complete(self.spark, f"{self.path}/ledger/number={number}"):
            return 0
        work = f"{self.path}/passes/{number}"
        if not complete(self.spark, f"{work}/info"):
            self._prepare(number, as_of, batch, work)
        info = self.spark.read.schema("pass long, as_of_us long, weeks array<string>").json(f"{work}/info").first()
        if not info["weeks"]:
            delete(self.spark, work)
            return 0
        moved = []
        for name in self.tables:
            leaving = self.spark.read.parquet(f"{work}/leaving/{name}")
            leaving.repartition("placed_week").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("placed_week", "pass").parquet(f"{self.path}/cold/{name}")
            replace_parts(self.spark.read.parquet(f"{work}/staying/{name}").withColumn("placed_week", F.col("placed_week").cast("string")), f"{self.path}/hot/{name}", "placed_week", info["weeks"])
            moved.append((number, name, leaving.count(), info["as_of_us"]))
        self.spark.createDataFrame(moved, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/number={number}")
        delete(self.spark, work)
        return moved[0][2]

    def run(self, as_of: int, batch: int = 10_000, passes: int = 500) -> int:
        """Passes until one moves nothing or there were enough; goes on after the last one, an interrupted one first. Orders moved in all."""
        done = sorted(int(x.partition("=")[2]) for x in folders(self.spark, f"{self.path}/ledger"))
        begun = sorted(int(x) for x in folders(self.spark, f"{self.path}/passes"))
        number, total = min([*begun, (done[-1] if done else 0) + 1]), 0
        for n in range(number, number + passes):
            moved = self.run_pass(n, as_of, batch)
            total += moved
            if not moved and n not in begun:
                break
        return total
