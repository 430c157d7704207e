"""What came apart on larger tables: exact sums, ranges and ranks of many values, counts of pairs."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from orderlens.operators import enrich, monitor, prep, training, windows
from orderlens.plans.registry import QUERIES
from orderlens.sources import io
from orderlens.sources.tables import chargebacks, role
from orderlens.streaming import velocity


def test_sums_of_times_past_bigint(spark, data, tmp_path):
    spark.read.parquet(f"{data}/orders.parquet").where("o_orderkey = 10").write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{data}/lineitem.parquet").limit(1).withColumn("l_orderkey", F.lit(10).cast("long")).crossJoin(spark.range(25_000)).drop("id").write.parquet(f"{tmp_path}/lineitem.parquet")
    (row,) = QUERIES["J13_composite_archive"](spark, str(tmp_path)).collect()
    placed = spark.read.parquet(f"{tmp_path}/orders.parquet").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + 10 * 900_000_000).first()[0]
    assert row["items"] == 25_000 and row["times"] == 25_000 * placed > 1 << 63
    assert dict(QUERIES["J13_composite_archive"](spark, data).dtypes)["times"] == "bigint"


@pytest.fixture
def many(spark):
    """400,000 different values, in an order of their own, of three groups; one is null."""
    return spark.range(0, 400_000, 1, 8).select((F.col("id") * 7919 % 400_000).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.lit(1).alias("n"))


def test_running_sums_over_many_values_are_exact(many):
    got = windows.cumulative(many, "v", ["n"]).agg(F.count(F.lit(1)), F.sum((F.col("upto_n") != F.col("v") + 1).cast("int"))).first()
    assert tuple(got) == (400_000, 0)


def test_percentiles_are_those_of_the_sql_to_the_last_digit(many, tmp_path):
    many.write.parquet(f"{tmp_path}/rows")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p05": 0.05}
    got = windows.percentiles(many, "v", shares, ("k",)).drop("n").collect()
    want = duckdb.sql(f"SELECT k, {', '.join(f'quantile_cont(v, {s})' for s in shares.values())} FROM '{tmp_path}/rows/*.parquet' GROUP BY k").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    small = many.where("v < 3000").withColumn("k", F.col("v") % 40).withColumn("v", F.col("v") * F.col("v") % 9973)
    small.write.parquet(f"{tmp_path}/small")
    got = windows.percentiles(small, "v", shares, ("k",)).drop("n").collect()
    want = duckdb.sql(f"SELECT k, {', '.join(f'quantile_cont(v, {s})' for s in shares.values())} FROM '{tmp_path}/small/*.parquet' GROUP BY k").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_drift_over_many_values(spark):
    rows = spark.range(0, 400_000, 1, 24).select((F.col("id") * 7919 % 400_000).alias("v")).withColumn("k", F.lit("a"))
    rows = rows.withColumn("late", (F.col("v") >= 100_000).cast("int") * (F.col("v") % 2).cast("int"))
    (one,) = monitor.ks(rows, "v", "late", ("k",)).collect()  # 100,001 of the 250,000 early ones come before the first late one
    assert (one["ks"], one["n_a"], one["n_b"]) == (100_001 / 250_000, 250_000, 150_000)
    (none,) = monitor.ks(rows.withColumn("k", F.lit(None).cast("string")).where("v < 2000"), "v", "late", ("k",)).select("n_a").collect()
    assert none["n_a"] == 2_000


def test_sliding_percentiles_of_a_table_are_exact(spark):
    """12,000 different values in a window; a second one has nulls only."""
    rows = spark.range(0, 36_000, 1, 12).select(F.timestamp_seconds(F.floor(F.col("id") / 10)).alias("ts"), (F.col("id") * 7919 % 36_007).alias("v")).unionByName(spark.sql("SELECT timestamp'1970-01-02' AS ts, null AS v"))
    got = {r["start_us"] // 1_000_000: (r["rows"], r["p99"]) for r in velocity.rolling(rows, "ts", "v", "1 hour", "20 minutes").collect()}
    values = [i * 7919 % 36_007 for i in range(36_000)]
    for start in (-2400, -1200, 0, 1200, 2400):
        inside = sorted(values[max(start, 0) * 10 : (start + 3600) * 10])
        assert got.pop(start) == (len(inside), inside[-(-len(inside) * 99 // 100) - 1])
    assert set(got.values()) == {(1, None)} and len(got) == 3


def most_rows(plan):
    """The most rows that an operator of a plan gave."""
    inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, inner)])


def test_stores_near_are_added_up_without_pairs(spark, tmp_path):
    keyed = lambda name: spark.range(2_000).select(F.col("id").alias(f"{name}key"), F.lit(3).alias("c_nationkey"), F.lit("x").alias("c_name"), F.lit(1.0).alias("c_acctbal"), F.lit("x").alias("c_mktsegment"))
    keyed("c_cust").write.parquet(f"{tmp_path}/customer.parquet")
    keyed("s_supp").select("s_suppkey", F.col("c_nationkey").alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    df = QUERIES["J16_X1_stores_near"](spark, str(tmp_path))
    assert {tuple(r)[1:] for r in df.collect()} == {(2_000, sum(range(2_000)))}
    assert most_rows(df._jdf.queryExecution().executedPlan()) <= 20_000  # pairs: 4,000,000


def test_stores_near_totals_are_those_of_the_pairs(spark):
    place = lambda n, name, step: spark.range(n).select(F.col("id").alias(name), F.when(F.col("id") % 11 > 0, F.col("id") % 5).alias("city"), F.when(F.col("id") % 13 > 0, 50 + F.col("id") * step % 97 / 60).alias("lat"), (F.col("id") * step % 89 / 50 - 1).alias("lon"))
    points, stores = place(300, "user_id", 7), place(200, "store_id", 5)
    want = enrich.stores_near(points, stores, "user_id").groupBy("user_id").agg(F.count(F.lit(1)), F.sum("store_id")).collect()
    assert sorted(map(tuple, enrich.stores_near_totals(points, stores, "user_id").collect())) == sorted(map(tuple, want))
    assert len(want) > 250


def test_constant_columns_have_no_score(spark):
    rows = spark.createDataFrame([(0.1,), (0.1 + 1e-16,)], "x double")
    fitted = spark.createDataFrame([("x", 0.1, 1e-17)], "name string, mean double, deviation double"), spark.createDataFrame([], "name string, value string, index int")
    assert [r["x"] for r in prep.apply(rows, prep.Plan(("x",)), *fitted).collect()] == [0.0, 0.0]


def test_cuts_do_not_depend_on_the_order_of_arrival(spark):
    """The cut times of the split, of rows that come in two orders; many enough for an approximation to differ."""
    rows = spark.range(0, 300_000, 1, 6).select((F.col("id") * 7919 % 300_007).alias("placed_us"))
    cuts = [windows.cumulative(r.withColumn("n", F.lit(1)), "placed_us", ["n"]).agg(F.max("upto_n"), F.sum(F.xxhash64("upto_n", "placed_us").cast("decimal(38,0)"))).first() for r in (rows, rows.repartition(5, "placed_us"))]
    assert cuts[0] == cuts[1] and cuts[0][0] == 300_000
    assert prep.time_split(rows.repartition(7)).groupBy("split").count().orderBy("split").collect()[1]["count"] == 240_000


def test_history_keeps_no_events(spark, data):
    """Of what is staged only the features stay; events go when a family is summed up."""
    folder = Path(io.shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    with io.scratch(spark):
        found = training.history(role(spark, data, "orders"), chargebacks(spark, data))
        assert sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before) == ["history"] * len(training.FAMILIES)
        assert found.count() == role(spark, data, "orders").count()
    assert set(folder.iterdir()) == before
