"""Training-data scan: findings as rows (column, severity, check_name, metric, expected, actual, recommendation)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from ..sources.io import checkpointed
from .windows import percentiles

MIN_LEAK_ROWS = 10
ADVICE = {
    "missing_column": "Restore the column in the export.", "profile": "Compare the generator with the expected range.", "label_rate": "Check label maturity and sampling.",
    "narrow_numeric": "Check whether the column carries information.", "constant": "Drop the column or restore its variation.", "leak": "Remove the value or the column from the features.",
}


def _finding(column: Column, severity: str, check: str, metric: Column, expected: Column, actual: Column) -> list[Column]:
    return [column.alias("column"), F.lit(severity).alias("severity"), F.lit(check).alias("check_name"), metric.alias("metric"), expected.alias("expected"), actual.alias("actual"), F.lit(ADVICE[check]).alias("recommendation")]


def distinct_with_null(c: str) -> Column:
    """Null counts as a value."""
    return F.count_distinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))


def value_counts(rows: DataFrame, label: str | None = None) -> DataFrame:
    """A row per column and value (as text; null is a value): its number, and the least and greatest label it meets. What all checks read."""
    flat = [f for f in rows.schema.fields if isinstance(f.dataType, (NumericType, BooleanType, StringType))]
    pairs = F.array(*[F.struct(F.lit(f.name).alias("name"), F.col(f.name).cast("string").alias("value")) for f in flat])
    y = F.col(label).cast("int") if label else F.lit(None).cast("int")
    return rows.select(y.alias("y"), F.inline(pairs)).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("least"), F.max("y").alias("most"))


def profile(rows: DataFrame, expected: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(column, metric, low, high) against exact percentiles; an empty column is outside. One scan for all."""
    spec = expected.collect()  # a small configuration table
    have = [r for r in spec if r["column"] in rows.columns]
    spark = rows.sparkSession
    out = spark.createDataFrame([(r["column"],) for r in spec if r["column"] not in rows.columns], "column string").distinct().select(*_finding(F.col("column"), "critical", "missing_column", F.lit("present"), F.lit("true"), F.lit("false")))
    if have:
        counts = value_counts(rows.select(*{r["column"] for r in have})) if counts is None else counts
        numbers = counts.where(F.col("name").isin(*{r["column"] for r in have})).select("name", F.col("value").try_cast("double").alias("v"), "n")
        shares = {r["metric"]: int(r["metric"][1:]) / 100 for r in have}
        found = percentiles(numbers, "v", shares, ("name",), F.col("n"))
        got = found.select("name", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in shares])))
        limits = spark.createDataFrame([(r["column"], r["metric"], float(r["low"]), float(r["high"])) for r in have], "name string, metric string, low double, high double")
        bad = limits.join(got, ["name", "metric"], "left").where(F.col("value").isNull() | (F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
        out = out.unionByName(bad.select(*_finding(F.col("name"), "critical", "profile", F.col("metric"), F.to_json(F.array("low", "high")), F.to_json(F.struct(F.round("value", 6).alias("value"))))))
    return out


def label_rate(rows: DataFrame, label: str, low: float, high: float) -> DataFrame:
    """Q2."""
    got = rows.agg(F.avg(F.col(label).cast("double")).alias("v")).where(F.col("v").isNull() | ~F.col("v").between(low, high))
    return got.select(*_finding(F.lit(label), "critical", "label_rate", F.lit("mean"), F.lit(f"[{low},{high}]"), F.to_json(F.struct(F.round("v", 6).alias("value")))))


def _kinds(rows: DataFrame, label: str, *types: type) -> list[str]:
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, types) and f.name != label]


def narrow_and_constant(rows: DataFrame, label: str, counts: DataFrame | None = None) -> DataFrame:
    """Q3, Q4: numbers with two to four values that aren't 0/1 indicators; columns with one value."""
    counts = value_counts(rows) if counts is None else counts
    number = F.col("value").cast("string")
    as_number = F.when(number == "true", 1.0).when(number == "false", 0.0).otherwise(number.try_cast("double"))
    got = counts.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.min(as_number).alias("least"), F.max(as_number).alias("most"), F.count("value").alias("known"),
    )
    numbers, flat = _kinds(rows, label, NumericType, BooleanType), _kinds(rows, label, NumericType, BooleanType, StringType)
    indicator = F.coalesce(F.col("least").isin(0.0, 1.0) & F.col("most").isin(0.0, 1.0), F.lit(False)) & (F.col("known") <= 2)
    narrow = got.where(F.col("name").isin(numbers) & (F.col("n") > 1) & (F.col("n") < 5) & ~indicator)
    narrow = narrow.select(*_finding(F.col("name"), "suggestive", "narrow_numeric", F.lit("distinct"), F.lit(">=5"), F.col("n").cast("string")))
    constant = got.where(F.col("name").isin(flat) & (F.col("n") == 1)).select(*_finding(F.col("name"), "fyi", "constant", F.lit("distinct"), F.lit(">1"), F.coalesce("low", F.lit("__NULL__"))))
    return narrow.unionByName(constant)


def leaks(rows: DataFrame, label: str, least: int = MIN_LEAK_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Text values of enough rows that only ever meet label 1; null is the value __NULL__."""
    counts = value_counts(rows, label) if counts is None else counts
    got = counts.where(F.col("name").isin(_kinds(rows, label, StringType)) & (F.col("n") >= least) & (F.col("least") == 1) & (F.col("most") == 1))
    value = F.coalesce("value", F.lit("__NULL__"))
    return got.select(*_finding(F.col("name"), "critical", "leak", F.concat(F.lit("value="), value), F.lit("both labels"), F.concat(F.lit("label 1 only in "), F.col("n").cast("string"), F.lit(" rows"))))


def scan(rows: DataFrame, label: str, expected: DataFrame, low: float, high: float) -> DataFrame:
    """All findings in order. The data is read twice: for the counts of values, which are checkpointed, and for the label's mean."""
    counts = checkpointed(value_counts(rows, label))
    parts = [profile(rows, expected, counts), label_rate(rows, label, low, high), narrow_and_constant(rows, label, counts), leaks(rows, label, counts=counts)]
    return reduce(DataFrame.unionByName, parts).orderBy("column", "severity", "check_name", "metric", "actual")


def domain_violations(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """values outside an enumeration, with their counts; null passes, as in a CHECK."""
    return rows.where(~F.col(column).isin(*values)).groupBy(column).count()
