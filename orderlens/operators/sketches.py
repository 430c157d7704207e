"""Quantiles over time from counts that can be added up; exact ones of tables (`counted`, `sliding_exact`).

Values are counted in buckets whose bounds grow by a constant factor, by pane of time. Counts of panes add up to those of any
window or reference week, so a value is looked at once, however many windows it is in, and a quantile of any of them is within
`error` of the exact one, relative to its size, at every number of rows. The number of rows is exact. A pane holds as many rows as
its values span buckets: about 1,150 for a factor of 10**10 at an error of 1 %.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import cumulative

ERROR = 0.01
#: Added to the numbers of the buckets of positive values (and taken from those of negative ones), so that they rise with the values: 0 is that of zero.
MIDDLE = 1 << 20


def _growth(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    """The number of a value's bucket; nulls and NaN have none, infinities neither."""
    at = F.ceil(F.log(F.abs(value)) / F.lit(math.log(_growth(error)))).cast("long") + MIDDLE
    known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(known, F.when(value == 0, F.lit(0).cast("long")).otherwise(F.when(value > 0, at).otherwise(-at)))


def middle(number: Column, error: float = ERROR) -> Column:
    """The value that stands for a bucket: no value in it is farther off than `error`, relative to its own size."""
    growth = _growth(error)
    size = F.pow(F.lit(growth), F.abs(number) - MIDDLE) * F.lit(2 / (growth + 1))
    return F.when(number == 0, 0.0).otherwise(F.signum(number.cast("double")) * size)


def panes(rows: DataFrame, when_us: Column | str, value: str, pane_us: int, by: tuple[str, ...] = (), error: float = ERROR) -> DataFrame:
    """(by, pane_us, bucket, n): counts of each pane's buckets, of a table or of a stream (pane_us: where the pane starts). Rows without a time or value count for nothing."""
    at = F.col(when_us) if isinstance(when_us, str) else when_us
    cut = rows.select(*by, (F.floor(at / F.lit(pane_us)) * F.lit(pane_us)).cast("long").alias("pane_us"), bucket(F.col(value).cast("double"), error).alias("bucket"))
    return cut.where("pane_us is not null and bucket is not null").groupBy(*by, "pane_us", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bucket, n): what counts of any panes add up to."""
    return parts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def sliding(parts: DataFrame, size_us: int, step_us: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, start_us, bucket, n): counts of the windows [start, start + size) that the panes lie in; windows start at multiples of the step, and
    panes must divide both."""
    first = F.floor((F.col("pane_us") - F.lit(size_us)) / F.lit(step_us)) * F.lit(step_us) + F.lit(step_us)
    starts = F.sequence(first.cast("long"), (F.floor(F.col("pane_us") / F.lit(step_us)) * F.lit(step_us)).cast("long"), F.lit(step_us).cast("long"))
    return merged(parts.withColumn("start_us", F.explode(starts)), (*by, "start_us"))


def quantiles(counts: DataFrame, shares: dict[str, float], by: tuple[str, ...] = (), error: float = ERROR) -> DataFrame:
    """(by, n, shares' names): the number of rows, exact, and quantiles within `error` of the value of rank ceil(share * n)."""
    ranked = cumulative(counts, "bucket", ["n"], by)
    at = lambda share: F.min(F.when(F.col("upto_n") >= F.ceil(F.lit(share) * F.col("whole_n")), F.col("bucket")))
    one = ranked.groupBy(*by).agg(F.max("whole_n").alias("n"), *[at(s).alias(name) for name, s in shares.items()])
    return one.select(*by, "n", *[middle(F.col(name), error).alias(name) for name in shares])


def counted(rows: DataFrame, when_us: Column, value: str, pane_us: int) -> DataFrame:
    """(pane_us, bucket, value, n): counts of each pane's values, with their buckets; NaN and infinities have buckets at the ends here, null has none."""
    size, end = F.col(value).cast("double"), F.lit(1 << 40)
    at = F.coalesce(bucket(size), F.when(size < 0, -end).when(size.isNotNull(), end))
    cut = rows.select((F.floor(when_us / F.lit(pane_us)) * F.lit(pane_us)).cast("long").alias("pane_us"), F.col(value).alias("value"), at.alias("bucket")).where("pane_us is not null")
    return cut.groupBy("pane_us", "bucket", "value").agg(F.count(F.lit(1)).alias("n"))


def sliding_exact(parts: DataFrame, pane_us: int, size_us: int, step_us: int, share: float) -> DataFrame:
    """(start_us, rows, value): of `counted` panes, the number of rows of each window, and the value of rank ceil(share * n) of those that aren't null.

    Counts of buckets say in which bucket that value is, so the values of this one alone are ranked.
    """
    whole = sliding(merged(parts, ("pane_us",)), size_us, step_us)
    ordered = Window.partitionBy("start_us").orderBy("bucket")  # as many rows as there are buckets, whatever the data
    known = whole.where("bucket is not null").withColumn("upto", F.sum("n").over(ordered)).withColumn("all", F.sum("n").over(Window.partitionBy("start_us")))
    rank = F.greatest(F.ceil(F.lit(Decimal(str(share))) * F.col("all")), F.lit(1)).cast("long")
    found = known.withColumn("rank", rank - (F.col("upto") - F.col("n"))).where((F.col("rank") > 0) & (F.col("rank") <= F.col("n"))).select("start_us", "bucket", "rank")
    panes = F.sequence(F.col("start_us"), F.col("start_us") + F.lit(size_us - pane_us), F.lit(pane_us))
    inside = found.withColumn("pane_us", F.explode(panes)).join(parts, ["pane_us", "bucket"]).groupBy("start_us", "rank", "value").agg(F.sum("n").alias("n"))
    one = cumulative(inside, "value", ["n"], ("start_us", "rank")).where(F.col("upto_n") >= F.col("rank")).groupBy("start_us").agg(F.min("value").alias("value"))
    return whole.groupBy("start_us").agg(F.sum("n").alias("rows")).join(one, "start_us", "left")


def distance(current: DataFrame, reference: DataFrame) -> DataFrame:
    """O3: (ks, n, n_reference): the largest difference of the two distributions at a bucket's end, from `merged` counts of either; an empty side: null."""
    both = current.select("bucket", F.col("n").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(reference.select("bucket", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    ranked = cumulative(both.groupBy("bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "bucket", ["a", "b"])
    gap = F.when((F.col("whole_a") > 0) & (F.col("whole_b") > 0), F.abs(F.col("upto_a") / F.col("whole_a") - F.col("upto_b") / F.col("whole_b")))
    return ranked.agg(F.max(gap).alias("ks"), F.coalesce(F.max("whole_a"), F.lit(0)).alias("n"), F.coalesce(F.max("whole_b"), F.lit(0)).alias("n_reference"))
