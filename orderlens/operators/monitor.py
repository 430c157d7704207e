"""Monitoring tables: live metrics, drift, review queue, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import cumulative, percentiles

DAY = 86_400_000_000


def live_metrics(decisions: DataFrame, truth: DataFrame, when: str = "decided_us", span: int = DAY) -> DataFrame:
    """By period: decisions, precision of DECLINE and REVIEW, recall; orders with truth only."""
    rows = decisions.join(truth.select("order_id", "is_fraud"), "order_id").withColumn("period", F.floor(F.col(when) / span))
    bad, is_ = F.col("is_fraud"), lambda d: F.col("decision") == d
    part = lambda num, den: F.when(F.count(F.when(den, 1)) > 0, F.round(F.count(F.when(num & den, 1)) / F.count(F.when(den, 1)), 6))
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("orders"), part(bad, is_("DECLINE")).alias("decline_precision"), part(bad, is_("REVIEW")).alias("review_precision"), part(is_("DECLINE"), bad).alias("recall"))


def category_trend(decisions: DataFrame, truth: DataFrame, when: str = "decided_us", span: int = DAY) -> DataFrame:
    """O1: by period and fraud category: frauds, and the shares declined and reviewed."""
    rows = decisions.join(truth.where("is_fraud").select("order_id", "category"), "order_id").withColumn("period", F.floor(F.col(when) / span))
    share = lambda d: F.round(F.avg((F.col("decision") == d).cast("double")), 6)
    return rows.groupBy("period", "category").agg(F.count(F.lit(1)).alias("frauds"), share("DECLINE").alias("declined"), share("REVIEW").alias("reviewed"))


def score_histograms(decisions: DataFrame, as_of: int, when: str = "decided_us", bins: int = 20, span: int = DAY, back: int = 7 * DAY) -> DataFrame:
    """O2: bins of the scores of the span before as_of, beside those of the same span `back` earlier."""
    t = F.col(when)
    now, then = (t >= as_of - span) & (t < as_of), (t >= as_of - back - span) & (t < as_of - back)
    rows = decisions.where(now | then).withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int"))
    return rows.groupBy("bin").agg(F.count(F.when(now, 1)).alias("current"), F.count(F.when(then, 1)).alias("reference"))


def sizes(orders: DataFrame, decisions: DataFrame, as_of: int) -> DataFrame:
    """Rows of the hot and cold side, and the depth of the review queue and age of its oldest order in hours."""
    from .labels import is_archivable

    cold = F.coalesce(is_archivable(as_of), F.lit(False))
    one = orders.agg(F.count(F.when(~cold, 1)).alias("hot"), F.count(F.when(cold, 1)).alias("cold"))
    queue = decisions.where("decision = 'REVIEW'").agg(F.count(F.lit(1)).alias("queued"), F.floor((F.lit(as_of) - F.min("decided_us")) / 3_600_000_000).alias("oldest_hours"))
    return one.join(F.broadcast(queue))


def ks(rows: DataFrame, value: str, group: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of groups 0 and 1, with the asymptotic p-value and a status.

    Values are aggregated first; the running shares are over distinct values of each feature.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.when(F.col(group) == 0, 1)).alias("a"), F.count(F.when(F.col(group) == 1, 1)).alias("b"))
    running = cumulative(counts, value, ["a", "b"], by)
    gaps = running.withColumn("gap", F.abs(F.col("upto_a") / F.col("whole_a") - F.col("upto_b") / F.col("whole_b")))
    out = gaps.groupBy(*by).agg(F.max("gap").alias("ks"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    en = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    t = (en + 0.12 + 0.11 / en) * F.col("ks")
    term = lambda k: F.exp(-2.0 * k * k * t * t) * (1 if k % 2 else -1)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * sum((term(k) for k in range(1, 21)), F.lit(0.0))))
    out = out.withColumn("p_value", F.when(t < 0.2, 1.0).otherwise(p))
    return out.withColumn("status", F.when(F.col("p_value") < 0.001, "ALERT").when(F.col("p_value") < 0.01, "WARNING").otherwise("OK"))


def features_long(rows: DataFrame, snapshot: str, group: str) -> DataFrame:
    """(feature, value, group) from the JSON snapshots."""
    return rows.select(group, F.explode(F.from_json(snapshot, "map<string,double>")).alias("feature", "value"))


def top_drift(drift: DataFrame, n: int = 5) -> DataFrame:
    """T9."""
    return drift.orderBy(F.desc("ks"), "feature").limit(n)


def reference_sample(rows: DataFrame, key: str, n: int = 100_000, when: str | None = None, as_of: int = 0, span: int = 7 * DAY) -> DataFrame:
    """The rows of smallest hashed key, the same sample each time; when: only those of the span before as_of."""
    recent = rows if when is None else rows.where((F.col(when) >= as_of - span) & (F.col(when) < as_of))
    return recent.orderBy(F.xxhash64(key), key).limit(n)


def review_queue(decisions: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    """The highest scores under review, with masked emails."""
    from ..functions.columns import mask_email

    return decisions.where("decision = 'REVIEW'").join(users, "user_id").withColumn("email", mask_email(F.col("email"))).orderBy(F.desc("score"), "order_id").limit(n)


def resolve_reviews(decisions: DataFrame, truth: DataFrame, as_of: int, when: str = "decided_us", n: int | None = 1000) -> DataFrame:
    """Reviews older than a day get their verdict from truth, oldest first; n is the throttle of one pass."""
    due = decisions.where((F.col("decision") == "REVIEW") & (F.col(when) < as_of - DAY)).orderBy(when, "order_id")
    due = due if n is None else due.limit(n)
    return due.join(truth.select("order_id", "is_fraud"), "order_id", "left").withColumn("resolution", F.when(F.col("is_fraud"), "FRAUD").otherwise("LEGIT"))


def latency(rows: DataFrame, value: str, when: str, span: int) -> DataFrame:
    """Exact percentiles by period."""
    periods = rows.withColumn("period", F.floor(F.col(when) / span))
    return percentiles(periods, value, {f"p{int(p * 100)}": p for p in (0.5, 0.95, 0.99)}, ("period",)).drop("n")


# Expected orders a minute by local hour, and what each weekday (Monday first) multiplies them by.
HOURLY = (18, 10, 6, 4, 3, 5, 8, 18, 32, 28, 24, 42, 62, 55, 38, 32, 40, 62, 88, 105, 90, 64, 42, 28)
WEEKDAYS = (0.90, 0.95, 1.00, 1.05, 1.25, 1.30, 1.15)


def expected_demand(spark) -> DataFrame:
    """(hour, weekday, expected): the share of a week's orders that each hour should have; weekday 0 is Sunday."""
    total = sum(HOURLY) * sum(WEEKDAYS)
    rows = [(h, (w + 1) % 7, rate * WEEKDAYS[w] / total) for h, rate in enumerate(HOURLY) for w in range(7)]
    return spark.createDataFrame(rows, "hour int, weekday int, expected double")


def demand_against(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed shares by hour and weekday beside the expected ones; hours without orders count 0. Both sides are the 168 hours of a week."""
    every = F.broadcast(expected).join(counts, ["hour", "weekday"], "left").fillna(0, ["orders"])
    share = F.col("orders") / F.sum("orders").over(Window.partitionBy())
    return every.withColumn("observed", share).withColumn("difference", F.col("observed") - F.col("expected"))
