"""Model evaluation as tables: everything comes from counts by score, never from sorted rows on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import cumulative

# The thresholds of confusion tables, and the weight pairs that are tried.
THRESHOLDS = (0.3, 0.5, 0.7, 0.85)
GRID = ((0.3, 0.7), (0.4, 0.6), (0.5, 0.5), (0.6, 0.4), (0.7, 0.3))


def ranking(rows: DataFrame, score: str = "score", label: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """A row per distinct score, highest first, with cumulative counts and the points of both curves."""
    counts = rows.groupBy(*by, score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    out = cumulative(counts, score, ["p", "n"], by, descending=True).withColumnsRenamed({"upto_p": "tp", "upto_n": "fp", "whole_p": "pos", "whole_n": "neg"})
    return out.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tp") / F.col("pos")).withColumn("fpr", F.col("fp") / F.col("neg"))


def average_precision() -> Column:
    """Over rows of `ranking`."""
    return F.sum(F.col("p") / F.col("pos") * F.col("precision"))


def auroc() -> Column:
    """Ties count half."""
    return F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2)) / F.max(F.col("pos") * F.col("neg"))


def summary(rows: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """E1-E4 in one row; a single class is an error."""
    curve = ranking(rows, score, label)
    one = curve.agg(
        average_precision().alias("auprc"), auroc().alias("auroc"),
        F.coalesce(F.max(F.when(F.col("recall") >= 0.95, F.col("precision"))), F.lit(0.0)).alias("precision_at_recall_95"),
        F.coalesce(F.max(F.when(F.col("precision") >= 0.99, F.col("recall"))), F.lit(0.0)).alias("recall_at_precision_99"),
        (F.sum(F.col("p") * F.pow(F.col(score) - 1, 2) + F.col("n") * F.pow(F.col(score), 2)) / F.sum(F.col("p") + F.col("n"))).alias("brier"),
        F.max("pos").alias("pos"), F.max("neg").alias("neg"),
    )
    ok = (F.col("pos") > 0) & (F.col("neg") > 0)
    return one.withColumn("auroc", F.when(ok, F.col("auroc")).otherwise(F.raise_error(F.lit("one class only")).cast("double"))).drop("pos", "neg")


def confusion(rows: DataFrame, score: str = "score", label: str = "y", thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """E5."""
    hit = F.col(score) >= F.col("threshold")
    cell = lambda cond: F.count(F.when(cond, 1))
    y = F.col(label) == 1
    return rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).groupBy("threshold").agg(cell(~y & ~hit).alias("tn"), cell(~y & hit).alias("fp"), cell(y & ~hit).alias("fn"), cell(y & hit).alias("tp"))


def category_recall(rows: DataFrame, score: str = "score", label: str = "y", at: float = 0.5) -> DataFrame:
    """Of the positives of each category; categories without any are left out."""
    return rows.where(F.col(label) == 1).groupBy("category").agg(F.avg((F.col(score) >= at).cast("double")).alias("recall"))


def histogram(rows: DataFrame, score: str = "score", by: tuple[str, ...] = ("y",), bins: int = 20) -> DataFrame:
    """Equal bins on [0, 1], the last one closed."""
    return rows.withColumn("bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")).groupBy(*by, "bin").count()


def calibration(rows: DataFrame, score: str = "score", label: str = "y", bins: int = 10) -> DataFrame:
    """Mean score and label by bin; empty bins don't occur."""
    binned = rows.withColumn("bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int"))
    return binned.groupBy("bin").agg(F.avg(score).alias("mean_score"), F.avg(label).alias("mean_label"), F.count(F.lit(1)).alias("rows"))


def ensemble(a: DataFrame, b: DataFrame, key: str, weights: tuple[float, float]) -> DataFrame:
    """Weighted score; rows without a partner are an error, and weights must sum to 1."""
    if abs(sum(weights) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    x, y = a.withColumnRenamed("score", "score_a"), b.select(key, F.col("score").alias("score_b"))
    both = x.join(y, key, "full")
    whole = F.col("score_a").isNotNull() & F.col("score_b").isNotNull()
    return both.withColumn("score", F.when(whole, weights[0] * F.col("score_a") + weights[1] * F.col("score_b")).otherwise(F.raise_error(F.lit("a row has no partner")).cast("double")))


def best_weights(rows: DataFrame, label: str = "y", grid: tuple[tuple[float, float], ...] = GRID) -> DataFrame:
    """Average precision of each weight pair; `best` marks the first maximum."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("wa"), F.lit(b).alias("wb")) for i, (a, b) in enumerate(grid)])
    mixed = rows.withColumn("w", F.explode(pairs)).select("w.*", label, F.round(F.col("w.wa") * F.col("score") + F.col("w.wb") * F.col("score_b"), 9).alias("score"))
    ap = ranking(mixed, "score", label, ("i", "wa", "wb")).groupBy("i", "wa", "wb").agg(F.round(average_precision(), 9).alias("auprc"))
    return ap.withColumn("best", F.row_number().over(Window.orderBy(F.desc("auprc"), "i")) == 1)


def promotion_gate(candidate: DataFrame, production: DataFrame, tolerance: float = 0.01, share: float = 0.9) -> DataFrame:
    """(metric, production, candidate, needed, passes) for each metric that production has and the gate looks at.

    AUPRC may fall by the tolerance; each recall must keep its share; an absent candidate metric fails. No production: no rows, it passes.
    """
    gated = production.where((F.col("metric") == "auprc") | F.col("metric").startswith("recall_")).withColumnRenamed("value", "production")
    needed = F.when(F.col("metric") == "auprc", F.col("production") - tolerance).otherwise(F.col("production") * share)
    out = gated.join(candidate.withColumnRenamed("value", "candidate"), "metric", "left").withColumn("needed", needed)
    return out.withColumn("passes", F.coalesce(F.col("candidate") >= F.col("needed"), F.lit(False)))


def promote(candidate: DataFrame, production: DataFrame | None, force: bool = False) -> None:
    """Raises with the violations; production that lacks auprc fails closed."""
    if force or production is None:
        return
    if not production.where("metric = 'auprc'").limit(1).count():
        raise RuntimeError("production has no auprc")
    bad = promotion_gate(candidate, production).where(~F.col("passes")).select("metric").collect()  # a few metrics
    if bad:
        raise RuntimeError("gate: " + ", ".join(sorted(r["metric"] for r in bad)))


def deltas(candidate: DataFrame, production: DataFrame) -> DataFrame:
    """E13."""
    head = lambda df, name: df.where(F.col("metric").isin("auprc", "auroc", "brier")).withColumnRenamed("value", name)
    return head(candidate, "candidate").join(head(production, "production"), "metric").withColumn("delta", F.col("candidate") - F.col("production"))


def versions(models: DataFrame) -> DataFrame:
    """In the order saved, the last promoted one marked."""
    last = F.max("promoted_at").over(Window.partitionBy())
    return models.withColumn("current", F.coalesce(F.col("promoted_at") == last, F.lit(False))).orderBy("saved_at", "version")
