"""Rules, thresholds, decisions and audit rows. Rules are columns; a registry holds them by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def register(registry: dict, name: str, weight, item) -> None:
    """No duplicates, weights above 0."""
    if name in registry or (isinstance(weight, (int, float)) and weight <= 0):
        raise ValueError(f"{name}: duplicate or weight not above 0")
    registry[name] = (weight, item)


def rules(bins: tuple[str, ...] = ()) -> dict[str, tuple[str, Column]]:
    """The eight rules; bins: blocked card prefixes."""
    # The limits of the rules.
    return {
        "user_velocity": ("REVIEW", c("user_orders_1h") > 10), "device_velocity": ("REVIEW", c("device_orders_1h") > 5), "bin_blocklist": ("DECLINE", c("card_bin").isin(*bins) if bins else F.lit(False)),
        "tor": ("REVIEW", c("ip_is_tor")), "new_user_high_value": ("REVIEW", (c("account_age_days") < 1) & (c("total_pence") > 7500)),
        "disposable_new": ("REVIEW", c("disposable_email") & c("new_payment") & c("new_address")), "chargebacks": ("DECLINE", c("chargeback_count") >= 3), "geo_mismatch": ("REVIEW", (c("ip_km") > 500) & (c("ip_country") != "GB")),
    }


def with_rules(rows: DataFrame, rules_: dict[str, tuple[str, Column]]) -> DataFrame:
    """Names of the rules that fire, and the strongest action."""
    fired = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, (_, cond) in rules_.items()]), lambda x: x.isNotNull())
    declines = F.array(*[F.lit(n) for n, (a, _) in rules_.items() if a == "DECLINE"])
    out = rows.withColumn("rules_triggered", fired)
    return out.withColumn("action", F.when(F.arrays_overlap("rules_triggered", declines), "DECLINE").when(F.size("rules_triggered") > 0, "REVIEW").otherwise("PASS"))


def decide(rows: DataFrame, decline: float = 0.85, review: float = 0.5) -> DataFrame:
    """A declining rule scores 1 by itself; else the score decides, and a reviewing rule lifts an approval."""
    by_rule = c("action") == "DECLINE"
    out = rows.withColumn("score", F.when(by_rule, 1.0).otherwise(c("score"))).withColumn("model_version", F.when(by_rule, "rules_only").otherwise(F.lit("ensemble")))
    decision = F.when(by_rule | (c("score") >= decline), "DECLINE").when((c("score") >= review) | (c("action") == "REVIEW"), "REVIEW").otherwise("APPROVE")
    return out.withColumn("decision", decision)


def audit(rows: DataFrame, features: list[str], decided_at) -> DataFrame:
    """A decision row with a snapshot of its features; a declined order's next status is REJECTED."""
    return rows.select("order_id", F.round("score", 4).alias("score"), "decision", "model_version", "rules_triggered", F.to_json(F.struct(*features)).alias("features_snapshot"), F.lit(decided_at).alias("decided_at"), F.when(c("decision") == "DECLINE", "REJECTED").alias("new_status"))


def rule_precision(decisions: DataFrame, truth: DataFrame, hours: float | None = None) -> DataFrame:
    """Fires and the share truly fraud of each rule, flagged below half; hours that the decisions span: fires an hour."""
    fired = decisions.select("order_id", F.explode("rules_triggered").alias("rule")).join(truth.select("order_id", "is_fraud"), "order_id", "left")
    out = fired.groupBy("rule").agg(F.count(F.lit(1)).alias("fires"), F.round(F.avg(F.coalesce(c("is_fraud"), F.lit(False)).cast("double")), 6).alias("precision"))
    out = out.withColumn("flagged", c("precision") < 0.5)
    return out if hours is None else out.withColumn("fires_per_hour", F.round(c("fires") / hours, 6))
