"""Lifetime and rolling features per entity, from orders joined with outcomes. One aggregation an entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY, average, rate, whole_days


def n() -> Column:
    return F.count(F.lit(1))


def charged() -> Column:
    return F.sum("is_chargeback")


def with_outcomes(orders: DataFrame, chargebacks: DataFrame, refunds: DataFrame) -> DataFrame:
    """is_chargeback and is_refund (0 or 1). Needs one row an order on both sides, or sums would fan out (L3)."""
    cb, rf = (df.select("order_id", F.lit(1).alias(c)) for df, c in ((chargebacks, "is_chargeback"), (refunds, "is_refund")))
    return orders.join(cb, "order_id", "left").join(rf, "order_id", "left").fillna(0, ["is_chargeback", "is_refund"])


def user_features(orders: DataFrame, users: DataFrame, as_of: int) -> DataFrame:
    """Twelve features; orders of unknown users are dropped."""
    rows = orders.groupBy("user_id").agg(
        n().alias("orders"), F.sum("total_pence").alias("spend"), charged().alias("chargebacks"), F.sum("is_refund").alias("refunds"),
        F.count_distinct("device_id").alias("devices"), F.count_distinct("payment_id").alias("payments"), F.count_distinct("address_id").alias("addresses"),
        F.count_distinct("city").alias("cities"), F.max("placed_us").alias("last"),
    )
    now = F.lit(as_of)
    return rows.join(users.select("user_id", "created_us"), "user_id").select(
        "user_id", "orders", "spend", average(F.col("spend"), F.col("orders")).alias("avg_order"), "chargebacks", "refunds", rate(F.col("chargebacks"), F.col("orders")).alias("cb_rate"),
        "devices", "payments", "addresses", "cities", whole_days(now, F.col("created_us")).alias("account_age_days"), whole_days(now, F.col("last")).alias("days_since_last"),
    )


def _entity(orders: DataFrame, key: str, **extra: Column) -> DataFrame:
    """null keys are left out."""
    rows = orders.where(F.col(key).isNotNull()).groupBy(key).agg(n().alias("orders"), charged().alias("chargebacks"), *[c.alias(k) for k, c in extra.items()])
    return rows.withColumn("cb_rate", rate(F.col("chargebacks"), F.col("orders")))


def device_features(orders: DataFrame, devices: DataFrame, as_of: int) -> DataFrame:
    """A2, J3."""
    rows = _entity(orders, "device_id", users=F.count_distinct("user_id"), payments=F.count_distinct("payment_id")).join(devices.select("device_id", "first_seen_us"), "device_id", "left")
    return rows.select("device_id", "orders", "cb_rate", "users", "payments", whole_days(F.lit(as_of), F.col("first_seen_us")).alias("first_seen_days_ago"))


def payment_features(orders: DataFrame) -> DataFrame:
    """A3."""
    return _entity(orders, "payment_id", users=F.count_distinct("user_id"), addresses=F.count_distinct("address_id")).select("payment_id", "orders", "chargebacks", "cb_rate", "users", "addresses")


def ip_features(orders: DataFrame, as_of: int) -> DataFrame:
    """A4."""
    rows = _entity(orders, "ip", users=F.count_distinct("user_id"), first=F.min("placed_us"))
    return rows.select("ip", "orders", "users", "cb_rate", whole_days(F.lit(as_of), F.col("first")).alias("first_seen_days_ago"))


def store_features(orders: DataFrame, as_of: int) -> DataFrame:
    """A5: lifetime, and conditional counts of the last 30 days (inclusive)."""
    recent = F.col("placed_us") >= as_of - 30 * DAY
    rows = _entity(orders, "store_id", spend=F.sum("total_pence"), orders_30d=F.count(F.when(recent, 1)), cards_30d=F.count_distinct(F.when(recent, F.col("payment_id"))))
    return rows.select("store_id", average(F.col("spend"), F.col("orders")).alias("avg_order"), "cb_rate", "orders_30d", "cards_30d")


def merchant_features(orders: DataFrame) -> DataFrame:
    """One aggregation instead of joining group totals back."""
    return _entity(orders, "merchant_id", stores=F.count_distinct("store_id")).select("merchant_id", "cb_rate", "stores")


def domain_features(orders: DataFrame, as_of: int) -> DataFrame:
    """The last 90 days, filtered before grouping so that the scan sees it."""
    return _entity(orders.where(F.col("placed_us") >= as_of - 90 * DAY), "domain").select("domain", "cb_rate", "orders")


def device_first_seen(orders: DataFrame) -> DataFrame:
    return orders.where("device_id is not null").groupBy("device_id").agg(F.min("placed_us").alias("first_seen_us"))


def run_all(jobs: dict[str, Callable[[], None]]) -> None:
    """Runs every job; a failing one doesn't stop the others, and all failures are told at the end."""
    failed = {}
    for name, job in jobs.items():
        try:
            job()
        except Exception as error:  # noqa: BLE001
            failed[name] = error
    if failed:
        raise RuntimeError("failed: " + "; ".join(f"{k}: {v}" for k, v in failed.items()))


def promo_redemptions(orders: DataFrame) -> DataFrame:
    """A10."""
    return orders.where("promo_code is not null").groupBy("user_id", "promo_code").agg(n().alias("redemptions"))


def first_seen(orders: DataFrame, a: str = "device_id", b: str = "user_id") -> DataFrame:
    """A11."""
    return orders.where(F.col(a).isNotNull()).groupBy(a, b).agg(F.min("placed_us").alias("first_us"))


def event_counts(orders: DataFrame, chargebacks: DataFrame, key: str) -> DataFrame:
    """Orders and chargebacks of an entity by time, from a tagged union, aggregated before any window."""
    known = orders.where(F.col(key).isNotNull()).select("order_id", key, "placed_us")
    placed = known.select(key, F.col("placed_us").alias("at_us"), F.lit(1).alias("orders"), F.lit(0).alias("chargebacks"))
    back = known.join(chargebacks.select("order_id", "received_us"), "order_id").select(key, F.greatest("placed_us", "received_us").alias("at_us"), F.lit(0).alias("orders"), F.lit(1).alias("chargebacks"))
    return placed.unionByName(back).groupBy(key, "at_us").agg(F.sum("orders").alias("orders"), F.sum("chargebacks").alias("chargebacks"))


def bridge_count(parents: DataFrame, bridge: DataFrame, key: str, name: str = "users") -> DataFrame:
    """Members of each parent; 0 where there are none."""
    return parents.join(bridge.groupBy(key).agg(n().alias(name)), key, "left").fillna(0, [name])


def ring_members(rings: DataFrame, truth: DataFrame, orders: DataFrame, ring: str = "ring_id", user: str = "user_id") -> DataFrame:
    """Sorted distinct users of each ring; an empty array for none."""
    pairs = truth.join(orders.select("order_id", user), "order_id").select(ring, user).distinct()
    return rings.join(pairs.groupBy(ring).agg(F.array_sort(F.collect_set(user)).alias("members")), ring, "left").withColumn("members", F.coalesce("members", F.array().cast("array<bigint>")))


def class_balance(rows: DataFrame, label: str) -> DataFrame:
    """Positives, negatives and their ratio; no positive or no negative is an error."""
    return rows.agg(F.sum(F.col(label).cast("int")).alias("pos"), F.sum(1 - F.col(label).cast("int")).alias("neg")).select(
        "pos", "neg", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("neg") / F.col("pos")).otherwise(F.raise_error(F.lit("a class is empty")).cast("double")).alias("scale_pos_weight")
    )
