"""Detectors of seven fraud patterns: entity, evidence, flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import haversine_km

DAY = 86_400_000_000
c = F.col


def stolen_card(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Additive score of the order's signs; missing signs count 0."""
    signs = (("avs_mismatch", 0.25), ("cvv_mismatch", 0.25), ("foreign_card", 0.15), ("prepaid_card", 0.1), ("commercial_address", 0.1), ("is_night", 0.1), ("high_value", 0.05))
    total = sum((F.when(F.coalesce(c(name), F.lit(False)), F.lit(w)).otherwise(0.0) for name, w in signs), F.lit(0.0))
    return rows.withColumn("score", F.round(total, 4)).withColumn("flag", c("score") >= threshold)


def takeover(orders: DataFrame, least: int = 10) -> DataFrame:
    """An established user's first order from a device, an ip country and an address that the user never used.

    First uses are the earliest time of each (user, value), added up before they are shuffled, so neither a busy user nor a common value is one task's work.
    """
    marks = ("device_id", "ip_country", "address_id")
    rows = orders.where(" AND ".join(f"{k} is not null" for k in marks))
    past = Window.partitionBy("user_id").orderBy("placed_us").rangeBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("earlier", F.count(F.lit(1)).over(past))
    for k in marks:
        first = rows.groupBy("user_id", k).agg(F.min("placed_us").alias("_first"))
        out = out.join(first, ["user_id", k]).withColumn(f"new_{k}", c("placed_us") == c("_first")).drop("_first")
    return out.withColumn("flag", (c("earlier") >= least) & c("new_device_id") & c("new_ip_country") & c("new_address_id"))


def promo_rings(orders: DataFrame, least: int = 5, metres: float = 500.0) -> DataFrame:
    """D3: a device with which many users redeem the same code; evidence: addresses and /24 networks, the radius of the deliveries, and prepaid cards that users share.

    Columns network (of the ip), lat and lon (of the delivery), prepaid and payment_id are evidence where orders have them.
    """
    keys, have = ["device_id", "promo_code"], set(orders.columns)
    rows = orders.where("promo_code is not null and device_id is not null")
    more = [F.count_distinct("network").alias("networks")] if "network" in have else []
    out = rows.groupBy(*keys).agg(F.count_distinct("user_id").alias("users"), F.count_distinct("ip").alias("ips"), F.count_distinct("payment_id").alias("payments"), F.count(F.lit(1)).alias("orders"), *more)
    if {"lat", "lon"} <= have:
        placed = rows.where("lat is not null and lon is not null")
        centre = placed.groupBy(*keys).agg(F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"))
        radius = placed.join(centre, keys).groupBy(*keys).agg(F.round(F.max(haversine_km(c("lat"), c("lon"), c("_lat"), c("_lon"))) * 1000, 1).alias("radius_m"))
        out = out.join(radius, keys, "left").withColumn("close", F.coalesce(c("radius_m") <= metres, F.lit(False)))
    if "prepaid" in have:
        pooled = rows.where("prepaid").groupBy(*keys, "payment_id").agg(F.count_distinct("user_id").alias("u")).groupBy(*keys).agg(F.count(F.when(c("u") > 1, 1)).alias("pooled_cards"))
        out = out.join(pooled, keys, "left").fillna(0, ["pooled_cards"])
    return out.withColumn("flag", c("users") >= least)


def refund_abuse(orders: DataFrame, refunds: DataFrame, least: int = 3) -> DataFrame:
    """Refunds of the user known strictly before each order, by the tagged union of W7."""
    base = orders.select("order_id", "user_id", c("placed_us").alias("at_us"), F.lit(0).alias("r"))
    back = refunds.join(orders.select("order_id", "user_id", "placed_us"), "order_id").select("order_id", "user_id", F.greatest("refunded_us", "placed_us").alias("at_us"), F.lit(1).alias("r"))
    w = Window.partitionBy("user_id").orderBy("at_us").rangeBetween(Window.unboundedPreceding, -1)
    out = base.unionByName(back).withColumn("refunds_before", F.coalesce(F.sum("r").over(w), F.lit(0))).where("r = 0")
    return out.select("order_id", "user_id", "refunds_before", (c("refunds_before") >= least).alias("flag"))


def collusive_stores(orders: DataFrame, z: float = 2.0) -> DataFrame:
    """Stores that stand out from the stores of their city by cards per order, or by the shares of new, foreign and prepaid cards or cards an hour, where orders have the columns."""
    signs = [x for x in ("new_card", "foreign", "prepaid") if x in orders.columns]
    store = orders.groupBy("city", "store_id").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("payment_id").alias("cards"), *[F.avg(c(x).cast("double")).alias(x) for x in signs])
    store = store.withColumn("share", c("cards") / c("orders"))
    measures = ["share", *signs]
    if signs:
        hourly = orders.groupBy("city", "store_id", F.floor(c("placed_us") / 3_600_000_000).alias("h")).agg(F.count_distinct("payment_id").alias("n")).groupBy("city", "store_id").agg(F.avg("n").alias("cards_per_hour"))
        store, measures = store.join(hourly, ["city", "store_id"]), [*measures, "cards_per_hour"]
    base = store.groupBy("city").agg(*[x for m in measures for x in (F.avg(m).alias(f"_m_{m}"), F.stddev_pop(m).alias(f"_d_{m}"))])
    out, scores = store.join(base, "city"), {m: "z" if m == "share" else f"z_{m}" for m in measures}
    for m, name in scores.items():
        out = out.withColumn(name, F.when(c(f"_d_{m}") > 1e-12, F.round((c(m) - c(f"_m_{m}")) / c(f"_d_{m}"), 6)).otherwise(0.0))
    flag = F.greatest(*[c(x) for x in scores.values()], F.lit(-1e9)) >= z
    return out.withColumn("flag", flag).drop(*[f"_{k}_{m}" for m in measures for k in "md"])


def triangulation(orders: DataFrame, least: int = 3, ratio: float = 0.9) -> DataFrame:
    """One user and device, but about a card and an address for each order."""
    out = orders.where("device_id is not null").groupBy("user_id", "device_id").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("payment_id").alias("cards"), F.count_distinct("address_id").alias("addresses"))
    return out.withColumn("flag", (c("orders") >= least) & (c("cards") >= ratio * c("orders")) & (c("addresses") >= ratio * c("orders")))


def resellers(orders: DataFrame, carts: DataFrame, items: int = 10, daily: tuple[int, int] = (3, 8), share: float = 0.7) -> DataFrame:
    """By user, address and day: many items, three to eight orders, mostly one store."""
    rows = orders.where("address_id is not null").join(carts.select("order_id", "item_count"), "order_id").withColumn("day", F.floor(c("placed_us") / DAY))
    store = rows.groupBy("user_id", "address_id", "day", "store_id").agg(F.count(F.lit(1)).alias("n"), F.sum("item_count").alias("i"))
    out = store.groupBy("user_id", "address_id", "day").agg(F.sum("n").alias("orders"), F.sum("i").alias("items"), F.round(F.max("n") / F.sum("n"), 6).alias("top_store"))
    return out.withColumn("flag", (c("items") >= items) & c("orders").between(*daily) & (c("top_store") >= share))
