"""Order enrichment: dimension joins, geography, promotions, opening hours, reference data, filters and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import haversine_km

# Defaults of columns refilled from a missing dimension row.
DEFAULTS = {"email": "unknown@unknown.invalid", "payment_type": "CREDIT_CARD", "address_type": "RESIDENTIAL_NEW", "lifetime_orders": 0}


def snapshot(orders: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Left joins on each dimension's key; its other columns get the key's stem as prefix."""
    for key, table in dimensions.items():
        stem = key.removesuffix("_id")
        orders = orders.join(table.select(key, *[F.col(x).alias(f"{stem}_{x}") for x in table.columns if x != key]), key, "left")
    return orders


def refill(orders: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Copied columns again from their dimension after a key changed; a missing row gives the documented defaults (others null)."""
    fresh = dimension.select(key, *[F.col(x).alias(f"_new_{x}") for x in columns], F.lit(True).alias("_found"))
    out = orders.drop(*columns).join(fresh, key, "left")
    for x in columns:
        out = out.withColumn(x, F.when(F.col("_found"), F.col(f"_new_{x}")).otherwise(F.lit(DEFAULTS.get(x)))).drop(f"_new_{x}")
    return out.drop("_found")


def stores_near(points: DataFrame, stores: DataFrame, key: str, km: float = 15.0) -> DataFrame:
    """Stores in the point's city or within km. Grid cells of the radius's size make it an equi-join: no cross join.

    Cells of longitude widen towards the poles, so each point looks at enough of them for its latitude (up to 80 degrees).
    """
    size = km / 111.0
    cell = lambda x: F.floor(x / size).cast("long")
    s = stores.select("store_id", F.col("city").alias("s_city"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    spread = F.ceil(1 / F.cos(F.radians(F.least(F.abs("lat") + size, F.lit(80.0))))).cast("long")
    near = points.withColumn("cy", F.explode(F.sequence(cell(F.col("lat")) - 1, cell(F.col("lat")) + 1))).withColumn("cx", F.explode(F.sequence(cell(F.col("lon")) - spread, cell(F.col("lon")) + spread)))
    near = near.join(s.withColumn("cy", cell(F.col("s_lat"))).withColumn("cx", cell(F.col("s_lon"))), ["cy", "cx"]).drop("cy", "cx")
    near = near.where(haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")) <= km)
    same = points.join(s, points["city"] == s["s_city"])
    return near.select(key, "store_id").unionByName(same.select(key, "store_id")).distinct()


def stores_near_totals(points: DataFrame, stores: DataFrame, key: str, km: float = 15.0) -> DataFrame:
    """(key, stores, ids): how many stores `stores_near` finds for each point and the sum of their ids, without the pairs.

    Stores of a city are added up once; of those within km the ones in other cities are added, place by place: points and stores of the same
    place and city are one. A key that has several points counts a store for each.
    """
    size = km / 111.0
    cell = lambda x: F.floor(x / size).cast("long")
    totals = [F.count(F.lit(1)).alias("stores"), F.sum("store_id").alias("ids")]
    cities = stores.where("city is not null").groupBy(F.col("city").alias("s_city")).agg(*totals)
    places = stores.where("lat is not null and lon is not null").groupBy(F.col("city").alias("s_city"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).agg(*totals)
    spots = points.where("lat is not null and lon is not null").select("city", "lat", "lon").distinct()
    spread = F.ceil(1 / F.cos(F.radians(F.least(F.abs("lat") + size, F.lit(80.0))))).cast("long")
    near = spots.withColumn("cy", F.explode(F.sequence(cell(F.col("lat")) - 1, cell(F.col("lat")) + 1))).withColumn("cx", F.explode(F.sequence(cell(F.col("lon")) - spread, cell(F.col("lon")) + spread)))
    near = near.join(places.withColumn("cy", cell(F.col("s_lat"))).withColumn("cx", cell(F.col("s_lon"))), ["cy", "cx"])
    near = near.where(~F.coalesce(F.col("city") == F.col("s_city"), F.lit(False)) & (haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")) <= km))
    spot = lambda: F.struct("city", "lat", "lon").alias("_spot")  # noqa: E731  (null cities meet)
    near = near.groupBy(spot()).agg(F.sum("stores").alias("n_stores"), F.sum("ids").alias("n_ids"))
    found = points.select(key, "city", spot()).join(cities, F.col("city") == F.col("s_city"), "left").join(near, "_spot", "left")
    both = lambda a, b: F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a) + F.col(b))
    rows = found.select(key, both("stores", "n_stores").alias("stores"), both("ids", "n_ids").alias("ids")).where("stores is not null")
    return rows.groupBy(key).agg(F.sum("stores").alias("stores"), F.sum("ids").alias("ids"))


def is_active_promo(as_of: Column) -> Column:
    """open ends are null."""
    return (F.col("valid_until").isNull() | (F.col("valid_until") > as_of)) & (F.col("valid_from").isNull() | (F.col("valid_from") <= as_of))


def eligible_promos(orders: DataFrame, promos: DataFrame, redemptions: DataFrame) -> DataFrame:
    """(order, promo) where the order's code applies: minimum, cap per user, NEW_USER on first orders only."""
    rows = orders.join(F.broadcast(promos), "promo_code").join(redemptions, ["user_id", "promo_code"], "left")
    cap = F.col("max_per_user").isNull() | (F.coalesce("redemptions", F.lit(0)) < F.col("max_per_user"))
    return rows.where((F.col("total_pence") >= F.col("min_pence")) & cap & ((F.col("kind") != "NEW_USER") | F.col("is_first")))


def open_intervals(hours: DataFrame) -> DataFrame:
    """(store_id, weekday, from_s, to_s) of (store_id, weekday, open_s, close_s): hours over midnight go on at the next weekday's start. Bounds are inclusive."""
    late = F.col("close_s") < F.col("open_s")
    part = lambda day, low, high: F.struct(day.cast("int").alias("weekday"), low.cast("long").alias("from_s"), high.cast("long").alias("to_s"))
    own = part(F.col("weekday"), F.col("open_s"), F.when(late, 86_400).otherwise(F.col("close_s")))
    return hours.select("store_id", F.inline(F.array_compact(F.array(own, F.when(late, part((F.col("weekday") + 1) % 7, F.lit(0), F.col("close_s")))))))


def while_open(rows: DataFrame, hours: DataFrame, when: str, zone: str = "Europe/London") -> DataFrame:
    """the rows (store_id, time in microseconds) whose store was open then, by its local hours of that weekday or of the night before."""
    local = F.from_utc_timestamp(F.timestamp_micros(when), zone)
    placed = rows.withColumns({"_day": weekday(local), "_s": F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)})
    times = open_intervals(hours).withColumnsRenamed({"store_id": "_store", "weekday": "_weekday"})
    met = (F.col("store_id") == F.col("_store")) & (F.col("_day") == F.col("_weekday")) & F.col("_s").between(F.col("from_s"), F.col("to_s"))
    return placed.join(times, met, "left_semi").drop("_day", "_s")


def weekday(ts: Column) -> Column:
    """0 is Sunday."""
    return F.pmod(F.dayofweek(ts) - 1, F.lit(7))


def one_of_many(rows: DataFrame, key: str, weight: str, seed: int = 7) -> DataFrame:
    """One row of each key, weighted and seeded: the smallest -ln(u) / (w + 1), u from a digest of the row."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *rows.columns)), 1, 8)
    u = (F.conv(digest, 16, 10).cast("double") + 1) / 4294967297.0
    first = F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(-F.log(u) / (F.col(weight) + 1), digest))
    return rows.groupBy(key).agg(first.alias("r")).select(key, "r.*")


# Card issuers with their number ranges, whether they are digital natives, and their share.
ISSUERS = (
    ("Barclays", ("492181", "492182", "492183", "492184", "492185"), False, 0.15), ("HSBC UK", ("453978", "453979", "465859", "465860"), False, 0.12),
    ("Lloyds Bank", ("454313", "454314", "454742", "454743"), False, 0.10), ("NatWest", ("465902", "465903", "465904", "465905"), False, 0.08),
    ("Santander UK", ("491880", "491881", "511234"), False, 0.07), ("Halifax", ("454742", "465925"), False, 0.05), ("Nationwide", ("492930", "492931"), False, 0.05),
    ("Monzo Bank", ("535522", "535523", "539923"), True, 0.10), ("Revolut", ("516842", "535410", "537956"), True, 0.08), ("Starling Bank", ("548175", "548176"), True, 0.05),
    ("Chase UK", ("483138",), True, 0.03), ("American Express UK", ("374622", "374623", "378282"), False, 0.05), ("Foreign EU", ("435060", "424519"), False, 0.04),
    ("Foreign US", ("414709", "424519"), False, 0.03),
)


def with_issuer(rows: DataFrame, bin_: str = "card_bin") -> DataFrame:
    """Issuer and is_digital_native of each card number range; one that two issuers share goes to one of them by weight; unknown: null and false."""
    spark = rows.sparkSession
    bins = spark.createDataFrame([(b, name, digital, share) for name, ranges, digital, share in ISSUERS for b in ranges], f"{bin_} string, issuer string, is_digital_native boolean, share double")
    one = one_of_many(bins, bin_, "share").drop("share")
    return rows.join(F.broadcast(one), bin_, "left").withColumn("is_digital_native", F.coalesce("is_digital_native", F.lit(False)))


def recent(rows: DataFrame, by: str, n: int = 100_000) -> DataFrame:
    """T4: newest first, nulls last."""
    return rows.orderBy(F.desc_nulls_last(by), *[c for c in rows.columns if c != by][:1]).limit(n)
