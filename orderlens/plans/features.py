"""Queries of scans, joins, aggregations, windows and training sets; each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch, enrich, labels, training, windows
from ..operators.contract import HASHED, REQUIRED, VOCABULARY
from ..sources.tables import AS_OF, DAY, base, chargebacks, hot_and_cold, latest_per_key, refunds, role

c = F.col


def orders(spark, d):
    return role(spark, d, "orders")


def with_outcomes(spark, d):
    return batch.with_outcomes(orders(spark, d), chargebacks(spark, d), refunds(spark, d))


def user_batch(spark, d):
    return batch.user_features(with_outcomes(spark, d), role(spark, d, "users"), AS_OF)


def device_batch(spark, d):
    return batch.device_features(with_outcomes(spark, d), batch.device_first_seen(orders(spark, d)), AS_OF)


RATE = "CASE WHEN count(*) > 0 THEN round(sum(is_chargeback)::DOUBLE / count(*)::DOUBLE, 6) ELSE 0.0 END AS cb_rate"
HALF_EVEN = "round_even(sum(total_pence) / count(*), 0)::BIGINT"
DAYS = f"greatest(floor(({AS_OF} - {{}}) / {DAY}), 0)::BIGINT"


def hot_cold(spark, d):
    rows = orders(spark, d)
    aged = labels.is_archivable(AS_OF - 700 * DAY)
    both = hot_and_cold(rows.where(~F.coalesce(aged, F.lit(False))), rows.where(aged))
    return both.where("total_pence > 10000000").groupBy("status").agg(F.count(F.lit(1)).alias("orders"), F.sum("total_pence").alias("pence"))


def key_lookup(spark, d):
    return role(spark, d, "events").select(c("event_id").alias("order_id"), c("ts_us").alias("seen_us")).join(orders(spark, d).select("order_id", "user_id", "device_id", "ip", "store_id", "total_pence", "placed_us"), "order_id")


def catch_up(spark, d):
    rows = role(spark, d, "events").withColumn("ts", F.timestamp_micros("ts_us")).withColumnRenamed("event_id", "order_id")
    from ..streaming.velocity import missed

    low, high = (F.timestamp_micros(F.lit(1_704_067_200_000_000 + n * DAY)) for n in (3, 9))
    return missed(rows, rows.where("order_id % 3 = 0"), low, high).select("order_id", "ts_us")


def single_column(spark, d):
    return orders(spark, d).select("placed_us").agg(F.min("placed_us").alias("first_us"), F.max("placed_us").alias("last_us"), F.count("placed_us").alias("n"))


def upserted(spark, d):
    from ..sources.io import alive, upsert

    ev = role(spark, d, "events").select("user_id", c("pence").alias("value"), F.timestamp_micros("ts_us").alias("updated_at"))
    out = upsert(ev.where("value % 2 = 0"), ev.where("value % 2 <> 0"), ["user_id"])
    return alive(out, F.timestamp_micros(F.lit(1_704_067_200_000_000 + 29 * DAY))).select("user_id", "value", F.unix_micros("updated_at").alias("updated_us"), F.unix_micros("expires_at").alias("expires_us"))


def weeks(spark, d):
    from ..sources.io import with_week

    rows = with_week(orders(spark, d).withColumn("placed_at", F.timestamp_micros("placed_us")))
    return rows.groupBy(F.unix_date("placed_week").alias("week_day")).agg(F.count(F.lit(1)).alias("orders"))


def expectation(spark, d):
    return role(spark, d, "scored").withColumn("category", F.coalesce("category", F.lit(""))).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"))


def archivable(spark, d):
    return orders(spark, d).where(labels.is_archivable(AS_OF)).select("order_id", "terminal_us")


def open_orders(spark, d):
    return orders(spark, d).where(labels.is_open(AS_OF - 20 * DAY, 60)).select("order_id", "status", "placed_us")


def mature(spark, d):
    start, end = AS_OF - 400 * DAY, AS_OF
    rows = orders(spark, d).where((c("placed_us") >= start) & (c("placed_us") < end) & (c("placed_us") < AS_OF - 45 * DAY))
    return training.filled(rows.select("order_id", "device_id", "promo_code", "ip"))


PROMOS = "promo_code string, kind string, min_pence long, max_per_user long, fixed long, percent double, valid_from long, valid_until long"
PROMO_ROWS = [("WELCOME10", "NEW_USER", 1000, 1, None, 10.0, None, AS_OF + DAY), ("SAVE5", "GENERAL", 5000000, 3, 500, None, AS_OF - 9 * DAY, None), ("OLD", "GENERAL", 0, None, 100, None, None, AS_OF - DAY)]
PROMO_SQL = f"(VALUES ('WELCOME10', 'NEW_USER', 1000, 1, NULL, 10.0, NULL, {AS_OF + DAY}), ('SAVE5', 'GENERAL', 5000000, 3, 500, NULL, {AS_OF - 9 * DAY}, NULL), ('OLD', 'GENERAL', 0, NULL, 100, NULL, NULL, {AS_OF - DAY})) p(promo_code, kind, min_pence, max_per_user, fixed, percent, valid_from, valid_until)"


def promos(spark):
    return spark.createDataFrame(PROMO_ROWS, PROMOS)


def active_promos(spark, d):
    live = promos(spark).where(enrich.is_active_promo(F.lit(AS_OF)))
    return orders(spark, d).where("promo_code is not null").join(F.broadcast(live.select("promo_code", "kind")), "promo_code").groupBy("promo_code", "kind").agg(F.count(F.lit(1)).alias("orders"))


def promo_orders(spark, d):
    from ..functions.columns import promo_discount

    rows = windows.user_snapshot(orders(spark, d))
    got = enrich.eligible_promos(rows, promos(spark).where(enrich.is_active_promo(F.lit(AS_OF))), batch.promo_redemptions(orders(spark, d)))
    return got.select("order_id", "promo_code", promo_discount(c("total_pence"), c("fixed"), c("percent")).alias("discount"))


def open_stores(spark, d):
    rows = enrich.while_open(orders(spark, d), role(spark, d, "store_hours"), "placed_us")
    return rows.groupBy("store_id", enrich.weekday(F.from_utc_timestamp(F.timestamp_micros("placed_us"), "Europe/London")).alias("weekday")).agg(F.count(F.lit(1)).alias("orders"))


def active_entities(spark, d):
    s = role(spark, d, "stores").where("is_active").groupBy("city").agg(F.count(F.lit(1)).alias("stores"))
    u = role(spark, d, "users").where("account_status = 'ACTIVE'").groupBy("city").agg(F.count(F.lit(1)).alias("users"))
    return u.join(s, "city", "left").fillna(0, ["stores"])


def violations(spark, d):
    from ..operators.quality import domain_violations

    return domain_violations(orders(spark, d), "status", ("PLACED", "DELIVERED", "CANCELLED"))


def postcodes(spark, d):
    from ..functions.columns import POSTCODE

    code = F.concat(F.when(c("user_id") % 4 == 0, "S1").when(c("user_id") % 4 == 1, "SW1A").otherwise("1X"), F.when(c("user_id") % 3 == 0, " ").otherwise(""), (c("user_id") % 10).cast("string"), F.lit("AB"))
    return role(spark, d, "users").withColumn("postcode", code).groupBy(c("postcode").rlike(POSTCODE).alias("valid")).agg(F.count(F.lit(1)).alias("users"))


def semi_joined(spark, d):
    gone = role(spark, d, "truth").where("is_fraud").select("order_id")
    return role(spark, d, "items").join(gone, "order_id", "left_semi").groupBy("order_id").agg(F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("quantity"))


def anti_joined(spark, d):
    rows = orders(spark, d).where("status = 'DELIVERED'").select("order_id", "user_id")
    return rows.join(refunds(spark, d).select("order_id"), "order_id", "left_anti").join(chargebacks(spark, d).select("order_id"), "order_id", "left_anti")


def refunded(spark, d):
    return orders(spark, d).where("status = 'DELIVERED'").select("order_id", "user_id").join(refunds(spark, d).select("order_id"), "order_id", "left_semi")


def snapshot(spark, d):
    users = role(spark, d, "users").select("user_id", "city", "segment", "account_status")
    stores = role(spark, d, "stores").select("store_id", "city", "is_active")
    return enrich.snapshot(orders(spark, d).select("order_id", "user_id", "store_id"), {"user_id": users, "store_id": stores})


def refilled(spark, d):
    changed = orders(spark, d).select("order_id", (c("user_id") + 1400).alias("user_id"), F.lit("x").alias("segment"), F.lit(5).alias("lifetime_orders"))
    dim = windows.user_snapshot(orders(spark, d)).groupBy("user_id").agg(F.max("lifetime_orders").alias("lifetime_orders")).join(role(spark, d, "users").select("user_id", "segment"), "user_id")
    return enrich.refill(changed, dim, "user_id", ["segment", "lifetime_orders"])


def near_stores(spark, d):
    users = role(spark, d, "users").select("user_id", "city", (50 + (c("user_id") % 80).cast("double") / 20).alias("lat"), ((c("user_id") % 100).cast("double") / 40 - 3).alias("lon"))
    return enrich.stores_near_totals(users, role(spark, d, "stores"), "user_id")


def top_devices(spark, d):
    last = orders(spark, d).where("device_id is not null").groupBy("user_id", "device_id").agg(F.max("placed_us").alias("last_us"))
    return windows.top_per_parent(last, "user_id", [F.desc("last_us"), "device_id"], 5)


def array_lookup(spark, d):
    keys = orders(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_set("store_id")).alias("stores"))
    exploded = keys.select("user_id", F.explode("stores").alias("store_id")).join(role(spark, d, "stores").select("store_id", "merchant_id"), "store_id")
    return exploded.groupBy("user_id").agg(F.count_distinct("merchant_id").alias("merchants"), F.count(F.lit(1)).alias("stores"))


# Made up: the role tables have no named cities.
CITIES = [(i, f"City {i}", 50 + i / 10, i / 20 - 2) for i in range(20)]


def reference_data(spark, d):
    cities = spark.createDataFrame(CITIES, "city int, name string, lat double, lon double")
    return role(spark, d, "users").select("user_id", "city").join(F.broadcast(cities), "city", "left").groupBy("name").agg(F.count(F.lit(1)).alias("users"), F.round(F.avg("lat"), 6).alias("lat"))


def ring_members(spark, d):
    truth = role(spark, d, "truth")
    rings = truth.select("ring_id").distinct()
    got = batch.ring_members(rings, truth.where("is_fraud and category <> 'promo_abuse'"), orders(spark, d))
    return got.select("ring_id", F.size("members").alias("n"), F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("members"))


def percentiles(spark, d):
    return windows.percentiles(orders(spark, d), "total_pence", {"p50": 0.5, "p95": 0.95}, ("status",)).drop("n")


def demand(spark, d):
    from ..functions.columns import local_hour

    ts = F.timestamp_micros("placed_us")
    return orders(spark, d).groupBy(local_hour(ts).alias("hour"), enrich.weekday(F.from_utc_timestamp(ts, "Europe/London")).alias("weekday")).agg(F.count(F.lit(1)).alias("orders"))


def velocity(spark, d):
    return windows.velocity(orders(spark, d), "user_id", "placed_us", "total_pence").select("order_id", "orders_1h", "orders_24h", "spend_24h")


def event_velocity(spark, d):
    return windows.velocity(role(spark, d, "events"), "user_id", "ts_us", "pence").select("event_id", "orders_1h", "orders_24h", "spend_24h")


def device_history(spark, d):
    rows = windows.lifetime_count(orders(spark, d), "device_id", "placed_us", "lifetime")
    return windows.distinct_before(rows, "device_id", "user_id", "placed_us", "users").select("order_id", "lifetime", "users")


def ip_users(spark, d):
    return windows.distinct_within(orders(spark, d), "ip", "user_id", "placed_us", "users", 30 * DAY).select("order_id", "users")


def asof(key):
    def run(spark, d):
        counts = batch.event_counts(orders(spark, d), chargebacks(spark, d), key)
        return windows.asof_rate(counts, orders(spark, d), key, "placed_us", "cb_rate").select("order_id", "cb_rate")

    return run


def asof_sql(key):
    return f"""WITH e AS (SELECT {key} AS k, placed_us AS tm, 1 AS n, 0 AS b FROM o WHERE {key} IS NOT NULL UNION ALL
    SELECT {key}, greatest(placed_us, received_us), 0, 1 FROM o JOIN cb USING (order_id) WHERE {key} IS NOT NULL),
    g AS (SELECT k, tm, sum(n) AS n, sum(b) AS b FROM e GROUP BY k, tm),
    r AS (SELECT k, tm, sum(n) OVER w AS n, sum(b) OVER w AS b FROM g WINDOW w AS (PARTITION BY k ORDER BY tm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT order_id, CASE WHEN r.n > 0 THEN coalesce(r.b, 0)::DOUBLE / r.n::DOUBLE ELSE 0.0::DOUBLE END AS cb_rate FROM o LEFT JOIN r ON o.{key} = r.k AND o.placed_us = r.tm"""


def gaps(spark, d):
    return windows.previous_gap(role(spark, d, "events"), "user_id", "ts_us", "event_id").select("event_id", "gap_minutes")


def user_snapshots(spark, d):
    return windows.user_snapshot(orders(spark, d)).select("order_id", "lifetime_orders", "orders_30d", "lifetime_spend", "is_first", "new_payment", "new_address")


def latest(spark, d):
    return latest_per_key(role(spark, d, "chargeback_rows"), "order_id", "received_us", "chargeback_id").select("order_id", "received_us", "category")


def training_context(spark, d):
    """What the training set takes of an order besides its history, with the age of the account."""
    from ..functions.columns import whole_days

    placed = orders(spark, d).select("order_id", "user_id", "placed_us")
    ages = placed.join(role(spark, d, "users").select("user_id", "created_us"), "user_id", "left").select("order_id", whole_days(c("placed_us"), c("created_us")).alias("user_account_age_days"))
    return role(spark, d, "contexts").drop("lat", "lon").join(ages, "order_id")


def training_rows(spark, d):
    rows = training.training_set(orders(spark, d), chargebacks(spark, d), role(spark, d, "truth"), AS_OF - 1500 * DAY, AS_OF - 100 * DAY, AS_OF, context=training_context(spark, d))
    return rows.select("order_id", *REQUIRED, "fraud_category")


def training_sql():
    """The whole training set from windows and correlated counts over the plain tables."""
    past = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    back = lambda span: f"(PARTITION BY user_id ORDER BY placed_us RANGE BETWEEN {span} PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW)"
    rates = {"payment_id": "payment_lifetime_chargeback_rate", "store_id": "store_chargeback_rate", "merchant_id": "merchant_chargeback_rate", "domain": "email_domain_chargeback_rate"}
    history = {
        "user_orders_1h_at_order_time": "h.n1", "user_orders_24h_at_order_time": "h.n24", "user_spend_24h_pence": "h.s24", "user_lifetime_order_count": "h.n",
        "user_lifetime_chargeback_rate": "coalesce(r_user.b, 0)::DOUBLE / (h.n + 1)::DOUBLE", "device_lifetime_order_count": "h.dn", "device_unique_users_lifetime": "h.du", "ip_unique_users_24h": "h.iu",
        "is_first_order_for_user": "h.n = 0", "is_new_payment_method": "h.np", "is_new_delivery_address": "h.na", "is_fraud": "coalesce(t.is_fraud, false)", "total_pence": "h.total_pence", "order_type": "h.order_type",
        "user_account_age_days": f"coalesce(greatest(floor((h.placed_us - u.created_us) / {DAY}), 0), 0)::BIGINT", **{v: f"r_{k}.cb_rate" for k, v in rates.items()},
    }
    default = lambda x: "false" if x.startswith(("is_", "ip_is_")) else "'UNKNOWN'" if x in (*VOCABULARY, *HASHED) else "0"
    columns = ", ".join(f"{history[x]} AS {x}" if x in history else f"coalesce(cx.{x}, {default(x)}) AS {x}" for x in REQUIRED)
    fresh = lambda k: f"CASE WHEN {k} IS NULL THEN false ELSE count(*) OVER (PARTITION BY user_id, {k} ORDER BY placed_us {past}) = 0 END"
    user = asof_sql("user_id").replace("CASE WHEN r.n > 0 THEN coalesce(r.b, 0)::DOUBLE / r.n::DOUBLE ELSE 0.0::DOUBLE END AS cb_rate", "r.b")
    return f"""WITH r_user AS ({user}), {", ".join(f"r_{k} AS ({asof_sql(k)})" for k in rates)},
    h AS (SELECT order_id, user_id, placed_us, total_pence, order_type, count(*) OVER h1 AS n1, count(*) OVER h24 AS n24, coalesce(sum(total_pence) OVER h24, 0)::BIGINT AS s24,
        count(*) OVER (PARTITION BY user_id ORDER BY placed_us {past}) AS n, {fresh("payment_id")} AS np, {fresh("address_id")} AS na,
        CASE WHEN device_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY a.device_id ORDER BY a.placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) END AS dn,
        CASE WHEN device_id IS NULL THEN 0 ELSE (SELECT count(DISTINCT b.user_id) FROM o b WHERE b.device_id = a.device_id AND b.placed_us < a.placed_us) END AS du,
        (SELECT count(DISTINCT b.user_id) FROM o b WHERE b.ip = a.ip AND b.placed_us < a.placed_us AND b.placed_us >= a.placed_us - {DAY}) AS iu
        FROM o a WINDOW h1 AS {back(3_600_000_000)}, h24 AS {back(DAY)})
    SELECT h.order_id, {columns}, coalesce(t.category, 'LEGIT') AS fraud_category FROM h JOIN cx USING (order_id) LEFT JOIN u ON u.user_id = h.user_id JOIN r_user USING (order_id)
    {" ".join(f"JOIN r_{k} USING (order_id)" for k in rates)} LEFT JOIN t USING (order_id) WHERE placed_us >= {AS_OF - 1500 * DAY} AND placed_us < {AS_OF - 100 * DAY}"""


def t_orders(spark, d):
    return enrich.recent(orders(spark, d).select("order_id", "terminal_us"), "terminal_us")


def weighted_pick(spark, d):
    return enrich.one_of_many(role(spark, d, "stores").select("city", "store_id"), "city", "store_id")


def union_users(spark, d):
    a = orders(spark, d).where("promo_code = 'SAVE5'").select("user_id")
    return a.unionByName(role(spark, d, "users").where("account_status = 'SUSPENDED'").select("user_id")).distinct()


def anchors(spark, d):
    return orders(spark, d).where("ip is not null").select("ip", "placed_us").dropDuplicates()


A = AS_OF
QUERIES = {
    "S1_U1_hot_cold": (hot_cold, "SELECT status, count(*) AS orders, sum(total_pence)::BIGINT AS pence FROM o WHERE total_pence > 10000000 GROUP BY status"),
    "S3_catch_up": (catch_up, f"SELECT event_id AS order_id, ts_us FROM ev WHERE ts_us > {1_704_067_200_000_000 + 3 * DAY} AND ts_us <= {1_704_067_200_000_000 + 9 * DAY} AND event_id % 3 <> 0"),
    "S4_J3_key_lookup": (key_lookup, "SELECT event_id AS order_id, ts_us AS seen_us, o.user_id, o.device_id, ip, store_id, total_pence, placed_us FROM ev JOIN o ON o.order_id = ev.event_id"),
    "S6_S7_column_scan": (single_column, "SELECT min(placed_us) AS first_us, max(placed_us) AS last_us, count(placed_us) AS n FROM o"),
    "S10_upsert": (upserted, f"""SELECT user_id, arg_max(pence, ts_us) AS value, max(ts_us) AS updated_us, max(ts_us) + {DAY} AS expires_us FROM ev GROUP BY user_id HAVING max(ts_us) + {DAY} > {1_704_067_200_000_000 + 29 * DAY}"""),
    "S14_scored_source": (expectation, "SELECT coalesce(category, '') AS category, count(*) AS n, round(avg(score), 6) AS score FROM sc GROUP BY 1"),
    "S15_X17_weeks": (weeks, "SELECT date_diff('day', DATE '1970-01-01', date_trunc('week', make_timestamp(placed_us))::DATE)::INT AS week_day, count(*) AS orders FROM o GROUP BY 1"),
    "F1_archivable": (archivable, f"SELECT order_id, terminal_us FROM o WHERE status IN ('DELIVERED', 'CANCELLED', 'REFUNDED', 'FAILED') AND terminal_us < {A} - 48 * 3600000000"),
    "F2_open_orders": (open_orders, f"SELECT order_id, status, placed_us FROM o WHERE status NOT IN ('DELIVERED', 'CANCELLED', 'REFUNDED', 'FAILED') AND placed_us > {A - 80 * DAY}"),
    "F3_F6_mature_filled": (mature, f"""SELECT order_id, coalesce(device_id, 0) AS device_id, coalesce(promo_code, 'UNKNOWN') AS promo_code, coalesce(ip, 0) AS ip FROM o
        WHERE placed_us >= {A - 400 * DAY} AND placed_us < {A} AND placed_us < {A - 45 * DAY}"""),
    "F9_active_promos": (active_promos, f"""SELECT promo_code, kind, count(*) AS orders FROM o JOIN (SELECT * FROM {PROMO_SQL} WHERE (valid_until IS NULL OR valid_until > {A}) AND (valid_from IS NULL OR valid_from <= {A})) USING (promo_code) GROUP BY ALL"""),
    "X8_X9_promo_eligibility": (promo_orders, f"""WITH f AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS is_first FROM o),
        r AS (SELECT user_id, promo_code, count(*) AS n FROM o WHERE promo_code IS NOT NULL GROUP BY ALL), p AS (SELECT * FROM {PROMO_SQL} WHERE (valid_until IS NULL OR valid_until > {A}) AND (valid_from IS NULL OR valid_from <= {A}))
        SELECT order_id, f.promo_code, least(total_pence, coalesce(fixed, round(total_pence::DECIMAL(20,2) * percent::DECIMAL(5,2) / 100)::BIGINT))::BIGINT AS discount FROM f JOIN p USING (promo_code) LEFT JOIN r ON r.user_id = f.user_id AND r.promo_code = f.promo_code
        WHERE total_pence >= min_pence AND (max_per_user IS NULL OR coalesce(r.n, 0) < max_per_user) AND (kind <> 'NEW_USER' OR is_first)"""),
    "F10_open_stores": (open_stores, """WITH l AS (SELECT *, (make_timestamp(placed_us) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' AS lt FROM o),
        k AS (SELECT *, dayofweek(lt)::INT AS weekday, extract(hour FROM lt) * 3600 + extract(minute FROM lt) * 60 + floor(extract(second FROM lt)) AS sec FROM l)
        SELECT store_id, weekday, count(*) AS orders FROM k WHERE EXISTS (SELECT 1 FROM sh
        WHERE sh.store_id = k.store_id AND CASE WHEN close_s < open_s THEN (sh.weekday = k.weekday AND sec >= open_s) OR (sh.weekday = (k.weekday + 6) % 7 AND sec <= close_s)
        ELSE sh.weekday = k.weekday AND sec BETWEEN open_s AND close_s END) GROUP BY store_id, weekday"""),
    "F11_active_entities": (active_entities, """SELECT city, count(*) AS users, coalesce(any_value(n), 0)::BIGINT AS stores FROM u LEFT JOIN (SELECT city, count(*) AS n FROM s
        WHERE is_active GROUP BY city) USING (city) WHERE account_status = 'ACTIVE' GROUP BY city"""),
    "F12_domain_violations": (violations, "SELECT status, count(*) AS count FROM o WHERE status NOT IN ('PLACED', 'DELIVERED', 'CANCELLED') GROUP BY status"),
    "F13_postcodes": (postcodes, """SELECT regexp_matches(CASE user_id % 4 WHEN 0 THEN 'S1' WHEN 1 THEN 'SW1A' ELSE '1X' END || CASE WHEN user_id % 3 = 0 THEN ' ' ELSE '' END || (user_id % 10) || 'AB', '^[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}$') AS valid, count(*) AS users
        FROM u GROUP BY 1"""),
    "J10_semi_join": (semi_joined, "SELECT order_id, count(*) AS items, sum(quantity)::BIGINT AS quantity FROM it WHERE order_id IN (SELECT order_id FROM t WHERE is_fraud) GROUP BY order_id"),
    "J11_anti_join": (anti_joined, """SELECT order_id, user_id FROM o WHERE status = 'DELIVERED' AND NOT EXISTS (SELECT 1 FROM rf
        WHERE rf.order_id = o.order_id) AND NOT EXISTS (SELECT 1 FROM cb WHERE cb.order_id = o.order_id)"""),
    "J12_exists_refund": (refunded, "SELECT order_id, user_id FROM o WHERE status = 'DELIVERED' AND EXISTS (SELECT 1 FROM rf WHERE rf.order_id = o.order_id)"),
    "J15_dimension_snapshot": (snapshot, """SELECT order_id, o.user_id, o.store_id, u.city AS user_city, u.segment AS user_segment, u.account_status AS user_account_status, s.city AS store_city, s.is_active AS store_is_active
        FROM o LEFT JOIN u USING (user_id) LEFT JOIN s ON s.store_id = o.store_id"""),
    "J16_X1_stores_near": (near_stores, """WITH p AS (SELECT user_id, city, 50 + (user_id % 80)::DOUBLE / 20 AS lat, (user_id % 100)::DOUBLE / 40 - 3 AS lon FROM u)
        SELECT user_id, count(*) AS stores, sum(store_id)::BIGINT AS ids FROM p
        JOIN s ON p.city = s.city OR 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) <= 15
        GROUP BY user_id"""),
    "J17_W11_top_devices": (top_devices, """SELECT user_id, device_id, last_us, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY last_us DESC, device_id) AS rank FROM (SELECT user_id, device_id, max(placed_us) AS last_us FROM o
        WHERE device_id IS NOT NULL GROUP BY ALL)) WHERE rank <= 5"""),
    "J18_array_lookup": (array_lookup, "SELECT user_id, count(DISTINCT s.merchant_id) AS merchants, count(*) AS stores FROM (SELECT DISTINCT user_id, store_id FROM o) JOIN s USING (store_id) GROUP BY user_id"),
    "J21_reference_data": (reference_data, """SELECT name, count(*) AS users, round(avg(lat), 6) AS lat
        FROM (SELECT CASE WHEN city < 20 THEN 'City ' || city END AS name, CASE WHEN city < 20 THEN 50 + city / 10 END AS lat
        FROM u) GROUP BY name"""),
    "J22_refill": (refilled, """WITH l AS (SELECT user_id, max(n) AS n FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id
        ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM o) GROUP BY user_id),
dm AS (SELECT user_id, segment, n FROM l JOIN u USING (user_id))
        SELECT order_id, o.user_id + 1400 AS user_id, dm.segment, CASE WHEN dm.user_id IS NULL THEN 0 ELSE dm.n END AS lifetime_orders
        FROM o LEFT JOIN dm ON dm.user_id = o.user_id + 1400"""),
    "A1_user_batch": (user_batch, f"""SELECT ox.user_id, count(*) AS orders, sum(total_pence)::BIGINT AS spend, {HALF_EVEN} AS avg_order, sum(is_chargeback)::BIGINT AS chargebacks, sum(is_refund)::BIGINT AS refunds, {RATE},
        count(DISTINCT device_id) AS devices, count(DISTINCT payment_id) AS payments, count(DISTINCT address_id) AS addresses, count(DISTINCT ox.city) AS cities, {DAYS.format('any_value(created_us)')} AS account_age_days, {DAYS.format('max(placed_us)')} AS days_since_last FROM ox JOIN u USING (user_id) GROUP BY ox.user_id"""),
    "A2_device_batch": (device_batch, f"""SELECT device_id, count(*) AS orders, {RATE}, count(DISTINCT user_id) AS users, count(DISTINCT payment_id) AS payments, {DAYS.format('min(placed_us)')} AS first_seen_days_ago FROM ox WHERE device_id IS NOT NULL GROUP BY device_id"""),
    "A3_payment_batch": (lambda spark, d: batch.payment_features(with_outcomes(spark, d)), f"""SELECT payment_id, count(*) AS orders, sum(is_chargeback)::BIGINT AS chargebacks, {RATE}, count(DISTINCT user_id) AS users, count(DISTINCT address_id) AS addresses FROM ox WHERE payment_id IS NOT NULL
        GROUP BY payment_id"""),
    "A4_ip_batch": (lambda spark, d: batch.ip_features(with_outcomes(spark, d), AS_OF), f"""SELECT ip, count(*) AS orders, count(DISTINCT user_id) AS users, {RATE}, {DAYS.format('min(placed_us)')} AS first_seen_days_ago FROM ox WHERE ip IS NOT NULL GROUP BY ip"""),
    "A5_store_batch": (lambda spark, d: batch.store_features(with_outcomes(spark, d), AS_OF), f"""SELECT store_id, {HALF_EVEN} AS avg_order, {RATE}, count(CASE WHEN placed_us >= {A - 30 * DAY} THEN 1 END) AS orders_30d, count(DISTINCT CASE WHEN placed_us >= {A - 30 * DAY} THEN payment_id END) AS cards_30d FROM ox GROUP BY store_id"""),
    "A6_J4_merchant_batch": (lambda spark, d: batch.merchant_features(with_outcomes(spark, d)), """WITH g AS (SELECT merchant_id, count(*) AS n, sum(is_chargeback) AS b FROM ox GROUP BY merchant_id)
        SELECT g.merchant_id, round(any_value(b)::DOUBLE / any_value(n)::DOUBLE, 6) AS cb_rate, count(DISTINCT store_id) AS stores
        FROM ox JOIN g USING (merchant_id) GROUP BY g.merchant_id"""),
    "A7_F5_domain_batch": (lambda spark, d: batch.domain_features(with_outcomes(spark, d), AS_OF), f"SELECT domain, {RATE}, count(*) AS orders FROM ox WHERE placed_us >= {A - 90 * DAY} GROUP BY domain"),
    "A10_promo_redemptions": (lambda spark, d: batch.promo_redemptions(orders(spark, d)), "SELECT user_id, promo_code, count(*) AS redemptions FROM o WHERE promo_code IS NOT NULL GROUP BY ALL"),
    "A11_first_seen": (lambda spark, d: batch.first_seen(orders(spark, d)), "SELECT device_id, user_id, min(placed_us) AS first_us FROM o WHERE device_id IS NOT NULL GROUP BY ALL"),
    "A12_U2_event_counts": (lambda spark, d: batch.event_counts(orders(spark, d), chargebacks(spark, d), "ip"), """SELECT ip, at_us, sum(n)::BIGINT AS orders, sum(b)::BIGINT AS chargebacks FROM (SELECT ip, placed_us AS at_us, 1 AS n, 0 AS b
        FROM o WHERE ip IS NOT NULL UNION ALL SELECT ip, greatest(placed_us, received_us), 0, 1 FROM o JOIN cb USING (order_id)
        WHERE ip IS NOT NULL) GROUP BY ALL"""),
    "A14_bridge_count": (lambda spark, d: batch.bridge_count(role(spark, d, "users").select("user_id"), orders(spark, d).where("promo_code = 'SAVE5'"), "user_id", "n"), "SELECT u.user_id, count(o.order_id) AS n FROM u LEFT JOIN o ON o.user_id = u.user_id AND o.promo_code = 'SAVE5' GROUP BY u.user_id"),
    "A15_ring_members": (ring_members, """WITH m AS (SELECT ring_id, list_sort(list(DISTINCT user_id)) AS l FROM t JOIN o USING (order_id)
        WHERE is_fraud AND category <> 'promo_abuse' GROUP BY ring_id)
        SELECT r.ring_id, coalesce(len(l), 0)::INT AS n, coalesce(array_to_string(l, ','), '') AS members
        FROM (SELECT DISTINCT ring_id FROM t) r LEFT JOIN m USING (ring_id)"""),
    "A16_class_balance": (lambda spark, d: batch.class_balance(role(spark, d, "truth"), "is_fraud").select("pos", "neg", F.round("scale_pos_weight", 6).alias("scale_pos_weight")), """SELECT sum(is_fraud::INT)::BIGINT AS pos, sum(1 - is_fraud::INT)::BIGINT AS neg, round(sum(1 - is_fraud::INT)::DOUBLE / sum(is_fraud::INT)::DOUBLE, 6) AS scale_pos_weight
        FROM t"""),
    "A17_window_count": (lambda spark, d: orders(spark, d).where((c("placed_us") >= A - 900 * DAY) & (c("placed_us") < A - 600 * DAY)).agg(F.count(F.lit(1)).alias("orders")), f"SELECT count(*) AS orders FROM o WHERE placed_us >= {A - 900 * DAY} AND placed_us < {A - 600 * DAY}"),
    "A18_percentiles": (percentiles, "SELECT status, quantile_cont(total_pence, 0.5) AS p50, quantile_cont(total_pence, 0.95) AS p95 FROM o GROUP BY status"),
    "A19_distinct_with_null": (lambda spark, d: orders(spark, d).groupBy("status").agg((F.count_distinct("device_id") + F.max(F.when(c("device_id").isNull(), 1).otherwise(0))).alias("n")), "SELECT status, count(DISTINCT device_id) + max(CASE WHEN device_id IS NULL THEN 1 ELSE 0 END) AS n FROM o GROUP BY status"),
    "A22_X18_demand": (demand, """SELECT extract(hour FROM l)::INT AS hour, dayofweek(l)::INT AS weekday, count(*) AS orders
        FROM (SELECT (make_timestamp(placed_us) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' AS l FROM o) GROUP BY ALL"""),
    "W1_W3_velocity": (velocity, """SELECT order_id, count(*) OVER h AS orders_1h, count(*) OVER dd AS orders_24h, coalesce(sum(total_pence) OVER dd, 0)::BIGINT AS spend_24h
        FROM o WINDOW h AS (PARTITION BY user_id
        ORDER BY placed_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW), dd AS (PARTITION BY user_id
        ORDER BY placed_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW)"""),
    "W1_W3_event_velocity": (event_velocity, """SELECT event_id, count(*) OVER h AS orders_1h, count(*) OVER dd AS orders_24h, coalesce(sum(pence) OVER dd, 0)::BIGINT AS spend_24h
        FROM ev WINDOW h AS (PARTITION BY user_id
        ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW), dd AS (PARTITION BY user_id
        ORDER BY ts_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW)"""),
    "W4_W5_J6_device_history": (device_history, """SELECT a.order_id, CASE WHEN a.device_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY a.device_id
        ORDER BY a.placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) END AS lifetime,
CASE WHEN a.device_id IS NULL THEN 0 ELSE (SELECT count(DISTINCT b.user_id) FROM o b
        WHERE b.device_id = a.device_id AND b.placed_us < a.placed_us) END AS users FROM o a"""),
    "W6_J5_U4_ip_users": (ip_users, f"""SELECT a.order_id, (SELECT count(DISTINCT b.user_id) FROM o b
        WHERE b.ip = a.ip AND b.placed_us < a.placed_us AND b.placed_us >= a.placed_us - {30 * DAY}) AS users FROM o a"""),
    **{f"W7_J7_asof_{k}": (asof(k), asof_sql(k)) for k in ("payment_id", "store_id", "merchant_id", "domain")},
    "W8_L3_latest_chargeback": (latest, "SELECT order_id, received_us, category FROM cb"),
    "W9_previous_gap": (gaps, """SELECT event_id, greatest(floor((ts_us - lag(ts_us) OVER (PARTITION BY user_id
        ORDER BY ts_us, event_id)) / 60000000), 0)::BIGINT AS gap_minutes FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_us)""".replace(" WINDOW w AS (PARTITION BY user_id ORDER BY ts_us)", "").replace("greatest(floor(", "CASE WHEN lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) IS NOT NULL THEN greatest(floor(").replace(", 0)::BIGINT AS gap", ", 0)::BIGINT END AS gap")),
    "W10_A9_user_snapshot": (user_snapshots, f"""SELECT order_id, count(*) OVER p AS lifetime_orders, count(*) OVER (PARTITION BY user_id ORDER BY placed_us RANGE BETWEEN {30 * DAY} PRECEDING AND 1 PRECEDING) AS orders_30d, coalesce(sum(total_pence) OVER p, 0)::BIGINT AS lifetime_spend, count(*) OVER p = 0 AS is_first,
        CASE WHEN payment_id IS NULL THEN false ELSE count(*) OVER (PARTITION BY user_id, payment_id ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 END AS new_payment,
        CASE WHEN address_id IS NULL THEN false ELSE count(*) OVER (PARTITION BY user_id, address_id ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 END AS new_address FROM o WINDOW p AS (PARTITION BY user_id ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "J9_T1_training_set": (training_rows, training_sql()),
    "T4_recent": (t_orders, "SELECT order_id, terminal_us FROM o ORDER BY terminal_us DESC NULLS LAST, order_id LIMIT 100000"),
    "T7_weighted_pick": (weighted_pick, """SELECT city, arg_min(store_id, -ln((('0x' || substr(md5('7:' || city || ':' || store_id), 1, 8))::BIGINT::DOUBLE + 1) / 4294967297.0::DOUBLE) / (store_id + 1)) AS store_id
        FROM s GROUP BY city"""),
    "U3_union_users": (union_users, "SELECT user_id FROM o WHERE promo_code = 'SAVE5' UNION SELECT user_id FROM u WHERE account_status = 'SUSPENDED'"),
    "U4_anchors": (anchors, "SELECT DISTINCT ip, placed_us FROM o WHERE ip IS NOT NULL"),
}
