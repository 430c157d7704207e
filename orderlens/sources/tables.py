"""The star-schema tables in the roles of the order model.

Each role is one SELECT over a base table. It is written once with two tokens that dialects spell differently
(`US(x)`: microseconds of a timestamp, `KEY(x)`: the number k of a JSON string), so that the same text also serves a
SQL oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: The moment at which all time-relative jobs look at the star-schema tables: 2001-08-02 00:00 UTC.
AS_OF = 996_710_400_000_000

ROLES = {
    "orders": (
        "orders",
        """SELECT o_orderkey AS order_id, o_custkey AS user_id,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_custkey * 7 + o_orderkey % 3) % 900 END AS device_id,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey * 2 + o_orderkey % 2 END AS payment_id,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 211 END AS ip,
        CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_custkey * 3 + o_orderkey % 3 END AS address_id,
        o_orderkey % 97 AS store_id, o_orderkey % 97 % 20 AS merchant_id, o_custkey % 25 AS city,
        lower(substr(o_orderpriority, 3)) AS domain,
        CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'P' THEN 'PLACED' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'REFUNDED' WHEN 2 THEN 'FAILED' ELSE 'PREPARING' END END AS status,
        CASE o_orderkey % 3 WHEN 0 THEN 'DELIVERY' WHEN 1 THEN 'PICKUP' ELSE 'IN_STORE' END AS order_type,
        CASE o_orderkey % 6 WHEN 0 THEN 'WELCOME10' WHEN 1 THEN 'SAVE5' ELSE NULL END AS promo_code,
        CAST(round(o_totalprice * 100) AS BIGINT) AS total_pence,
        US(o_orderdate) + o_orderkey % 96 * 900000000 AS placed_us,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE US(o_orderdate) + o_orderkey % 96 * 900000000 + 2700000000 END AS terminal_us
        FROM {orders}""",
    ),
    "contexts": (
        "orders",
        """SELECT o_orderkey AS order_id, CAST(floor(o_totalprice * 90) AS BIGINT) AS subtotal_pence, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderkey % 12 + 1 END AS item_count,
        CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE CAST(o_orderkey % 150 AS DOUBLE) / 10 END AS delivery_distance_km,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 5000 AS DOUBLE) / 10 END AS ip_to_delivery_distance_km,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 1200 AS DOUBLE) / 10 END AS billing_to_delivery_distance_km,
        20 + o_orderkey % 1780 AS time_to_checkout_seconds, CASE o_orderkey % 3 WHEN 0 THEN 'APP' WHEN 1 THEN 'WEB' ELSE 'PHONE' END AS order_channel,
        CASE o_orderkey % 4 WHEN 0 THEN 'CREDIT_CARD' WHEN 1 THEN 'DEBIT_CARD' WHEN 2 THEN 'WALLET' ELSE NULL END AS payment_type,
        CASE o_orderkey % 5 WHEN 0 THEN 'VISA' WHEN 1 THEN 'MASTERCARD' WHEN 2 THEN 'AMEX' ELSE 'OTHER' END AS card_brand,
        CASE o_orderkey % 7 WHEN 0 THEN 'PREPAID' WHEN 1 THEN 'CREDIT' ELSE 'DEBIT' END AS card_funding_type,
        CASE o_orderkey % 2 WHEN 0 THEN 'MOBILE' ELSE 'DESKTOP' END AS device_type, CASE o_orderkey % 6 WHEN 0 THEN 'IOS' WHEN 2 THEN 'ANDROID' ELSE 'WEB' END AS platform, 'UNKNOWN' AS merchant_category,
        CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'HOTEL' WHEN 2 THEN 'COMMERCIAL' WHEN 3 THEN NULL ELSE 'RESIDENTIAL' END AS delivery_address_type,
        CASE o_orderkey % 8 WHEN 0 THEN 'cancelled_by=USER' WHEN 1 THEN '' ELSE NULL END AS cancellation_reason,
        CASE o_orderkey % 8 WHEN 0 THEN '454742' WHEN 1 THEN '535522' WHEN 2 THEN '424519' WHEN 3 THEN '374622' ELSE CAST(453970 + o_orderkey % 20 AS STRING) END AS card_bin, 'UNKNOWN' AS card_issuer_bank,
        CASE o_orderkey % 11 WHEN 0 THEN 'FR' WHEN 1 THEN NULL ELSE 'GB' END AS ip_country, CASE o_orderkey % 13 WHEN 0 THEN 'US' WHEN 1 THEN 'FR' ELSE 'GB' END AS card_issuer_country,
        concat('City ', CAST(o_orderkey % 97 % 25 AS STRING)) AS store_city, CASE o_orderkey % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' ELSE 'Firefox' END AS browser_name,
        lower(substr(o_orderpriority, 3)) AS user_email_domain, o_orderkey % 10 = 0 AS is_guest_checkout, o_orderkey % 14 = 0 AS is_digital_native_bank, o_orderkey % 15 = 0 AS ip_is_proxy,
        o_orderkey % 16 = 0 AS ip_is_vpn, o_orderkey % 21 = 0 AS ip_is_tor, o_orderkey % 22 = 0 AS ip_is_hosting,
        CASE WHEN o_orderkey % 2 = 0 THEN 50.5 + CAST(o_orderkey % 40 AS DOUBLE) / 20 ELSE NULL END AS lat, CAST(o_orderkey % 60 AS DOUBLE) / 20 - 2.5 AS lon FROM {orders}""",
    ),
    "chargeback_rows": (
        "lineitem",
        """SELECT l_orderkey AS order_id, l_orderkey * 8 + l_linenumber AS chargeback_id, US(l_shipdate) AS received_us,
        CASE WHEN l_orderkey % 3 = 0 THEN 'FRAUD' ELSE 'SERVICE' END AS category, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_pence
        FROM {lineitem} WHERE l_returnflag = 'R'""",
    ),
    "refund_rows": (
        "lineitem",
        """SELECT l_orderkey AS order_id, US(l_shipdate) AS refunded_us, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_pence
        FROM {lineitem} WHERE l_returnflag = 'A' AND l_linenumber = 1""",
    ),
    "items": (
        "lineitem",
        """SELECT l_orderkey AS order_id, l_partkey AS item_id, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice) AS BIGINT) AS unit_pence, l_tax > 0 AS is_hot FROM {lineitem}""",
    ),
    "users": (
        "customer",
        """SELECT c_custkey AS user_id, c_name AS name, 749433600000000 + c_custkey % 1000 * 86400000000 AS created_us, c_nationkey AS city,
        CASE c_custkey % 10 WHEN 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS account_status, c_acctbal AS balance, c_mktsegment AS segment FROM {customer}""",
    ),
    "stores": (
        "supplier",
        """SELECT s_suppkey AS store_id, s_suppkey % 20 AS merchant_id, s_nationkey AS city, s_suppkey % 5 <> 0 AS is_active,
        s_suppkey % 2 = 0 AS accepts_delivery, s_suppkey % 3 <> 0 AS accepts_pickup, s_suppkey % 7 = 0 AS accepts_in_store,
        50 + CAST(s_suppkey % 40 AS DOUBLE) / 10 AS lat, CAST(s_suppkey % 50 AS DOUBLE) / 20 - 3 AS lon, s_suppkey % 24 * 3600 AS open_s, (s_suppkey % 24 + 9) % 24 * 3600 AS close_s FROM {supplier}""",
    ),
    "store_hours": (
        "supplier",
        """SELECT s_suppkey AS store_id, v.weekday, (s_suppkey + v.weekday) % 24 * 3600 AS open_s, (s_suppkey + 9 + 2 * v.weekday) % 24 * 3600 + 1800 AS close_s
        FROM {supplier} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) v(weekday) WHERE (s_suppkey + v.weekday) % 5 <> 0""",
    ),
    "truth": (
        "orders",
        """SELECT o_orderkey AS order_id, o_orderkey % 4 = 0 AS is_fraud, o_orderkey % 100 AS ring_id,
        CASE o_orderkey % 12 WHEN 0 THEN 'stolen_card' WHEN 4 THEN 'account_takeover' ELSE 'promo_abuse' END AS category FROM {orders} WHERE o_orderkey % 3 <> 1""",
    ),
    "events": (
        "events",
        """SELECT event_id, user_id, event_type AS store, KEY(props) AS device_id, CAST(round(value * 100) AS BIGINT) AS pence, US(ts) AS ts_us FROM {events}""",
    ),
    "order_log": (
        "lineitem",
        """SELECT DISTINCT l_orderkey AS order_id, CASE l_linenumber WHEN 1 THEN 'PLACED' WHEN 2 THEN 'ACCEPTED' WHEN 3 THEN 'PREPARING' WHEN 4 THEN 'READY' WHEN 5 THEN 'PICKED_UP' WHEN 6 THEN 'IN_TRANSIT' ELSE 'DELIVERED' END AS event_type,
        883612800000000 + l_orderkey % 1000 * 86400000000 + CAST(l_linenumber + CASE WHEN l_orderkey % 10 = 0 THEN l_linenumber % 2 * 2 ELSE 0 END AS BIGINT) * 600000000 AS at_us FROM {lineitem}""",
    ),
    "scored": (
        "documents",
        """SELECT doc_id AS row_id, CAST(n_chars % 1000 AS DOUBLE) / 1000 AS score, CAST(doc_id * 37 % 1000 AS DOUBLE) / 1000 AS score_b, lang AS category FROM {documents}""",
    ),
}

#: As Spark writes the tokens; the oracle's spelling is in the plans.
SPARK = (("US", r"unix_micros(cast(\1 as timestamp))"), ("KEY", r"cast(get_json_object(\1, '$.k') as bigint)"))


def spelled(sql: str, tokens: tuple[tuple[str, str], ...]) -> str:
    for name, to in tokens:
        sql = re.sub(rf"\b{name}\((\w+)\)", to, sql)
    return sql


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table in its role; Catalyst prunes columns and pushes filters through the projection."""
    table, sql = ROLES[name]
    return spark.sql(spelled(sql, SPARK), **{table: base(spark, sf_dir, table)})


def latest_per_key(rows: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """The row of each key that came last (ties: the larger tie column). One aggregation, no window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(when, tie)).alias("r")).select(key, "r.*")


def chargebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(role(spark, sf_dir, "chargeback_rows"), "order_id", "received_us", "chargeback_id")


def refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One refund an order: the first stays (insert or ignore)."""
    return role(spark, sf_dir, "refund_rows").groupBy("order_id").agg(F.min(F.struct("refunded_us", "amount_pence")).alias("r")).select("order_id", "r.*")


def hot_and_cold(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Orders and archived orders as one relation; filters reach both scans."""
    return hot.unionByName(cold)
