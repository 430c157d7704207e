"""Queries whose results come out of tables changed in place: keyed features and archive passes; each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.archive import Archive
from ..sources.io import new_folder
from ..sources.keyed import KeyedTable
from ..sources.tables import AS_OF, DAY, role
from .features import orders

c = F.col
#: Event times between the micro-batches.
CUTS = tuple(1_704_067_200_000_000 + n * DAY for n in (6, 13, 20, 27))
END = 1_704_067_200_000_000 + 10_000 * DAY
BATCH, PASSES = 1_000, 2


def keyed_features(spark, d):
    """Each user's last event, upserted in five micro-batches that overlap; what has expired by the latest event isn't there."""
    rows = role(spark, d, "events").select("user_id", c("pence").alias("value"), c("event_id").alias("row"), F.timestamp_micros("ts_us").alias("updated_at"))
    last = rows.groupBy("user_id", "updated_at").agg(F.max_by("value", "row").alias("value"))
    table = KeyedTable(spark, new_folder(spark, "features"), "user_id long, value long, updated_at timestamp", ["user_id"], buckets=16)
    at = F.unix_micros("updated_at")
    for n, (low, high) in enumerate(zip((0, *CUTS), (*CUTS, END))):
        # each batch brings the last day of the one before it once more
        table.write(last.where((at >= low - DAY) & (at < high)), n)
    out = table.read()
    return out.select("user_id", "value", F.unix_micros("updated_at").alias("updated_us"), F.unix_micros("expires_at").alias("expires_us"))


def written_passes(spark, d):
    """What passes have left in hot and cold weeks."""
    rows = orders(spark, d).select("order_id", "placed_us", "status", "terminal_us", "total_pence")
    placed = rows.select("order_id", "placed_us")
    items = role(spark, d, "items").join(placed, "order_id")
    store = Archive(spark, new_folder(spark, "archive"), ("items",))
    store.load({"orders": rows, "items": items})
    store.run(AS_OF, BATCH, PASSES)
    out = None
    for name in store.tables:
        for side in ("hot", "cold"):
            part = getattr(store, side)(name)
            moved = c("pass") if side == "cold" else F.lit(0).cast("long")
            counts = part.groupBy(moved.alias("pass")).agg(F.count(F.lit(1)).alias("n"), F.sum("order_id").alias("ids"), F.min(F.unix_date("placed_week")).alias("first_week"))
            counts = counts.select(F.lit(name).alias("name"), F.lit(side).alias("side"), "pass", "n", "ids", "first_week")
            out = counts if out is None else out.unionByName(counts)
    none = F.lit(None)
    return out.unionByName(store.ledger().select(c("table").alias("name"), F.lit("ledger").alias("side"), "pass", c("moved").alias("n"), none.cast("long").alias("ids"), none.cast("int").alias("first_week")))


PASS = f"""WITH g AS (SELECT order_id, 1 + (row_number() OVER (ORDER BY terminal_us, order_id) - 1) // {BATCH} AS p FROM o
    WHERE status IN ('DELIVERED', 'CANCELLED', 'REFUNDED', 'FAILED') AND terminal_us < {AS_OF} - 172800000000),
m AS (SELECT order_id, p FROM g WHERE p <= {PASSES}),
r AS (SELECT 'orders' AS name, order_id FROM o UNION ALL SELECT 'items', order_id FROM it JOIN o USING (order_id))"""

QUERIES = {
    "S10_keyed_batches": (keyed_features, f"""WITH one AS (SELECT user_id, ts_us, arg_max(pence, event_id) AS value FROM ev GROUP BY user_id, ts_us)
        SELECT user_id, arg_max(value, ts_us) AS value, max(ts_us) AS updated_us, max(ts_us) + {DAY} AS expires_us FROM one GROUP BY user_id HAVING max(ts_us) + {DAY} > (SELECT max(ts_us) FROM one)"""),
    "L8_T2_A21_written_passes": (written_passes, f"""{PASS}
        SELECT name, CASE WHEN p IS NULL THEN 'hot' ELSE 'cold' END AS side, coalesce(p, 0)::BIGINT AS pass, count(*) AS n, sum(order_id)::BIGINT AS ids,
               min(date_diff('day', DATE '1970-01-01', date_trunc('week', make_timestamp(placed_us))::DATE))::INTEGER AS first_week
        FROM r LEFT JOIN m USING (order_id) JOIN (SELECT order_id, placed_us FROM o) w USING (order_id) GROUP BY 1, 2, 3
        UNION ALL SELECT name, 'ledger', p::BIGINT, count(*), NULL, NULL FROM r JOIN m USING (order_id) GROUP BY name, p"""),
}
