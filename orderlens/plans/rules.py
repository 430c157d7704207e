"""Queries of the demand curve, distances, decisions an order, and models with fixed parameters; each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as x
from ..operators import boosting, labels, monitor, network, sketches
from ..operators.windows import cumulative
from ..sources.tables import role
from .features import demand, orders
from .jobs import decided, scored

c = F.col


def demand_curve(spark, d):
    out = monitor.demand_against(demand(spark, d), monitor.expected_demand(spark))
    return out.select("hour", "weekday", "orders", *[F.round(k, 9).alias(k) for k in ("expected", "observed", "difference")])


def three_distances(spark, d):
    """Store, ip and billing place to the place of delivery."""
    stores = role(spark, d, "stores").select("store_id", c("lat").alias("store_lat"), c("lon").alias("store_lon"))
    places = role(spark, d, "contexts").select("order_id", "lat", "lon")
    rows = orders(spark, d).join(places, "order_id").join(stores, "store_id", "left")
    rows = rows.withColumn("ip_lat", F.when(c("order_id") % 5 != 0, 50 + (c("ip") % 90).cast("double") / 30)).withColumn("ip_lon", F.lit(-1.5))
    rows = rows.withColumn("bill_lat", F.when(c("order_id") % 7 != 0, 50 + (c("user_id") % 60).cast("double") / 20)).withColumn("bill_lon", (c("user_id") % 10).cast("double") / 10)
    km = lambda p: F.round(x.distance_or_zero(c(f"{p}_lat"), c(f"{p}_lon"), c("lat"), c("lon")), 4)
    return rows.select("order_id", km("store").alias("delivery_km"), km("ip").alias("ip_km"), km("bill").alias("billing_km"))


def undecided(spark, d):
    """Of the orders' decisions some are left out, some come twice."""
    rows = decided(spark, d).select("order_id", "decision").where("order_id % 70 <> 3")
    rows = rows.unionByName(rows.where("order_id % 90 = 5")).unionByName(rows.where("order_id % 400 = 1").withColumn("order_id", -c("order_id")))
    return labels.undecided(orders(spark, d), rows)


#: (tree, id, left, right, feature, threshold, value, gain, weight): three trees over (score, score_b).
TREES = [
    (0, 0, 1, 2, 0, 0.5, 0.0, 0.75, 1.0), (0, 1, -1, -1, -1, None, -0.25, 0.0, 1.0), (0, 2, 3, 4, 1, 0.25, 0.0, 0.5, 1.0), (0, 3, -1, -1, -1, None, 0.125, 0.0, 1.0), (0, 4, -1, -1, -1, None, 0.5, 0.0, 1.0),
    (1, 0, 1, 2, 1, 0.625, 0.0, 0.25, 0.5), (1, 1, -1, -1, -1, None, 0.5, 0.0, 0.5), (1, 2, -1, -1, -1, None, -0.5, 0.0, 0.5),
    (2, 0, 1, 2, 0, 0.125, 0.0, 0.5, 0.5), (2, 1, -1, -1, -1, None, 1.0, 0.0, 0.5), (2, 2, 3, 4, 0, 0.875, 0.0, 0.25, 0.5), (2, 3, -1, -1, -1, None, -0.25, 0.0, 0.5), (2, 4, -1, -1, -1, None, 0.75, 0.0, 0.5),
]


def staged_precision(spark, d):
    """M1: average precision after each round of a fixed ensemble."""
    trees = spark.createDataFrame(TREES, boosting.NODES)
    rows = boosting.staged(scored(spark, d).select("score", "score_b", "y"), trees, F.array("score", "score_b"))
    return boosting.by_round(rows).select("round", F.round("auprc", 6).alias("auprc"))


def gains(spark, d):
    """T5: mean gain by feature of a fixed ensemble, and how many rows of the table each feature's first split sends left."""
    found = boosting.gains(spark.createDataFrame(TREES, boosting.NODES), ["score", "score_b"])
    left = scored(spark, d).agg(F.count_if(c("score") <= 0.5).alias("score"), F.count_if(c("score_b") <= 0.625).alias("score_b"))
    left = left.select(F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), c(k).alias("left")) for k in ("score", "score_b")])).alias("r")).select("r.*")
    return found.join(left, "feature")


HOURS = 3_600_000_000
SIX, DAYLONG = 6 * HOURS, 24 * HOURS


def pane_quantiles(spark, d):
    """Median and 99th percentile of the events' amounts, of days that start every six hours, from panes of six hours."""
    parts = sketches.panes(role(spark, d, "events"), "ts_us", "pence", SIX)
    out = sketches.quantiles(sketches.sliding(parts, DAYLONG, SIX), {"p50": 0.5, "p99": 0.99}, ("start_us",))
    return out.select("start_us", "n", F.round("p50", 3).alias("p50"), F.round("p99", 3).alias("p99"))


def pane_drift(spark, d):
    """O3: each day's amounts against those of the seven days before it."""
    parts = sketches.panes(role(spark, d, "events"), "ts_us", "pence", DAYLONG)
    days = parts.select("pane_us").distinct().select(c("pane_us").alias("day_us"))
    near = parts.join(F.broadcast(days), (c("pane_us") <= c("day_us")) & (c("pane_us") >= c("day_us") - 7 * DAYLONG))
    sums = near.groupBy("day_us", "bucket").agg(F.sum(F.when(c("pane_us") == c("day_us"), c("n")).otherwise(0)).alias("a"), F.sum(F.when(c("pane_us") < c("day_us"), c("n")).otherwise(0)).alias("b"))
    ranked = cumulative(sums, "bucket", ["a", "b"], ("day_us",)).where("whole_b > 0")
    return ranked.groupBy("day_us").agg(F.round(F.max(F.abs(c("upto_a") / c("whole_a") - c("upto_b") / c("whole_b"))), 6).alias("ks"), F.max("whole_a").alias("n"), F.max("whole_b").alias("n_reference"))


WEIGHTS = (0.5, -0.25, 0.125)


def weighted_gradient(spark, d):
    """M2: loss and gradient of a fixed one-layer network, positives weighed up, over all rows."""
    import numpy as np

    rows = scored(spark, d).select(F.array("score", "score_b").alias("x"), "y")
    weights = network.class_weights(rows)
    rows = rows.withColumn("weight", F.when(c("y") == 1, weights[1]).otherwise(weights[0]))
    loss, grad = network.gradient(rows, network.Perceptron([2], np.array(WEIGHTS)))
    return spark.createDataFrame([("loss", float(loss)), *((f"g{i}", float(g)) for i, g in enumerate(grad))], "part string, value double").select("part", F.round("value", 6).alias("value"))


KM = "CASE WHEN {0}_lat IS NULL OR {0}_lon IS NULL OR lat IS NULL OR lon IS NULL THEN 0.0 ELSE 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - {0}_lat) / 2), 2) + cos(radians({0}_lat)) * cos(radians(lat)) * pow(sin(radians(lon - {0}_lon) / 2), 2)))) END"
MARGINS = """m AS (SELECT y, CASE WHEN score <= 0.5 THEN -0.25 WHEN score_b <= 0.25 THEN 0.125 ELSE 0.5 END::DOUBLE AS a, CASE WHEN score_b <= 0.625 THEN 0.25 ELSE -0.25 END::DOUBLE AS b,
        CASE WHEN score <= 0.125 THEN 0.5 WHEN score <= 0.875 THEN -0.125 ELSE 0.375 END::DOUBLE AS c FROM y),
e AS (SELECT 1 AS round, y, a AS s FROM m UNION ALL SELECT 2, y, a + b FROM m UNION ALL SELECT 3, y, a + b + c FROM m)"""

GROWTH = (1 + sketches.ERROR) / (1 - sketches.ERROR)
BUCKETS = f"""b AS (SELECT ts_us, CASE WHEN pence = 0 THEN 0 ELSE sign(pence) * (ceil(ln(abs(pence)::DOUBLE) / ln({GROWTH!r}::DOUBLE)) + {sketches.MIDDLE}) END::BIGINT AS bucket FROM ev WHERE pence IS NOT NULL AND ts_us IS NOT NULL)"""
VALUE = f"CASE WHEN {{0}} = 0 THEN 0.0 ELSE sign({{0}}) * pow({GROWTH!r}::DOUBLE, abs({{0}}) - {sketches.MIDDLE}) * {2 / (GROWTH + 1)!r}::DOUBLE END"

QUERIES = {
    "V15_O7_pane_quantiles": (pane_quantiles, f"""WITH {BUCKETS},
        x AS (SELECT unnest([0, 1, 2, 3]) AS i), w AS (SELECT (ts_us // {SIX} - i) * {SIX} AS start_us, bucket FROM b, x),
        r AS (SELECT start_us, bucket, row_number() OVER (PARTITION BY start_us ORDER BY bucket) AS k, count(*) OVER (PARTITION BY start_us) AS n FROM w),
        q AS (SELECT start_us, max(n) AS n, min(CASE WHEN k >= ceil(0.5::DOUBLE * n) THEN bucket END) AS a, min(CASE WHEN k >= ceil(0.99::DOUBLE * n) THEN bucket END) AS z FROM r GROUP BY start_us)
        SELECT start_us, n, round({VALUE.format('a')}, 3) AS p50, round({VALUE.format('z')}, 3) AS p99 FROM q"""),
    "O3_pane_drift": (pane_drift, f"""WITH {BUCKETS},
        p AS (SELECT ts_us // {DAYLONG} * {DAYLONG} AS pane_us, bucket, count(*) AS n FROM b GROUP BY ALL), days AS (SELECT DISTINCT pane_us AS day_us FROM p),
        g AS (SELECT day_us, bucket, sum(CASE WHEN pane_us = day_us THEN n ELSE 0 END) AS a, sum(CASE WHEN pane_us < day_us THEN n ELSE 0 END) AS b FROM p JOIN days ON pane_us <= day_us AND pane_us >= day_us - {7 * DAYLONG} GROUP BY ALL),
        k AS (SELECT day_us, sum(a) OVER v AS ua, sum(b) OVER v AS ub, sum(a) OVER t AS wa, sum(b) OVER t AS wb FROM g WINDOW v AS (PARTITION BY day_us ORDER BY bucket), t AS (PARTITION BY day_us)),
        z AS (SELECT day_us, max(abs(ua::DOUBLE / wa::DOUBLE - ub::DOUBLE / wb::DOUBLE)) AS ks, max(wa)::BIGINT AS n, max(wb)::BIGINT AS n_reference FROM k WHERE wb > 0 GROUP BY day_us)
        SELECT day_us, round(ks, 6) AS ks, n, n_reference FROM z"""),
    "A22_demand_curve": (demand_curve, f"""WITH r AS (SELECT unnest(range(24))::INT AS hour, unnest({list(monitor.HOURLY)}) AS rate), w AS (SELECT unnest(range(7))::INT AS i, unnest({list(monitor.WEEKDAYS)})::DOUBLE AS f),
        x AS (SELECT hour, ((i + 1) % 7)::INT AS weekday, rate * f / {sum(monitor.HOURLY) * sum(monitor.WEEKDAYS)!r}::DOUBLE AS expected FROM r, w),
        n AS (SELECT extract(hour FROM l)::INT AS hour, dayofweek(l)::INT AS weekday, count(*) AS orders FROM (SELECT (make_timestamp(placed_us) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' AS l FROM o) GROUP BY ALL),
        z AS (SELECT x.hour, x.weekday, coalesce(orders, 0) AS orders, expected, coalesce(orders, 0)::DOUBLE / (SELECT count(*) FROM o)::DOUBLE AS observed FROM x LEFT JOIN n ON x.hour = n.hour AND x.weekday = n.weekday)
        SELECT hour, weekday, orders, round(expected, 9) AS expected, round(observed, 9) AS observed, round(observed - expected, 9) AS difference FROM z"""),
    "X2_three_distances": (three_distances, f"""WITH p AS (SELECT o.order_id, cx.lat, cx.lon, s.lat AS store_lat, s.lon AS store_lon, CASE WHEN o.order_id % 5 <> 0 THEN 50 + (o.ip % 90)::DOUBLE / 30 END AS ip_lat, -1.5::DOUBLE AS ip_lon,
        CASE WHEN o.order_id % 7 <> 0 THEN 50 + (o.user_id % 60)::DOUBLE / 20 END AS bill_lat, (o.user_id % 10)::DOUBLE / 10 AS bill_lon FROM o JOIN cx USING (order_id) LEFT JOIN s ON s.store_id = o.store_id)
        SELECT order_id, round({KM.format('store')}, 4) AS delivery_km, round({KM.format('ip')}, 4) AS ip_km, round({KM.format('bill')}, 4) AS billing_km FROM p"""),
    "L13_decisions_an_order": (undecided, """WITH r AS (SELECT order_id FROM o WHERE order_id % 70 <> 3), a AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE order_id % 90 = 5 UNION ALL SELECT -order_id FROM r WHERE order_id % 400 = 1),
        n AS (SELECT order_id, count(*) AS decisions FROM a GROUP BY order_id)
        SELECT coalesce(o.order_id, n.order_id) AS order_id, o.order_id IS NOT NULL AS known, coalesce(decisions, 0) AS decisions FROM o FULL JOIN n ON o.order_id = n.order_id WHERE coalesce(decisions, 0) <> 1 OR o.order_id IS NULL"""),
    "M1_staged_precision": (staged_precision, f"""WITH {MARGINS},
        g AS (SELECT round, s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM e GROUP BY round, s),
        k AS (SELECT round, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY round) AS pos FROM g WINDOW w AS (PARTITION BY round ORDER BY s DESC)),
        v AS (SELECT round, sum(p / pos * tp / (tp + fp)) AS auprc FROM k GROUP BY round) SELECT "round", round(auprc, 6) AS auprc FROM v"""),
    "T5_gains": (gains, """SELECT 'score' AS feature, 3::BIGINT AS splits, 0.5::DOUBLE AS gain, count(CASE WHEN score <= 0.5 THEN 1 END) AS "left" FROM y UNION ALL SELECT 'score_b', 2, 0.375::DOUBLE, count(CASE WHEN score_b <= 0.625 THEN 1 END) FROM y"""),
    "M2_weighted_gradient": (weighted_gradient, f"""WITH w AS (SELECT y, score, score_b, CASE WHEN y = 1 THEN (SELECT sum(1 - y)::DOUBLE / sum(y)::DOUBLE FROM y) ELSE 1.0 END::DOUBLE AS w, {WEIGHTS[0]}::DOUBLE * score + {WEIGHTS[1]}::DOUBLE * score_b + {WEIGHTS[2]}::DOUBLE AS m FROM y),
        z AS (SELECT sum(w) AS t, sum(w * (ln(1 + exp(m)) - y * m)) AS loss, sum(w * (1 / (1 + exp(-m)) - y) * score) AS g0, sum(w * (1 / (1 + exp(-m)) - y) * score_b) AS g1, sum(w * (1 / (1 + exp(-m)) - y)) AS g2 FROM w)
        SELECT 'loss' AS part, round(loss / t, 6) AS value FROM z UNION ALL SELECT 'g0', round(g0 / t, 6) FROM z UNION ALL SELECT 'g1', round(g1 / t, 6) FROM z UNION ALL SELECT 'g2', round(g2 / t, 6) FROM z"""),
}
