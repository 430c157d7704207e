"""Queries of functions, streams, labels, preparation, quality, evaluation, scoring, monitoring and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as x
from ..operators import assemble, batch, contract, detect, evaluate, labels, monitor, prep, quality, score, windows
from ..sources.io import checkpointed
from ..sources.tables import AS_OF, DAY, base, chargebacks, refunds, role
from ..streaming import velocity as stream
from . import features
from .features import orders, with_outcomes

c, A = F.col, AS_OF
us = lambda name: F.timestamp_micros(name)


# --- scalar functions ---------------------------------------------------------------------------------------------


def distances(spark, d):
    s = role(spark, d, "stores").select("store_id", "lat", "lon")
    rows = orders(spark, d).join(s, "store_id", "left").withColumn("lat2", 50 + (c("user_id") % 90).cast("double") / 30)
    return rows.select("order_id", F.round(x.distance_or_zero(c("lat"), c("lon"), c("lat2"), F.lit(-1.5)), 4).alias("km"))


def fees(spark, d):
    km = (c("order_id") % 200).cast("double") / 8
    rows = orders(spark, d).withColumn("delivery", x.delivery_fee(km, c("order_type"))).withColumn("service", x.service_fee(c("total_pence") % 5000))
    total = x.order_total(c("total_pence"), F.lit(7), c("delivery"), c("service"), F.lit(50), F.lit(100))
    return rows.select("order_id", "delivery", "service", total.alias("total"), x.pence_to_text(c("total_pence") - 10_000_000).alias("text"))


def money(spark, d):
    return base(spark, d, "part").select("p_partkey", x.pounds_to_pence((c("p_retailprice") * 1000).cast("long").cast("decimal(20,3)") / 1000).alias("pence"), x.half_even(c("p_size").cast("decimal(10,1)") / 2).alias("even"))


def emails(spark, d):
    email = F.when(c("user_id") % 7 == 0, "nobody").otherwise(F.concat(F.lower("name"), F.when(c("user_id") % 5 == 0, "@Mailinator.com").otherwise("@example.com")))
    rows = role(spark, d, "users").withColumn("email", email).withColumn("domain", x.email_domain(c("email")))
    return rows.select("user_id", "domain", x.is_disposable(c("domain")).alias("disposable"), x.mask_email(c("email")).alias("masked"), x.member_pence(F.concat_ws(":", "user_id", F.when(c("user_id") % 3 == 0, "bad").otherwise(c("city").cast("string")))).alias("pence"))


def countries(spark, d):
    raw = F.when(c("user_id") % 4 == 0, " uk").when(c("user_id") % 4 == 1, "France").when(c("user_id") % 4 == 2, "de").otherwise("Atlantis")
    return role(spark, d, "users").groupBy(x.iso_country(raw, {"France": "FR"}).alias("country")).agg(F.count(F.lit(1)).alias("users"))


HOLIDAYS = ("1999-12-25", "2000-01-03", "2000-04-21", "2000-12-25", "2001-01-01")


def times(spark, d):
    rows = orders(spark, d).withColumn("ts", us("placed_us"))
    return rows.select(
        "order_id", x.iso_week_key(c("ts")).alias("week"), x.local_hour(c("ts")).alias("hour"), x.is_night(c("ts")).alias("night"), x.bucket(F.floor(c("placed_us") / 1_000_000)).alias("bucket"),
        x.whole_days(F.lit(A), c("terminal_us")).alias("days"), x.is_bank_holiday(c("ts"), HOLIDAYS).alias("holiday"),
    )


def flags(spark, d):
    reason = F.when(c("order_id") % 4 == 0, "cancelled_by=USER").when(c("order_id") % 8 == 1, "cancelled_by=ROBOT").when(c("order_id") % 8 == 5, "out of stock")
    return orders(spark, d).select("order_id", x.is_new_user_promo(c("promo_code")).alias("welcome"), x.cancelled_by(reason, c("status"), c("order_type")).alias("cancelled_by"))


def store_types(spark, d):
    kinds = x.order_types(c("accepts_delivery"), c("accepts_pickup"), c("accepts_in_store"))
    apps = x.channels(F.array(F.when(c("store_id") % 2 == 0, "iOS").otherwise("web"), F.when(c("store_id") % 3 == 0, "ANDROID").otherwise("tv")))
    return role(spark, d, "stores").select("store_id", F.concat_ws(",", kinds).alias("kinds"), apps["has_ios"].alias("ios"), apps["has_android"].alias("android"))


def json_fields(spark, d):
    rows = base(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    payload = F.to_json(F.struct(c("event_id").alias("id"), c("event_type").alias("type")))
    safe = x.json_number(F.when(c("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(c("value")))
    return rows.groupBy("event_type").agg(F.max("k").alias("k"), F.min(payload).alias("payload"), F.count(safe).alias("finite"))


def arrays(spark, d):
    rows = orders(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_set("status")).alias("s"))
    more = F.array_append("s", "NEW")
    return rows.select("user_id", F.size(more).alias("n"), F.array_contains("s", "PLACED").alias("placed"), F.array_join(more, ",").alias("all"))


# --- streaming twins ----------------------------------------------------------------------------------------------


def pairs(spark, d):
    ev = role(spark, d, "events")
    return stream.fan_out(ev.select(
        c("event_id").cast("string").alias("order_id"), c("user_id").cast("string").alias("user_id"), c("store").alias("store_id"), c("device_id").cast("string").alias("device_id"),
        (c("pence") % 50).cast("string").alias("payment_id"), F.when(c("event_id") % 9 != 0, (c("user_id") % 40).cast("string")).alias("address_id"), (c("event_id") % 60).cast("string").alias("ip"),
        c("pence"), F.when(c("event_id") % 10 == 0, "DECLINED").otherwise("PLACED").alias("status"), us("ts_us").alias("ts"),
    ))


def stream_velocity(entity):
    names = sorted(n for n, _, _ in stream.MEMBERS[entity])

    def run(spark, d):
        rows = stream.velocity_batch(pairs(spark, d).where(c("entity") == entity))
        return rows.select("id", c("order_id").cast("long").alias("order_id"), "orders_1h", "orders_24h", "spend_24h", "last_order_age", "decline_count_24h", *names)

    key = {"user": "user_id::VARCHAR", "store": "store", "device": "device_id::VARCHAR", "payment": "(pence % 50)::VARCHAR", "address": "CASE WHEN event_id % 9 <> 0 THEN (user_id % 40)::VARCHAR END", "ip": "(event_id % 60)::VARCHAR"}
    col = {"user_id": "user_id::VARCHAR", "store_id": "store", "device_id": "device_id::VARCHAR", "payment_id": "(pence % 50)::VARCHAR"}
    counts = ", ".join(f"(SELECT count(DISTINCT {n}_m) FROM p b WHERE b.id = a.id AND b.s BETWEEN a.s - {span} AND a.s) AS {n}" for n, _, span in stream.MEMBERS[entity])
    sql = f"""WITH p AS (SELECT {key[entity]} AS id, event_id AS order_id, ts_us // 1000000 AS s, pence, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS dec, {', '.join(f'{col[m]} AS {n}_m' for n, m, _ in stream.MEMBERS[entity])} FROM ev WHERE {key[entity]} IS NOT NULL)
    SELECT id, order_id, count(*) OVER (PARTITION BY id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS orders_1h, count(*) OVER w AS orders_24h, sum(pence) OVER w::BIGINT AS spend_24h,
    (s - lag(s) OVER (PARTITION BY id ORDER BY s, order_id::VARCHAR)) // 60 AS last_order_age, sum(dec) OVER w::BIGINT AS decline_count_24h, {counts} FROM p a WINDOW w AS (PARTITION BY id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)"""
    sql = sql.replace("sum(pence) OVER w::BIGINT", "(sum(pence) OVER w)::BIGINT").replace("sum(dec) OVER w::BIGINT", "(sum(dec) OVER w)::BIGINT")
    return run, sql


def quarantine(spark, d):
    ev = base(spark, d, "events")
    raw = ev.select(F.when(c("event_id") % 50 != 0, c("event_id").cast("string")).alias("order_id"), F.when(c("event_id") % 70 == 0, "not a time").otherwise(c("ts").cast("string")).alias("placed_at"), F.when(c("event_id") % 30 == 0, "x12").otherwise("12").alias("total_pence"))
    return stream.parsed(raw).groupBy("bad").agg(F.count(F.lit(1)).alias("n"))


def repeats(spark, d):
    ev = role(spark, d, "events").select("event_id", us("ts_us").alias("ts"))
    doubled = ev.unionByName(ev.where("event_id % 4 = 0")).withColumnRenamed("event_id", "order_id")
    return doubled.dropDuplicates(["order_id"]).agg(F.count(F.lit(1)).alias("orders"))


def tumbling(spark, d):
    return stream.per_minute(role(spark, d, "events").withColumn("ts", us("ts_us")), "ts", "store", "5 minutes")


def sliding(spark, d):
    return stream.rolling(role(spark, d, "events").withColumn("ts", us("ts_us")), "ts", "pence", "1 hour", "20 minutes")


# --- assembly -----------------------------------------------------------------------------------------------------


def order_pairs(spark, d):
    rows = orders(spark, d).select("order_id", *set(stream.KEYS.values()), c("total_pence").alias("pence"), "status", us("placed_us").alias("ts"))
    return stream.fan_out(rows)


def all_features(spark, d):
    """The 13 relations of all entities, from all orders; stream ones as of AS_OF, where those silent for a day have expired."""
    rows = checkpointed(with_outcomes(spark, d))  # seven aggregations read it
    tables = {
        "user": batch.user_features(rows, role(spark, d, "users"), A), "device": batch.device_features(rows, batch.device_first_seen(rows), A), "payment": batch.payment_features(rows), "ip": batch.ip_features(rows, A),
        "store": batch.store_features(rows, A), "merchant": batch.merchant_features(rows), "email_domain": batch.domain_features(rows, A),
    }
    now = checkpointed(assemble.named(stream.current(order_pairs(spark, d), A // 1_000_000), "", "stream"))
    return {(e, "batch"): assemble.named(t, e, "batch") for e, t in tables.items()} | stream.relations(now)


def vectors(spark, d):
    rows = orders(spark, d).select("order_id", *contract.KEYS.values())
    out = assemble.assemble(rows, all_features(spark, d))
    return out.select("order_id", *assemble.contract(), F.array_join("missing_features", ",").alias("missing"))


def vectors_sql():
    at, day = A // 1_000_000, A // 1_000_000 - 86400
    ones = {"user": {"unique_stores_24h": "store_id", "unique_payment_methods_24h": "payment_id"}, "device": {"unique_users_24h": "user_id", "unique_payment_methods_24h": "payment_id"}, "payment": {"unique_users_24h": "user_id"}, "ip": {"unique_users_24h": "user_id", "unique_devices_24h": "device_id"}, "store": {"unique_users_24h": "user_id"}, "address": {"unique_users_24h": "user_id"}}
    hour = f"s >= {at - 3600}"
    plain = {
        "orders_1h": f"count(CASE WHEN {hour} THEN 1 END)", "orders_24h": "count(*)", "spend_1h_pence": f"coalesce(sum(CASE WHEN {hour} THEN total_pence END), 0)", "spend_24h_pence": "sum(total_pence)",
        "last_order_age_minutes": "(max(s) - list_reverse_sort(list(s))[2]) // 60", "decline_count_24h": "count(CASE WHEN status = 'DECLINED' THEN 1 END)", "unique_cards_1h": f"count(DISTINCT CASE WHEN {hour} THEN payment_id END)",
    }
    batches = {"user": "A1_user_batch", "device": "A2_device_batch", "payment": "A3_payment_batch", "ip": "A4_ip_batch", "store": "A5_store_batch", "merchant": "A6_J4_merchant_batch", "email_domain": "A7_F5_domain_batch"}
    tables, joins, values, rows, fields_ = ["od AS (SELECT *, placed_us // 1000000 AS s FROM o)"], [], [], [], []
    for e, kind, fields in contract.RELATIONS:
        key, t = contract.KEYS[e], f"{e}_{kind}"
        if kind == "batch":
            own = {v: k for k, v in contract.OWN_NAMES[e, kind].items()}
            body = features.QUERIES[batches[e]][1]
            if body.startswith("WITH g AS"):
                body = body.replace("WITH g AS", "WITH gm AS").replace("JOIN g ", "JOIN gm ").replace("g.merchant_id", "gm.merchant_id")
            tables.append(f"{t} AS ({body})")
        else:
            own = {}
            cols = ", ".join(f"{plain[f] if f in plain else f'count(DISTINCT {ones[e][f]})'} AS {f}" for f in fields)
            tables.append(f"{t} AS (SELECT {key}, {cols} FROM od WHERE {key} IS NOT NULL AND s BETWEEN {day} AND {at} GROUP BY {key})")
        joins.append(f"LEFT JOIN {t} ON {t}.{key} = o.{key}")
        values += [f"coalesce({t}.{own.get(f, f)}, 0)::{'DOUBLE' if f.endswith('rate') else 'BIGINT'} AS {e}_{f}" for f in fields]
        path = f"'fs:{e}:' || o.{key} || ':{kind}'"
        rows.append(f"CASE WHEN o.{key} IS NOT NULL AND {t}.{key} IS NULL THEN {path} END")
        fields_ += [f"CASE WHEN {t}.{key} IS NOT NULL AND {t}.{own.get(f, f)} IS NULL THEN {path} || ':{f}' END" for f in fields]
    missing = f"array_to_string(list_filter([{', '.join(rows + fields_)}], lambda v: v IS NOT NULL), ',')"
    return f"WITH {', '.join(tables)} SELECT o.order_id, {', '.join(values)}, {missing} AS missing FROM o {' '.join(joins)}"


# --- labels -------------------------------------------------------------------------------------------------------


def outcome_labels(spark, d):
    rows = labels.finalise(labels.outcomes(orders(spark, d), chargebacks(spark, d)), refunds(spark, d), A)
    return rows.select("order_id", "category", "outcome", labels.business_label(c("category"), c("outcome")).alias("is_bad"))


def truth_labels(spark, d):
    return labels.training_labels(orders(spark, d), role(spark, d, "truth")).select("order_id", "is_fraud", "fraud_category")


EXPECTED_RATES = [("stolen_card", 0.6), ("account_takeover", 0.3), ("promo_abuse", 0.1), ("LEGIT", 0.002)]


def audit_rates(spark, d):
    expected = spark.createDataFrame(EXPECTED_RATES, "fraud_category string, expected_rate double")
    return labels.chargeback_audit(orders(spark, d), role(spark, d, "truth"), chargebacks(spark, d), expected)


def archive_moves(spark, d):
    cold, hot = labels.archive_split(orders(spark, d), {"items": role(spark, d, "items"), "log": role(spark, d, "order_log")}, A)
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.sum("order_id").alias("ids")).select(F.lit(side).alias("side"), F.lit(name).alias("name"), "n", "ids") for side, t in (("cold", cold), ("hot", hot)) for name, df in t.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def log(spark, d):
    return role(spark, d, "order_log")


def bad_transitions(spark, d):
    return labels.invalid_transitions(spark, windows.previous_status(log(spark, d))).select("order_id", "previous", "event_type", "at_us")


def gaps(spark, d):
    return labels.chain_gaps(log(spark, d)).select("order_id", F.array_join(F.array_sort("missing"), ",").alias("missing"))


def pruned(spark, d):
    out = labels.prune_window({"orders": orders(spark, d), "items": role(spark, d, "items")}, A - 900 * DAY, A - 600 * DAY)
    return out["items"].groupBy((c("order_id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("items"))


def carts(spark, d):
    return labels.cart_rollup(role(spark, d, "items"))


def reconciled(spark, d):
    return labels.reconcile(orders(spark, d), carts(spark, d)).select("order_id", "difference")


def orphaned(spark, d):
    return labels.orphans(orders(spark, d).where("status <> 'FAILED'"), role(spark, d, "items"), "order_id").groupBy("order_id").agg(F.count(F.lit(1)).alias("items"))


# --- preparation and quality --------------------------------------------------------------------------------------

PLAN = prep.Plan(numeric=("total_pence", "city"), logged=("total_pence",), vocabulary=("domain", "status"), hashed={"promo_code": 50}, boolean=("is_night",))


def prepared(spark, d):
    rows = prep.time_split(orders(spark, d).withColumn("is_night", c("order_id") % 4 == 0))
    rows = prep.prepared(rows, PLAN)
    train = rows.where("split = 'train'")
    out = prep.apply(rows, PLAN, prep.fit_numeric(train, PLAN), prep.fit_vocabulary(train, PLAN, 4))
    return out.select("order_id", "split", F.round("total_pence", 5).alias("total_z"), F.round("city", 5).alias("city_z"), "domain", "status", "is_night")


def ratio(spark, d):
    rows = windows.user_snapshot(windows.velocity(orders(spark, d), "user_id", "placed_us", None))
    return prep.engineered(rows).select("order_id", F.round("velocity_ratio", 6).alias("velocity_ratio"))


EXPECTED = [("n_chars", "p50", 0.0, 500.0), ("n_chars", "p95", 0.0, 1e9), ("doc_id", "p50", 1e6, 2e6), ("nothing", "p50", 0.0, 1.0)]


def labelled_docs(spark, d):
    docs = base(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(base(spark, d, "labels"), "doc_id").withColumn("fixed", F.lit("same")).withColumn("leaky", F.when(c("toxic") == 1, "bad")).withColumn("three", c("doc_id") % 3)


def scanned(spark, d):
    expected = spark.createDataFrame(EXPECTED, "column string, metric string, low double, high double")
    return quality.scan(labelled_docs(spark, d).drop("text", "quality"), "toxic", expected, 0.5, 0.9).select("column", "severity", "check_name", "metric")


# --- evaluation ---------------------------------------------------------------------------------------------------


def scored(spark, d):
    truth = base(spark, d, "labels").select(c("doc_id").alias("row_id"), c("toxic").cast("long").alias("y"))
    return role(spark, d, "scored").join(truth, "row_id")


CURVE = """g AS (SELECT score, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM y GROUP BY score),
k AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM g WINDOW w AS (ORDER BY score DESC)),
r AS (SELECT *, tp / (tp + fp) AS prec, tp / pos AS rec FROM k)"""


def rounded(df, digits=6):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(n, digits).alias(n) if kinds[n] == "double" else c(n) for n in df.columns])


def curve(spark, d):
    return rounded(evaluate.ranking(scored(spark, d)).select("score", "tp", "fp", "precision", "recall", "fpr"))


def confusion(spark, d):
    return evaluate.confusion(scored(spark, d))


def gate(spark, d):
    rows = scored(spark, d)
    cand = rows.groupBy("category").agg(F.avg("score").alias("value")).select(F.concat(F.lit("recall_"), "category").alias("metric"), "value").where("metric <> 'recall_de'")
    prod = rows.groupBy("category").agg(F.avg("score_b").alias("value")).select(F.concat(F.lit("recall_"), "category").alias("metric"), "value")
    return rounded(evaluate.promotion_gate(cand, prod))


def deltas(spark, d):
    rows = scored(spark, d)
    one = lambda s: rows.agg(F.avg(s).alias("auprc"), F.max(s).alias("auroc")).select(F.explode(F.array(F.struct(F.lit("auprc").alias("metric"), c("auprc").alias("value")), F.struct(F.lit("auroc").alias("metric"), c("auroc").alias("value")))).alias("m")).select("m.*")
    return rounded(evaluate.deltas(one("score"), one("score_b")))


def ensemble(spark, d):
    a = role(spark, d, "scored").select("row_id", "score")
    b = role(spark, d, "scored").select("row_id", c("score_b").alias("score"))
    return rounded(evaluate.ensemble(a, b, "row_id", (0.6, 0.4)).select("row_id", "score"))


# --- scoring and monitoring ---------------------------------------------------------------------------------------


def context(spark, d):
    rows = windows.user_snapshot(windows.velocity(orders(spark, d), "user_id", "placed_us", None))
    return rows.withColumnsRenamed({"orders_24h": "user_orders_1h", "lifetime_orders": "chargeback_count"}).select(
        "order_id", "user_id", "total_pence", "placed_us", "user_orders_1h", "chargeback_count", "new_payment", "new_address", (c("order_id") % 9).alias("device_orders_1h"), (c("order_id") % 30).cast("string").alias("card_bin"),
        (c("order_id") % 50 == 0).alias("ip_is_tor"), (c("user_id") % 5).alias("account_age_days"), (c("user_id") % 6 == 0).alias("disposable_email"), ((c("order_id") % 800).cast("double")).alias("ip_km"),
        F.when(c("order_id") % 2 == 0, "GB").otherwise("FR").alias("ip_country"), ((c("order_id") * 13 % 1000).cast("double") / 1000).alias("score"),
    )


def decided(spark, d):
    return score.decide(score.with_rules(context(spark, d), score.rules(("3", "17"))))


CTX = """h AS (SELECT *, count(*) OVER (PARTITION BY user_id
    ORDER BY placed_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS n24, count(*) OVER (PARTITION BY user_id
    ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life,
CASE WHEN payment_id IS NULL THEN false ELSE count(*) OVER (PARTITION BY user_id, payment_id
    ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 END AS np, CASE WHEN address_id IS NULL THEN false ELSE count(*) OVER (PARTITION BY user_id, address_id
    ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 END AS na FROM o),
f AS (SELECT order_id, user_id, placed_us, total_pence, (order_id * 13 % 1000)::DOUBLE / 1000 AS raw, list_filter([CASE WHEN n24 > 10 THEN 'user_velocity' END, CASE WHEN order_id % 9 > 5 THEN 'device_velocity' END, CASE WHEN order_id % 30 IN (3, 17) THEN 'bin_blocklist' END, CASE WHEN order_id % 50 = 0 THEN 'tor' END,
CASE WHEN user_id % 5 < 1 AND total_pence > 7500 THEN 'new_user_high_value' END, CASE WHEN user_id % 6 = 0 AND np AND na THEN 'disposable_new' END, CASE WHEN life >= 3 THEN 'chargebacks' END, CASE WHEN order_id % 800 > 500 AND order_id % 2 = 1 THEN 'geo_mismatch' END], lambda v: v IS NOT NULL) AS rules
    FROM h),
dc AS (SELECT *, list_contains(rules, 'bin_blocklist') OR list_contains(rules, 'chargebacks') AS declined, CASE WHEN list_contains(rules, 'bin_blocklist') OR list_contains(rules, 'chargebacks') THEN 1.0 ELSE raw END AS score
    FROM f),
dd AS (SELECT *, CASE WHEN declined OR score >= 0.85 THEN 'DECLINE' WHEN score >= 0.5 OR len(rules) > 0 THEN 'REVIEW' ELSE 'APPROVE' END AS decision
    FROM dc)"""


def decisions(spark, d):
    return decided(spark, d).select("order_id", F.array_join("rules_triggered", ",").alias("rules"), "action", "score", "model_version", "decision")


def audited(spark, d):
    rows = score.audit(decided(spark, d), ["total_pence", "user_orders_1h"], "2001-08-02")
    return rows.select("order_id", "decision", "features_snapshot", "new_status")


def with_time(spark, d):
    return decided(spark, d).withColumnRenamed("placed_us", "decided_us")


def live(spark, d):
    return monitor.live_metrics(with_time(spark, d), role(spark, d, "truth"), span=90 * DAY)


def drift(spark, d):
    ev = role(spark, d, "events").withColumn("late", (c("ts_us") >= 1_705_363_200_000_000).cast("int"))
    return rounded(monitor.ks(ev, "pence", "late", ("store",)).select("store", "ks", "n_a", "n_b", "p_value", "status"))


def snapshot_drift(spark, d):
    snap = F.to_json(F.struct((c("total_pence") % 1000).alias("a"), (c("order_id") % 97).alias("b"), (c("order_id") % 7 + F.when(c("order_id") % 2 == 0, 3).otherwise(0)).alias("c")))
    rows = orders(spark, d).select((c("order_id") % 2).alias("late"), snap.alias("snap"))
    return rounded(monitor.top_drift(monitor.ks(monitor.features_long(rows, "snap", "late"), "value", "late", ("feature",)), 2).select("feature", "ks", "n_a", "n_b"))


def queue(spark, d):
    users = role(spark, d, "users").select("user_id", F.concat(F.lower("name"), F.lit("@example.com")).alias("email"))
    return monitor.review_queue(decided(spark, d), users).select("order_id", "score", "email")


def resolved(spark, d):
    return monitor.resolve_reviews(with_time(spark, d), role(spark, d, "truth"), A - 30 * DAY, n=None).select("order_id", "resolution")


def latencies(spark, d):
    return monitor.latency(role(spark, d, "events"), "pence", "ts_us", DAY)


RULE_SQL = """SELECT rule, count(*) AS fires, round(avg(coalesce(is_fraud, false)::INT), 6) AS precision, round(avg(coalesce(is_fraud, false)::INT), 6) < 0.5 AS flagged
    FROM (SELECT order_id, unnest(rules) AS rule FROM dd) LEFT JOIN t USING (order_id) GROUP BY rule"""

KS_SQL = """WITH e AS (SELECT {by} AS f, {v} AS v, {g} AS g FROM {src}),
    q AS (SELECT f, v, (count(*) FILTER (WHERE g = 0))::DOUBLE AS a, (count(*) FILTER (WHERE g = 1))::DOUBLE AS b FROM e
    GROUP BY ALL),
z AS (SELECT f, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY f) - sum(b) OVER w / sum(b) OVER (PARTITION BY f)) AS gap, a, b
    FROM q WINDOW w AS (PARTITION BY f ORDER BY v)),
m AS (SELECT f, max(gap) AS ks, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sqrt(sum(a) * sum(b) / (sum(a) + sum(b))) AS en
    FROM z GROUP BY f), tt AS (SELECT *, (en + 0.12 + 0.11 / en) * ks AS tv FROM m),
pv AS (SELECT *, CASE WHEN tv < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 21), lambda k: exp(-2.0 * k * k * tv * tv) * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)))) END AS p
    FROM tt)"""


# --- detectors ----------------------------------------------------------------------------------------------------


def stolen(spark, d):
    o = orders(spark, d)
    rows = o.select("order_id", (c("order_id") % 3 == 0).alias("avs_mismatch"), F.when(c("order_id") % 7 != 0, c("order_id") % 4 == 0).alias("cvv_mismatch"), (c("user_id") % 5 == 0).alias("foreign_card"), (c("user_id") % 9 == 0).alias("prepaid_card"),
                    (c("address_id") % 8 == 0).alias("commercial_address"), x.is_night(us("placed_us")).alias("is_night"), (c("total_pence") >= 6500).alias("high_value"))
    return detect.stolen_card(rows).select("order_id", "score", "flag")


def takeovers(spark, d):
    place = role(spark, d, "contexts").select("order_id", "ip_country")
    return detect.takeover(orders(spark, d).join(place, "order_id"), 5).select("order_id", "user_id", "earlier", "new_device_id", "new_ip_country", "new_address_id", "flag")


E_MAX = "coalesce(max(CASE WHEN {} THEN {} END), 0.0)"
QUERIES = {
    "X1_X2_distances": (distances, """SELECT order_id, round(CASE WHEN lat IS NULL THEN 0.0 ELSE (2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(50 + (user_id % 90)::DOUBLE / 30 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(50 + (user_id % 90)::DOUBLE / 30)) * pow(sin(radians(-1.5 - lon) / 2), 2))))) END, 4) AS km
        FROM o LEFT JOIN (SELECT store_id, lat, lon FROM s) USING (store_id)"""),
    "X4_X6_X7_fees": (fees, """WITH f AS (SELECT order_id, total_pence, CASE WHEN order_type = 'DELIVERY' THEN greatest(250, least(499, 250 + least(249, floor((order_id % 200)::DOUBLE / 8 * 20)))) ELSE 0 END::BIGINT AS delivery, least(250, floor(total_pence % 5000 / 10))::BIGINT AS service, total_pence - 10000000 AS v
        FROM o)
        SELECT order_id, delivery, service, total_pence + 7 + delivery + service + 50 - 100 AS total, CASE WHEN v < 0 THEN '-' ELSE '' END || '£' || (abs(v) // 100) || '.' || lpad((abs(v) % 100)::VARCHAR, 2, '0') AS text
        FROM f"""),
    "X3_X13_money": (money, "SELECT p_partkey, round(p_retailprice * 1000 / 10)::BIGINT AS pence, round_even(p_size / 2, 0)::BIGINT AS even FROM part"),
    "X10_X11_X16_emails": (emails, """WITH e AS (SELECT user_id, city, CASE WHEN user_id % 7 = 0 THEN 'nobody' ELSE lower(name) || CASE WHEN user_id % 5 = 0 THEN '@Mailinator.com' ELSE '@example.com' END END AS email
        FROM u), g AS (SELECT *, CASE WHEN contains(email, '@') THEN lower(split_part(email, '@', 2)) ELSE 'unknown' END AS domain
        FROM e)
        SELECT user_id, domain, domain IN ('mailinator.com', 'guerrillamail.com', 'tempmail.io', 'throwawaymail.com', '10minutemail.com', 'mailsac.com') AS disposable, substr(email, 1, 2) || '***@' || domain AS masked, CASE WHEN user_id % 3 = 0 THEN NULL ELSE city::BIGINT END AS pence
        FROM g"""),
    "X21_countries": (countries, "SELECT CASE user_id % 4 WHEN 1 THEN 'FR' WHEN 2 THEN 'DE' ELSE 'GB' END AS country, count(*) AS users FROM u GROUP BY 1"),
    "X12_X17_X18_X23_X26_times": (times, f"""WITH f AS (SELECT *, make_timestamp(placed_us) AS ts, (make_timestamp(placed_us) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' AS l FROM o)
        SELECT order_id, isoyear(ts)::VARCHAR || '_' || lpad(week(ts)::VARCHAR, 2, '0') AS week, hour(l)::INT AS hour, hour(l) BETWEEN 2 AND 5 AS night, placed_us // 1000000 // 600 * 600 AS bucket, CASE WHEN terminal_us IS NULL THEN 0 ELSE greatest(0, floor(({A} - terminal_us) / {DAY}))::BIGINT END AS days, l::DATE::VARCHAR IN {HOLIDAYS} AS holiday FROM f"""),
    "X24_X27_flags": (flags, """SELECT order_id, coalesce(starts_with(promo_code, 'WELCOME'), false) AS welcome, CASE WHEN order_id % 4 = 0 THEN 'USER' WHEN status = 'PREPARING' THEN 'MERCHANT' WHEN status = 'READY' AND order_type = 'PICKUP' THEN 'USER' END AS cancelled_by
        FROM o"""),
    "X22_X28_store_types": (store_types, """SELECT store_id, array_to_string(list_filter([CASE WHEN accepts_delivery THEN 'DELIVERY' END, CASE WHEN accepts_pickup THEN 'PICKUP' END, CASE WHEN accepts_in_store THEN 'IN_STORE' END], lambda v: v IS NOT NULL), ',') AS kinds, store_id % 2 = 0 AS ios, store_id % 3 = 0 AS android
        FROM s"""),
    "X19_X25_json": (json_fields, "SELECT event_type, max(cast(json_extract_string(props, '$.k') AS BIGINT)) AS k, min('{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}') AS payload, count(CASE WHEN event_id % 5 <> 0 THEN value END) AS finite FROM events GROUP BY event_type"),
    "X20_arrays": (arrays, """SELECT user_id, (count(DISTINCT status) + 1)::INT AS n, bool_or(status = 'PLACED') AS placed, array_to_string(list_append(list_sort(list(DISTINCT status)), 'NEW'), ',') AS all
        FROM o GROUP BY user_id""".replace(" AS all", ' AS "all"')),
    **{f"V{i}_V7_V8_V9_{e}_velocity": stream_velocity(e) for i, e in enumerate(("user", "device", "payment", "ip", "store", "address"), 1)},
    "V10_dedup": (repeats, "SELECT count(*) AS orders FROM ev"),
    "V13_quarantine": (quarantine, "SELECT event_id % 50 = 0 OR event_id % 70 = 0 OR event_id % 30 = 0 AS bad, count(*) AS n FROM ev GROUP BY 1"),
    "V14_tumbling": (tumbling, "SELECT ts_us // 300000000 * 300000000 AS start_us, store, count(*) AS count FROM ev GROUP BY ALL"),
    "V15_sliding": (sliding, "SELECT (ts_us // 1200000000 - k) * 1200000000 AS start_us, count(*) AS \"rows\", quantile_disc(pence, 0.99) AS p99 FROM ev, (VALUES (0), (1), (2)) v(k) GROUP BY 1"),
    "J14_G1_G5_vectors": (vectors, vectors_sql()),
    "L1_L2_L6_outcomes": (outcome_labels, f"""WITH f AS (SELECT o.*, CASE WHEN cb.category = 'FRAUD' THEN 'FRAUD' WHEN cb.category IS NOT NULL THEN 'OTHER' END AS category, CASE WHEN cb.category = 'FRAUD' THEN 'CHARGEBACK' WHEN cb.category IS NOT NULL THEN 'LEGIT' END AS oc, rf.order_id IS NOT NULL AS rfd FROM o LEFT JOIN cb USING (order_id) LEFT JOIN rf USING (order_id)),
        g AS (SELECT order_id, category, CASE WHEN status = 'DELIVERED' AND terminal_us < {A - 60 * DAY} AND oc IS NULL THEN CASE WHEN rfd THEN 'REFUND_ABUSE' ELSE 'LEGIT' END ELSE oc END AS outcome FROM f)
        SELECT *, coalesce(category = 'FRAUD', false) OR coalesce(outcome IN ('FRAUD', 'CHARGEBACK', 'REFUND_ABUSE', 'PROMO_ABUSE'), false) AS is_bad
        FROM g"""),
    "L4_candidates": (lambda spark, d: labels.chargeback_candidates(orders(spark, d), chargebacks(spark, d), A, 365).select("order_id"), f"SELECT order_id FROM o WHERE status = 'DELIVERED' AND terminal_us >= {A - 365 * DAY} AND order_id NOT IN (SELECT order_id FROM cb)"),
    "L5_J8_truth_labels": (truth_labels, "SELECT order_id, coalesce(is_fraud, false) AS is_fraud, coalesce(category, 'LEGIT') AS fraud_category FROM o LEFT JOIN t USING (order_id)"),
    "L7_chargeback_audit": (audit_rates, f"""WITH f AS (SELECT coalesce(t.category, 'LEGIT') AS fraud_category, count(*) AS orders, count(received_us) AS chargebacks, round(avg((received_us - placed_us) / {DAY}), 4) AS delay_days FROM o LEFT JOIN t USING (order_id) LEFT JOIN cb USING (order_id) GROUP BY 1)
        SELECT f.*, e.r::DOUBLE AS expected_rate, round(chargebacks / orders, 6) AS observed_rate, round(round(chargebacks / orders, 6) - e.r::DOUBLE, 6) AS difference FROM f LEFT JOIN (VALUES ('stolen_card', 0.6), ('account_takeover', 0.3), ('promo_abuse', 0.1), ('LEGIT', 0.002)) e(c, r) ON e.c = f.fraud_category"""),
    "L8_J13_A21_archive": (archive_moves, f"""WITH g AS (SELECT order_id, coalesce(status IN ('DELIVERED', 'CANCELLED', 'REFUNDED', 'FAILED') AND terminal_us < {A} - 172800000000, false) AS gone FROM o), e AS (SELECT 'orders' AS name, order_id, gone FROM g UNION ALL SELECT 'items', it.order_id, coalesce(gone, false) FROM it LEFT JOIN g USING (order_id) UNION ALL SELECT 'log', lg.order_id, coalesce(gone, false) FROM lg LEFT JOIN g USING (order_id)),
        sides AS (SELECT side, name FROM (VALUES ('cold'), ('hot')) a(side), (VALUES ('orders'), ('items'), ('log')) b(name)) SELECT side, name, count(order_id) AS n, sum(order_id)::BIGINT AS ids FROM sides LEFT JOIN (SELECT *, CASE WHEN gone THEN 'cold' ELSE 'hot' END AS side FROM e) USING (side, name) GROUP BY side, name"""),
    "L9_status_times": (lambda spark, d: labels.status_times(log(spark, d)), "SELECT order_id, " + ", ".join(f"min(CASE WHEN event_type = '{s}' THEN at_us END) AS {s.lower()}_us" for s in ("ACCEPTED", "READY", "PICKED_UP", "DELIVERED", "CANCELLED")) + ", min(CASE WHEN event_type IN ('DELIVERED', 'CANCELLED', 'REFUNDED', 'FAILED') THEN at_us END) AS terminal_us FROM lg GROUP BY order_id"),
    "L10_A13_current_state": (lambda spark, d: labels.current_state(log(spark, d), A), f"SELECT order_id, max({{'a': at_us, 'e': event_type}}).e AS state, floor(({A} - max(at_us)) / 60000000)::BIGINT AS minutes FROM lg GROUP BY order_id"),
    "L10_stage_durations": (lambda spark, d: labels.stage_durations(log(spark, d)).select("order_id", "event_type", "at_us", "seconds"), "SELECT order_id, event_type, at_us, (lead(at_us) OVER (PARTITION BY order_id ORDER BY at_us, event_type) - at_us) // 1000000 AS seconds FROM lg"),
    "L11_W13_transitions": (bad_transitions, """WITH f AS (SELECT *, lag(event_type) OVER (PARTITION BY order_id ORDER BY at_us, event_type) AS previous FROM lg)
        SELECT order_id, previous, event_type, at_us FROM f
        WHERE (previous IS NOT NULL OR event_type <> 'PLACED') AND NOT EXISTS (SELECT 1 FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in labels.TRANSITIONS) + ") v(a, b) WHERE a = previous AND b = event_type)"),
    "L11_chain_gaps": (gaps, """WITH g AS (SELECT order_id, list(DISTINCT event_type) AS seen FROM lg GROUP BY order_id),
        m AS (SELECT order_id, list_sort(list_filter(['PLACED', 'ACCEPTED', 'PREPARING', 'READY', 'PICKED_UP', 'IN_TRANSIT', 'DELIVERED'], lambda v: NOT list_contains(seen, v))) AS l
        FROM g WHERE list_contains(seen, 'DELIVERED')) SELECT order_id, array_to_string(l, ',') AS missing FROM m WHERE len(l) > 0"""),
    "L12_prune": (pruned, f"""SELECT order_id % 10 AS k, count(*) AS items FROM it WHERE order_id NOT IN (SELECT order_id FROM o WHERE placed_us >= {A - 900 * DAY} AND placed_us < {A - 600 * DAY}) GROUP BY 1"""),
    "L13_orphans": (orphaned, "SELECT order_id, count(*) AS items FROM it WHERE order_id NOT IN (SELECT order_id FROM o WHERE status <> 'FAILED') GROUP BY order_id"),
    "L13_reconcile": (reconciled, """WITH k AS (SELECT order_id, sum(quantity * unit_pence)::BIGINT AS st, sum(CASE WHEN is_hot THEN round((quantity * unit_pence)::DECIMAL(20,2) * 0.2) ELSE 0 END)::BIGINT AS vat
        FROM it GROUP BY order_id) SELECT order_id, total_pence - st - vat AS difference FROM o JOIN k USING (order_id)
        WHERE total_pence <> st + vat"""),
    "L14_X5_cart": (carts, """SELECT order_id, sum(quantity * unit_pence)::BIGINT AS subtotal, sum(quantity)::BIGINT AS item_count, count(DISTINCT item_id) AS unique_items, sum(CASE WHEN is_hot THEN round((quantity * unit_pence)::DECIMAL(20,2) * 0.2) ELSE 0 END)::BIGINT AS vat
        FROM it GROUP BY order_id"""),
    "P1_P9_prepared": (prepared, """WITH q AS (SELECT quantile_cont(placed_us, 0.8) AS a, quantile_cont(placed_us, 0.9) AS b FROM o),
        sp AS (SELECT o.*, ln(1 + total_pence::DOUBLE) AS lt, CASE WHEN placed_us < a THEN 'train' WHEN placed_us < b THEN 'val' ELSE 'test' END AS split
        FROM o, q),
st AS (SELECT avg(lt) AS m, stddev_pop(lt) AS sd, avg(city) AS cm, stddev_pop(city) AS cs FROM sp WHERE split = 'train'),
        vd AS (SELECT domain, row_number() OVER (ORDER BY count(*) DESC, domain) - 1 AS i FROM sp WHERE split = 'train'
        GROUP BY domain), vs AS (SELECT status, row_number() OVER (ORDER BY count(*) DESC, status) - 1 AS i FROM sp
        WHERE split = 'train' GROUP BY status)
        SELECT order_id, split, round((lt - m) / sd, 5) AS total_z, round((city - cm) / cs, 5) AS city_z, least(coalesce(vd.i, 4), 4)::INT AS domain, least(coalesce(vs.i, 4), 4)::INT AS status, CASE WHEN order_id % 4 = 0 THEN 1 ELSE 0 END AS is_night
        FROM sp LEFT JOIN vd ON vd.domain = sp.domain LEFT JOIN vs ON vs.status = sp.status, st"""),
    "P8_velocity_ratio": (ratio, """SELECT order_id, round(count(*) OVER (PARTITION BY user_id
        ORDER BY placed_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) / (count(*) OVER (PARTITION BY user_id
        ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1), 6) AS velocity_ratio FROM o"""),
    "Q1_Q6_T6_scan": (scanned, """WITH r AS (SELECT d.*, l.toxic, CASE WHEN l.toxic = 1 THEN 'bad' END AS leaky, d.doc_id % 3 AS three FROM documents d
        JOIN labels l USING (doc_id)),
        st AS (SELECT quantile_cont(n_chars, 0.5) AS n50, quantile_cont(n_chars, 0.95) AS n95, quantile_cont(doc_id, 0.5) AS d50, avg(toxic) AS rate
        FROM r),
lk AS (SELECT c, v, count(*) AS n, min(toxic) AS lo FROM (SELECT 'lang' AS c, coalesce(lang, '__NULL__') AS v, toxic FROM r
        UNION ALL SELECT 'source', coalesce(source, '__NULL__'), toxic FROM r UNION ALL SELECT 'fixed', 'same', toxic FROM r
        UNION ALL SELECT 'leaky', coalesce(leaky, '__NULL__'), toxic FROM r) GROUP BY ALL)
        SELECT 'n_chars' AS "column", 'critical' AS severity, 'profile' AS check_name, 'p50' AS metric FROM st
        WHERE n50 IS NULL OR n50 > 500 UNION ALL SELECT 'n_chars', 'critical', 'profile', 'p95' FROM st
        WHERE n95 IS NULL OR n95 > 1e9 UNION ALL SELECT 'doc_id', 'critical', 'profile', 'p50' FROM st
        WHERE d50 IS NULL OR d50 < 1e6 OR d50 > 2e6
        UNION ALL SELECT 'nothing', 'critical', 'missing_column', 'present' UNION ALL SELECT 'toxic', 'critical', 'label_rate', 'mean'
        FROM st WHERE rate < 0.5 OR rate > 0.9 UNION ALL SELECT 'three', 'suggestive', 'narrow_numeric', 'distinct'
        FROM (SELECT count(DISTINCT three) AS n FROM r) WHERE n BETWEEN 2 AND 4 UNION ALL
        SELECT 'fixed', 'fyi', 'constant', 'distinct'
        UNION ALL SELECT c, 'critical', 'leak', 'value=' || v FROM lk WHERE n >= 10 AND lo = 1"""),
    "W12_E8_curves": (curve, f"WITH {CURVE} SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(prec, 6) AS precision, round(rec, 6) AS recall, round(fp / neg, 6) AS fpr FROM r"),
    "E1_E4_summary": (lambda spark, d: rounded(evaluate.summary(scored(spark, d))), f"""WITH {CURVE} SELECT round(sum(p / pos * prec), 6) AS auprc, round(sum(n * (tp - p + p / 2)) / max(pos * neg), 6) AS auroc, round({E_MAX.format('rec >= 0.95', 'prec')}, 6) AS precision_at_recall_95, round({E_MAX.format('prec >= 0.99', 'rec')}, 6) AS recall_at_precision_99, (SELECT round(avg((score - y) * (score - y)), 6) FROM y) AS brier FROM r"""),
    "E5_confusion": (confusion, """SELECT th::DOUBLE AS threshold, count(CASE WHEN y = 0 AND score < th THEN 1 END) AS tn, count(CASE WHEN y = 0 AND score >= th THEN 1 END) AS fp, count(CASE WHEN y = 1 AND score < th THEN 1 END) AS fn, count(CASE WHEN y = 1 AND score >= th THEN 1 END) AS tp
        FROM y, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.85::DOUBLE)) v(th) GROUP BY th"""),
    "E6_category_recall": (lambda spark, d: rounded(evaluate.category_recall(scored(spark, d))), "SELECT category, round(avg((score >= 0.5)::INT), 6) AS recall FROM y WHERE y = 1 GROUP BY category"),
    "E7_O2_histogram": (lambda spark, d: evaluate.histogram(scored(spark, d)), "SELECT y, least(floor(score * 20), 19)::INT AS bin, count(*) AS count FROM y GROUP BY ALL"),
    "E9_calibration": (lambda spark, d: rounded(evaluate.calibration(scored(spark, d))), 'SELECT least(floor(score * 10), 9)::INT AS bin, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS mean_label, count(*) AS "rows" FROM y GROUP BY 1'),
    "E10_R4_ensemble": (ensemble, "SELECT row_id, round(0.6::DOUBLE * score + 0.4::DOUBLE * score_b, 6) AS score FROM sc"),
    "E11_best_weights": (lambda spark, d: evaluate.best_weights(scored(spark, d)).select("wa", "wb", F.round("auprc", 6).alias("auprc"), "best"), """WITH m AS (SELECT i, wa, wb, y, round(wa * score + wb * score_b, 9) AS s
        FROM y, (VALUES (0, 0.3::DOUBLE, 0.7::DOUBLE), (1, 0.4::DOUBLE, 0.6::DOUBLE), (2, 0.5::DOUBLE, 0.5::DOUBLE), (3, 0.6::DOUBLE, 0.4::DOUBLE), (4, 0.7::DOUBLE, 0.3::DOUBLE)) v(i, wa, wb)),
g AS (SELECT i, wa, wb, s, sum(y) AS p, count(*) AS n FROM m GROUP BY ALL),
        k AS (SELECT *, sum(p) OVER w / sum(n) OVER w AS prec, sum(p) OVER (PARTITION BY i) AS pos FROM g
        WINDOW w AS (PARTITION BY i ORDER BY s DESC)), ap AS (SELECT i, wa, wb, round(sum(p / pos * prec), 9) AS a FROM k
        GROUP BY ALL) SELECT wa, wb, round(a, 6) AS auprc, row_number() OVER (ORDER BY a DESC, i) = 1 AS best FROM ap"""),
    "E12_promotion_gate": (gate, """WITH p AS (SELECT 'recall_' || category AS metric, avg(score_b) AS production, avg(score) AS cand FROM y GROUP BY category)
        SELECT metric, round(production, 6) AS production, CASE WHEN metric <> 'recall_de' THEN round(cand, 6) END AS candidate, round(production * 0.9, 6) AS needed, CASE WHEN metric = 'recall_de' THEN false ELSE cand >= production * 0.9 END AS passes
        FROM p"""),
    "E13_deltas": (deltas, """WITH f AS (SELECT avg(score) AS a, avg(score_b) AS b, max(score) AS m, max(score_b) AS n FROM y)
        SELECT 'auprc' AS metric, round(a, 6) AS candidate, round(b, 6) AS production, round(a - b, 6) AS delta FROM f UNION ALL
        SELECT 'auroc', round(m, 6), round(n, 6), round(m - n, 6) FROM f"""),
    "R1_R3_decisions": (decisions, f"""WITH {CTX}
        SELECT order_id, array_to_string(rules, ',') AS rules, CASE WHEN declined THEN 'DECLINE' WHEN len(rules) > 0 THEN 'REVIEW' ELSE 'PASS' END AS action, score::DOUBLE AS score, CASE WHEN declined THEN 'rules_only' ELSE 'ensemble' END AS model_version, decision
        FROM dd"""),
    "R5_S17_audit": (audited, f"""WITH {CTX} SELECT order_id, decision, '{{\"total_pence\":' || dd.total_pence || ',\"user_orders_1h\":' || n24 || '}}' AS features_snapshot, CASE WHEN decision = 'DECLINE' THEN 'REJECTED' END AS new_status FROM dd JOIN (SELECT order_id, n24
        FROM h) USING (order_id)"""),
    "R6_rule_precision": (lambda spark, d: score.rule_precision(decided(spark, d), role(spark, d, "truth")), f"WITH {CTX} {RULE_SQL}"),
    "O1_J20_live_metrics": (live, f"""WITH {CTX} SELECT placed_us // {90 * DAY} AS period, count(*) AS orders, round(count(CASE WHEN is_fraud AND decision = 'DECLINE' THEN 1 END) / nullif(count(CASE WHEN decision = 'DECLINE' THEN 1 END), 0), 6) AS decline_precision, round(count(CASE WHEN is_fraud AND decision = 'REVIEW' THEN 1 END) / nullif(count(CASE WHEN decision = 'REVIEW' THEN 1 END), 0), 6) AS review_precision, round(count(CASE WHEN is_fraud AND decision = 'DECLINE' THEN 1 END) / nullif(count(CASE WHEN is_fraud THEN 1 END), 0), 6) AS recall
        FROM dd JOIN t USING (order_id) GROUP BY 1"""),
    "O3_drift": (drift, KS_SQL.format(by="store", v="pence", g="CASE WHEN ts_us >= 1705363200000000 THEN 1 ELSE 0 END", src="ev") + " SELECT f AS store, round(ks, 6) AS ks, n_a, n_b, round(p, 6) AS p_value, CASE WHEN p < 0.001 THEN 'ALERT' WHEN p < 0.01 THEN 'WARNING' ELSE 'OK' END AS status FROM pv"),
    "O4_T9_snapshot_drift": (snapshot_drift, KS_SQL.format(by="f0", v="v0", g="g0", src="""(SELECT 'a' AS f0, total_pence % 1000 AS v0, order_id % 2 AS g0 FROM o UNION ALL SELECT 'b', order_id % 97, order_id % 2 FROM o
        UNION ALL SELECT 'c', order_id % 7 + CASE WHEN order_id % 2 = 0 THEN 3 ELSE 0 END, order_id % 2 FROM o)""") + " SELECT f AS feature, round(ks, 6) AS ks, n_a, n_b FROM pv ORDER BY pv.ks DESC, f LIMIT 2"),
    "O6_resolutions": (resolved, f"""WITH {CTX} SELECT order_id, CASE WHEN is_fraud THEN 'FRAUD' ELSE 'LEGIT' END AS resolution FROM dd LEFT JOIN t USING (order_id)
        WHERE decision = 'REVIEW' AND placed_us < {A - 31 * DAY}"""),
    "O7_latency": (latencies, f"SELECT ts_us // {DAY} AS period, quantile_cont(pence, 0.5) AS p50, quantile_cont(pence, 0.95) AS p95, quantile_cont(pence, 0.99) AS p99 FROM ev GROUP BY 1"),
    "T8_review_queue": (queue, f"""WITH {CTX} SELECT order_id, score::DOUBLE AS score, substr(lower(name), 1, 2) || '***@example.com' AS email FROM dd JOIN u USING (user_id)
        WHERE decision = 'REVIEW' ORDER BY dd.score DESC, order_id LIMIT 20"""),
    "D1_stolen_card": (stolen, """WITH f AS (SELECT order_id, round(CASE WHEN order_id % 3 = 0 THEN 0.25 ELSE 0 END + CASE WHEN order_id % 7 <> 0 AND order_id % 4 = 0 THEN 0.25 ELSE 0 END + CASE WHEN user_id % 5 = 0 THEN 0.15 ELSE 0 END + CASE WHEN user_id % 9 = 0 THEN 0.1 ELSE 0 END + CASE WHEN address_id % 8 = 0 THEN 0.1 ELSE 0 END
+ CASE WHEN hour((make_timestamp(placed_us) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London') BETWEEN 2 AND 5 THEN 0.1 ELSE 0 END + CASE WHEN total_pence >= 6500 THEN 0.05 ELSE 0 END, 4)::DOUBLE AS score
        FROM o) SELECT *, score >= 0.5 AS flag FROM f"""),
    "D2_takeover": (takeovers, """WITH r AS (SELECT o.*, cx.ip_country FROM o JOIN cx USING (order_id) WHERE device_id IS NOT NULL AND cx.ip_country IS NOT NULL AND address_id IS NOT NULL),
        f AS (SELECT order_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
                     count(*) OVER (PARTITION BY user_id, device_id ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
                     count(*) OVER (PARTITION BY user_id, ip_country ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
                     count(*) OVER (PARTITION BY user_id, address_id ORDER BY placed_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM r)
        SELECT order_id, user_id, earlier, a = 0 AS new_device_id, b = 0 AS new_ip_country, c = 0 AS new_address_id, earlier >= 5 AND a = 0 AND b = 0 AND c = 0 AS flag FROM f"""),
    "D3_promo_rings": (lambda spark, d: detect.promo_rings(orders(spark, d)), """SELECT device_id, promo_code, count(DISTINCT user_id) AS users, count(DISTINCT ip) AS ips, count(DISTINCT payment_id) AS payments, count(*) AS orders, count(DISTINCT user_id) >= 5 AS flag
        FROM o WHERE promo_code IS NOT NULL AND device_id IS NOT NULL GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY device_id, promo_code")),
    "D4_refund_abuse": (lambda spark, d: detect.refund_abuse(orders(spark, d), refunds(spark, d)), """WITH e AS (SELECT user_id, greatest(refunded_us, placed_us) AS tm FROM rf JOIN o USING (order_id)),
        g AS (SELECT o.order_id, o.user_id, count(e.tm) AS n FROM o LEFT JOIN e ON e.user_id = o.user_id AND e.tm < o.placed_us
        GROUP BY ALL) SELECT order_id, user_id, n AS refunds_before, n >= 3 AS flag FROM g"""),
    "D5_collusive_stores": (lambda spark, d: rounded(detect.collusive_stores(orders(spark, d))), """WITH g AS (SELECT city, store_id, count(*) AS orders, count(DISTINCT payment_id) AS cards, count(DISTINCT payment_id) / count(*) AS share
        FROM o GROUP BY city, store_id),
        z AS (SELECT *, avg(share) OVER (PARTITION BY city) AS m, stddev_pop(share) OVER (PARTITION BY city) AS sd FROM g),
        w AS (SELECT *, CASE WHEN sd > 0 THEN round((share - m) / sd, 6) ELSE 0.0 END AS z FROM z)
        SELECT city, store_id, orders, cards, round(share, 6) AS share, w.z AS z, w.z >= 2 AS flag FROM w"""),
    "D6_triangulation": (lambda spark, d: detect.triangulation(orders(spark, d), 2), """SELECT user_id, device_id, count(*) AS orders, count(DISTINCT payment_id) AS cards, count(DISTINCT address_id) AS addresses, count(*) >= 2 AND count(DISTINCT payment_id) >= 0.9 * count(*) AND count(DISTINCT address_id) >= 0.9 * count(*) AS flag
        FROM o WHERE device_id IS NOT NULL GROUP BY user_id, device_id"""),
    "D7_resellers": (lambda spark, d: rounded(detect.resellers(orders(spark, d), carts(spark, d))), f"""WITH k AS (SELECT order_id, sum(quantity)::BIGINT AS items FROM it GROUP BY order_id),
        g AS (SELECT user_id, address_id, placed_us // {DAY} AS day, store_id, count(*) AS n, sum(items) AS i FROM o JOIN k USING (order_id) WHERE address_id IS NOT NULL GROUP BY ALL),
        h AS (SELECT user_id, address_id, day, sum(n)::BIGINT AS orders, sum(i)::BIGINT AS items, round(max(n)::DOUBLE / sum(n)::DOUBLE, 6) AS top_store
        FROM g GROUP BY ALL) SELECT *, items >= 10 AND orders BETWEEN 3 AND 8 AND top_store >= 0.7 AS flag FROM h"""),
}
