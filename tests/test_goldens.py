"""Known answers: windows, as-of features, splits, archival, assembly, scans, evaluation, gates, money, event logs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orderlens.functions import columns as x
from orderlens.operators import assemble, batch, contract, detect, enrich, evaluate, labels, model, monitor, prep, quality, score, training, windows

DAY = 86_400_000_000


def us(text):
    return int((datetime.fromisoformat(text) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def test_velocity_bounds_and_ties(spark):
    times = ["2026-01-01 12:00", "2026-01-01 12:30", "2026-01-01 13:30", "2026-01-02 10:00", "2026-01-02 13:30"]
    rows = spark.createDataFrame([(i, "u", us(t), 100) for i, t in enumerate(times)] + [(9, None, us(times[0]), 1)], "id long, user_id string, at long, pence long")
    got = {r["id"]: (r["orders_1h"], r["orders_24h"], r["spend_24h"]) for r in windows.velocity(rows, "user_id", "at", "pence").collect()}
    assert got == {0: (0, 0, 0), 1: (1, 1, 100), 2: (1, 2, 200), 3: (0, 3, 300), 4: (0, 2, 200), 9: (0, 0, 0)}
    tied = spark.createDataFrame([(1, "u", 5, 10), (2, "u", 5, 20)], "id long, user_id string, at long, pence long")
    assert {r["id"]: (r["orders_1h"], r["spend_24h"]) for r in windows.velocity(tied, "user_id", "at", "pence").collect()} == {1: (1, 20), 2: (1, 10)}
    assert {r["orders_1h"] for r in windows.velocity(tied, "user_id", "at", "pence", ties="strict").collect()} == {0}


def test_asof_features(spark):
    rows = [("p0", "user-a", "2026-01-01 10:00", True), ("p1", "user-b", "2026-01-01 11:00", False), ("p2", "user-c", "2026-01-01 11:00", True), ("p3", "user-d", "2026-01-02 12:30", False)]
    orders = spark.createDataFrame([(i, u, "d", "ip", "pay", us(t)) for i, u, t, _ in rows], "order_id string, user_id string, device_id string, ip string, payment_id string, placed_us long")
    back = spark.createDataFrame([(i, us(t)) for i, _, t, c in rows if c], "order_id string, received_us long")
    out = windows.distinct_before(orders, "device_id", "user_id", "placed_us", "users")
    out = windows.distinct_within(out, "ip", "user_id", "placed_us", "ip_users")
    out = windows.asof_rate(batch.event_counts(orders, back, "payment_id"), out, "payment_id", "placed_us", "rate")
    got = {r["order_id"]: (r["users"], r["ip_users"], round(r["rate"], 6)) for r in out.collect()}
    assert got == {"p0": (0, 0, 0.0), "p1": (1, 1, 1.0), "p2": (1, 1, 1.0), "p3": (3, 0, round(2 / 3, 6))}


def test_time_split(spark):
    rows = spark.createDataFrame([(i * DAY,) for i in range(10)], "placed_us long")
    got = [r["split"] for r in prep.time_split(rows).orderBy("placed_us").collect()]
    assert got == ["train"] * 8 + ["val", "test"]
    with pytest.raises(Exception, match="null times"):
        prep.time_split(rows.union(spark.createDataFrame([(None,)], "placed_us long"))).collect()


def test_model_features_are_saved_and_applied_again(spark, tmp_path):
    columns = {**{n: "1.0" for n in contract.NUMERIC}, **{t: "'x'" for t in contract.VOCABULARY}, **{h: "'h'" for h in contract.HASHED}, **{b: "true" for b in contract.BOOLEAN}, "card_issuer_country": "'GB'"}
    rows = spark.range(10).selectExpr("id as placed_us", *[f"{v} as {k}" for k, v in columns.items() if k != "total_pence"], "id * 10 as total_pence")
    plan = prep.contract_plan()
    rows = prep.prepared(prep.transformed(prep.time_split(rows), prep.model_columns), plan)
    fitted = prep.fit(rows, plan)
    prep.save(fitted, f"{tmp_path}/fitted")
    first, again = (prep.apply(rows, plan, *f).select(*contract.FEATURES).orderBy("total_pence").collect() for f in (fitted, prep.load(spark, f"{tmp_path}/fitted")))
    assert first == again and len(contract.FEATURES) == 48 and len(set(contract.FEATURES)) == 48
    assert all(0 <= r[h] < n for r in first for h, n in contract.HASHED.items())
    assert {r["card_country_mismatch"] for r in first} == {1} and {r["order_channel"] for r in first} == {0}
    with pytest.raises(ValueError, match="gives no"):
        prep.transformed(rows, lambda df: df, ("nothing",))


def test_vocabulary_and_unseen_values(spark):
    plan = prep.Plan(numeric=("n",), vocabulary=("brand",), hashed={"bin": 7}, boolean=("b",))
    rows = prep.prepared(spark.createDataFrame([("visa", "1", 1.0, True)] * 10 + [("mastercard", "2", 3.0, None)] * 10, "brand string, bin string, n double, b boolean"), plan)
    fitted = prep.fit_numeric(rows, plan), prep.fit_vocabulary(rows, plan)
    new = prep.prepared(spark.createDataFrame([("amex", "9", None, None), ("visa", "", 2.0, True)], "brand string, bin string, n double, b boolean"), plan)
    got = prep.apply(new, plan, *fitted).collect()
    assert [(r["brand"], r["b"], r["n"]) for r in got] == [(2, 0, -2.0), (1, 1, 0.0)] and all(0 <= r["bin"] < 7 for r in got)


def test_archive_keeps_every_row(spark, tmp_path):
    now = us("2026-05-01 00:00")
    rows = [(i, "DELIVERED", now - 72 * 3_600_000_000) for i in range(50)] + [(i, "DELIVERED", now - 24 * 3_600_000_000) for i in range(50, 80)] + [(i, "PLACED", None) for i in range(80, 100)]
    orders = spark.createDataFrame(rows, "order_id long, status string, terminal_us long")
    items = orders.select("order_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("item"))
    moved = labels.archive(spark, orders, {"items": items}, f"{tmp_path}/cold", f"{tmp_path}/hot", now).collect()
    assert {r["table"]: r["moved"] for r in moved} == {"orders": 50, "items": 100}
    assert spark.read.parquet(f"{tmp_path}/hot/orders").count() == 50 and spark.read.parquet(f"{tmp_path}/hot/items").count() == 100


def test_assembly_of_absent_features(spark):
    order = spark.createDataFrame([(1, 5, None, None, 3, 4, 2, "d", None)], "order_id long, user_id long, device_id long, payment_id long, ip long, store_id long, merchant_id long, domain string, address_id long")
    got = assemble.assemble(order, {}).first()
    assert got["missing_features"] == ["fs:user:5:stream", "fs:user:5:batch", "fs:ip:3:stream", "fs:ip:3:batch", "fs:store:4:stream", "fs:store:4:batch", "fs:merchant:2:batch", "fs:email_domain:d:batch"]
    assert len(assemble.contract()) == 59 and all(got[c] == 0 for c in assemble.contract())
    users = spark.createDataFrame([(5, "12", " ", "x")], "user_id long, orders string, spend string, cb_rate string")
    got = assemble.assemble(order, {("user", "batch"): assemble.named(users, "user", "batch")}).first()
    assert got["user_lifetime_order_count"] == 12 and got["user_lifetime_spend_pence"] == 0 and got["user_lifetime_chargeback_rate"] == 0.0
    assert "fs:user:5:batch:lifetime_spend_pence" in got["missing_features"] and "fs:user:5:batch" not in got["missing_features"]
    typed = spark.createDataFrame([(5, 12, None, 0.25)], "user_id long, orders long, spend long, cb_rate double")
    got = assemble.assemble(order, {("user", "batch"): assemble.named(typed, "user", "batch")}).first()
    assert (got["user_lifetime_order_count"], got["user_lifetime_spend_pence"], got["user_lifetime_chargeback_rate"]) == (12, 0, 0.25) and "fs:user:5:batch:lifetime_spend_pence" in got["missing_features"]
    assert assemble.narrow(assemble.assemble(order, {}), "ip").columns == ["ip", "ip_orders_1h", "ip_orders_24h", "ip_unique_users_24h", "ip_unique_devices_24h", "ip_lifetime_order_count", "ip_unique_users_lifetime", "ip_chargeback_rate", "ip_first_seen_days_ago"]


def test_scan_findings(spark):
    spec = spark.createDataFrame([("subtotal", "p50", 800.0, 2500.0)], "column string, metric string, low double, high double")
    rows = spark.createDataFrame([(50, "GB", i % 3 + 1, None if i < 10 else "iOS", "FRAUD_RING" if i < 10 else "London", int(i < 10)) for i in range(20)], "subtotal long, country string, age long, platform string, city string, y int")
    got = {(r["column"], r["severity"], r["check_name"], r["metric"]) for r in quality.scan(rows, "y", spec, 0.0, 1.0).collect()}
    assert got == {
        ("subtotal", "critical", "profile", "p50"), ("subtotal", "fyi", "constant", "distinct"), ("country", "fyi", "constant", "distinct"), ("age", "suggestive", "narrow_numeric", "distinct"),
        ("platform", "critical", "leak", "value=__NULL__"), ("city", "critical", "leak", "value=FRAUD_RING"),
    }
    assert quality.label_rate(rows, "y", 0.6, 0.9).count() == 1


def test_evaluation(spark):
    rows = spark.createDataFrame([(0, 0.1, 0.9), (0, 0.4, 0.2), (1, 0.35, 0.3), (1, 0.8, 0.7)], "y long, score double, score_b double")
    got = evaluate.summary(rows).first()
    assert round(got["auprc"], 6) == round(5 / 6, 6) and got["auroc"] == 0.75 and round(got["precision_at_recall_95"], 6) == round(2 / 3, 6) and got["recall_at_precision_99"] == 0.5
    assert evaluate.best_weights(rows).where("best").count() == 1
    with pytest.raises(Exception, match="one class"):
        evaluate.summary(rows.where("y = 1")).collect()
    cats = spark.createDataFrame([(1, 0.9, "a"), (1, 0.1, "a"), (1, 0.6, "b"), (0, 0.9, "c")], "y long, score double, category string")
    assert {r["category"]: r["recall"] for r in evaluate.category_recall(cats).collect()} == {"a": 0.5, "b": 1.0}
    a, b = (spark.createDataFrame(r, "id long, score double") for r in ([(1, 0.5)], [(2, 0.5)]))
    with pytest.raises(Exception, match="no partner"):
        evaluate.ensemble(a, b, "id", (0.6, 0.4)).collect()
    with pytest.raises(ValueError):
        evaluate.ensemble(a, b, "id", (0.6, 0.6))


def test_promotion_gate(spark):
    table = lambda **m: spark.createDataFrame(list(m.items()), "metric string, value double")
    good = {"auprc": 0.8, "auroc": 0.9, "brier": 0.1, "recall_stolen_card": 0.8, "recall_account_takeover": 0.7}
    evaluate.promote(table(**good), None)
    evaluate.promote(table(**good | {"auprc": 0.795, "recall_stolen_card": 0.73}), table(**good))
    for change in ({"auprc": 0.78}, {"recall_stolen_card": 0.5}):
        with pytest.raises(RuntimeError):
            evaluate.promote(table(**good | change), table(**good))
        evaluate.promote(table(**good | change), table(**good), force=True)
    with pytest.raises(RuntimeError, match="recall_account"):
        evaluate.promote(table(**{k: v for k, v in good.items() if k != "recall_account_takeover"}), table(**good))
    with pytest.raises(RuntimeError, match="no auprc"):
        evaluate.promote(table(**good), table(auroc=0.9))
    assert evaluate.deltas(table(**good), table(**good)).count() == 3
    models = spark.createDataFrame([("b", 2, None), ("a", 1, 5), ("c", 2, None)], "version string, saved_at long, promoted_at long")
    assert [(r["version"], r["current"]) for r in evaluate.versions(models).collect()] == [("a", True), ("b", False), ("c", False)]


def test_money_and_distance(spark):
    row = spark.range(1)
    one = lambda c: row.select(c).first()[0]
    assert one(x.pounds_to_pence(F.lit("12.505").cast("decimal(10,3)"))) == 1251
    assert [one(x.pence_to_text(F.lit(p))) for p in (1250, 5, -1205)] == ["£12.50", "£0.05", "-£12.05"]
    assert [one(x.vat(F.lit(p), F.lit(h))) for p, h in ((1000, True), (500, False), (5, True), (2, True))] == [200, 0, 1, 0]
    assert one(x.half_even(F.lit("100.5").cast("decimal(10,1)"))) == 100 and one(x.average(F.lit(201), F.lit(2))) == 100
    assert one(x.order_total(*map(F.lit, (1000, 200, 300, 100, 50, 150)))) == 1500
    km = lambda *p: one(x.haversine_km(*map(F.lit, p)))
    assert 1.9 < km(51.5074, -0.1278, 51.5, -0.1) < 2.3 and 3.8 < km(51.48, -0.15, 51.5, -0.1) < 4.4 and 2.1 < km(51.52, -0.11, 51.5, -0.1) < 2.6
    assert one(x.distance_or_zero(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 0.0
    assert [one(x.member_pence(F.lit(m))) for m in ("a:120", "bad", "z:abc")] == [120, None, None]
    assert one(x.rate(F.lit(1), F.lit(0))) == 0.0 and one(x.whole_days(F.lit(5 * DAY), F.lit(None).cast("long"))) == 0


def test_event_log(spark):
    chain = [(1, s, i) for i, s in enumerate(labels.CHAIN)]
    log = spark.createDataFrame(chain + [(2, "PLACED", 0), (2, "READY", 1), (3, "ACCEPTED", 0), (2, "DELIVERED", 2)], "order_id long, event_type string, at_us long")
    bad = {(r["order_id"], r["event_type"]) for r in labels.invalid_transitions(spark, windows.previous_status(log)).collect()}
    assert bad == {(2, "READY"), (3, "ACCEPTED")}
    gaps = {r["order_id"]: set(r["missing"]) for r in labels.chain_gaps(log, labels.PICKUP_CHAIN).collect()}
    assert gaps == {2: {"ACCEPTED", "PREPARING"}}


def test_training_arguments_and_contract(spark):
    with pytest.raises(ValueError):
        training.check_arguments(5, 5, 45, 0)
    with pytest.raises(ValueError):
        training.check_arguments(1, 5, -1, 0)
    with pytest.raises(RuntimeError, match="missing columns"):
        training.require(spark.range(1))
    assert training.filled(spark.createDataFrame([(None, None, None)], "a long, b string, c boolean")).first() == (0, "UNKNOWN", False)


def test_batch_driver_tells_all_failures():
    done = []

    def fail():
        raise KeyError("x")

    with pytest.raises(RuntimeError, match="a: .*c: "):
        batch.run_all({"a": fail, "b": lambda: done.append(1), "c": fail})
    assert done == [1]


def test_models_learn(spark):
    rows = spark.createDataFrame([(float(i % 17), float(i % 5), int(i % 17 > 12)) for i in range(600)], "a double, b double, y int")
    ready = prep.assembled(rows, ["a", "b"]).select("features", "y")
    trees = model.train_trees(ready, ready, rounds=4, depth=3)
    assert evaluate.summary(model.score(trees, ready)).first()["auprc"] > 0.99
    assert model.importances(trees, ["a", "b"]).first()["feature"] == "a"
    network = model.train_network(ready, 2, hidden=(8,), rounds=60)
    assert evaluate.summary(model.score(network, ready)).first()["auroc"] > 0.9
    split = prep.time_split(rows.withColumn("placed_us", F.monotonically_increasing_id()))
    got = {r["run"]: r["delta"] for r in model.ablation(*[split.where(F.col("split") == s) for s in ("train", "val", "test")], ["a", "b"], ["a"], rounds=3).collect()}
    assert got["baseline"] == 0 and got["without"] < 0
    with pytest.raises(ValueError):
        prep.without(["a"], ["z"])


def test_rules_and_registry(spark):
    row = spark.createDataFrame([(1, 11, 0, "9", None, 5, 100, False, False, False, 0, 0.0, "GB", 0.1), (2, 0, 0, "3", False, 5, 100, False, False, False, 0, 0.0, "GB", 0.1)],
        "order_id long, user_orders_1h long, device_orders_1h long, card_bin string, ip_is_tor boolean, account_age_days long, total_pence long, disposable_email boolean, new_payment boolean, new_address boolean, chargeback_count long, ip_km double, ip_country string, score double")
    got = {r["order_id"]: (r["rules_triggered"], r["decision"], r["score"]) for r in score.decide(score.with_rules(row, score.rules(("3",)))).collect()}
    assert got == {1: (["user_velocity"], "REVIEW", 0.1), 2: (["bin_blocklist"], "DECLINE", 1.0)}
    registry = {}
    score.register(registry, "a", 1, None)
    for name, weight in (("a", 1), ("b", 0)):
        with pytest.raises(ValueError):
            score.register(registry, name, weight, None)


def test_drift_of_equal_and_shifted_samples(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), (F.col("id") % 100).alias("v"), F.lit("same").alias("f"))
    moved = rows.withColumn("v", F.col("v") + F.col("g") * 40).withColumn("f", F.lit("moved"))
    got = {r["f"]: r["status"] for r in monitor.ks(rows.unionByName(moved), "v", "g", ("f",)).collect()}
    assert got == {"same": "OK", "moved": "ALERT"}
    assert monitor.reference_sample(rows.withColumn("k", F.monotonically_increasing_id()), "k", 10).count() == 10


def test_open_hours_and_weighted_pick(spark):
    hours = spark.createDataFrame([(1, 4, 80_000, 300), (2, 4, 50, 200)], "store_id long, weekday int, open_s long, close_s long")  # 4: Thursday
    times = [(1, 2, "2026-01-01 00:03:20"), (2, 1, "2026-01-01 22:30"), (3, 1, "2026-01-02 00:05"), (4, 1, "2026-01-02 22:30"), (5, 1, "2026-01-01 00:02"), (6, 2, "2026-01-01 00:03:21"), (7, 1, "2026-01-02 00:05:01"), (8, 1, "2026-07-02 22:00")]
    rows = spark.createDataFrame([(i, store, us(t)) for i, store, t in times], "id long, store_id long, at long")
    assert [r["id"] for r in enrich.while_open(rows, hours, "at").orderBy("id").collect()] == [1, 2, 3, 8]
    drivers = spark.createDataFrame([(1, i, i) for i in range(20)], "city long, driver long, w long")
    assert enrich.one_of_many(drivers, "city", "w").collect() == enrich.one_of_many(drivers.repartition(3), "city", "w").collect()


def test_takeover_goes_by_ip_country(spark):
    day = 86_400_000_000
    rows = [(i, "u", "d", "GB", "a", i * day) for i in range(10)] + [(10, "u", "new", "FR", "b", 10 * day), (11, "u", "new2", "GB", "c", 11 * day), (12, "u", "new3", None, "e", 12 * day), (13, "v", "x", "FR", "y", day)]
    got = detect.takeover(spark.createDataFrame(rows, "order_id int, user_id string, device_id string, ip_country string, address_id string, placed_us long"))
    assert {r["order_id"] for r in got.where("flag").collect()} == {10} and got.count() == 13


def test_orders_without_exactly_one_decision(spark):
    orders = spark.createDataFrame([(1,), (2,), (3,)], "order_id long")
    decisions = spark.createDataFrame([(1,), (2,), (2,), (9,)], "order_id long")
    got = {r["order_id"]: (r["decisions"], r["known"]) for r in labels.undecided(orders, decisions).collect()}
    assert got == {2: (2, True), 3: (0, True), 9: (1, False)}
