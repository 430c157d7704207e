"""Features in event-time order, late orders, and decisions that are made once."""

import pytest
from pyspark.sql import functions as F

from orderlens.streaming import decisions, ordered
from orderlens.streaming import velocity as v

START = 1_767_225_600


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def order(i, s, **own):
    row = dict(order_id=str(i), user_id=f"u{i % 3}", store_id=f"s{i % 2}", device_id=f"d{i % 4}" if i % 5 else None, payment_id=f"p{(i * 7) % 5}", address_id=None, ip=f"ip{i % 2}", total_pence=str(10 + i), status="DECLINED" if i % 6 == 0 else "PLACED")
    return row | dict(at=START + s) | own


def table(spark, orders):
    names = [x.split()[0] for x in v.ORDER.split(", ")][:-1]
    rows = spark.createDataFrame([tuple(o[n] for n in names) + (o["at"],) for o in orders], v.ORDER.replace("placed_at string", "at long"))
    return rows.withColumn("placed_at", F.timestamp_seconds("at").cast("string")).drop("at")


def write(spark, path, *files):
    for part in files:
        table(spark, part).coalesce(1).write.mode("append").parquet(path)


def streamed(spark, source, out, delay, operator=ordered.velocity):
    good = v.parsed(v.read_orders(spark, source, files_per_trigger=1)).where(~F.col("bad"))
    features = operator(v.fan_out(v.deduplicated(good, delay)))
    v.start(features, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/rows/batch={i}"), f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(v.FEATURES + ", batch int").parquet(f"{out}/rows")


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*v.NAMES).collect()), key=repr)


def twin(spark, orders):
    return v.velocity_batch(v.fan_out(v.parsed(table(spark, orders))))


LAST = order(999, 60 * 86_400, user_id="end", store_id="end", device_id="end", payment_id="end", ip="end")


def test_ordered_features_equal_the_batch_twin_and_come_once(spark, tmp_path):
    """Shuffled, repeated orders over two weeks with equal seconds, silent days and busy minutes, in eight files."""
    times = [(i * 7919) % 400 if i < 40 else 3_000 * i if i < 70 else 86_400 * (i - 66) + 40 * (i % 3) for i in range(80)]
    orders = [order(i, s) for i, s in enumerate(times)] + [order(80 + i, 1_000) for i in range(4)]
    late = [orders[(i * 29) % 84] for i in range(84)]
    write(spark, f"{tmp_path}/orders", *[late[12 * n : 12 * n + 12] + late[max(0, 12 * n - 2) : 12 * n] for n in range(7)], [LAST])
    updates = streamed(spark, f"{tmp_path}/orders", f"{tmp_path}/out", "40 days")
    got = updates.where("order_id is not null and order_id != '999'")
    assert rows_of(got) == rows_of(twin(spark, orders))
    idle = updates.where("order_id is null and id = 'u0'").collect()
    assert idle and all(r["orders_24h"] == 0 and r["stores_24h"] == 0 for r in idle)


def test_ordered_features_batch_by_batch(spark, tmp_path):
    """A short delay: orders are taken over many micro-batches, windows move on between them."""
    orders = [order(i, 700 * i + (i % 4)) for i in range(240)]
    write(spark, f"{tmp_path}/orders", *[sorted(orders[24 * n : 24 * n + 24], key=lambda o: (o["at"] * 31) % 17) for n in range(10)], [LAST])
    updates = streamed(spark, f"{tmp_path}/orders", f"{tmp_path}/out", "10 minutes")
    assert updates.select("batch").distinct().count() >= 10
    assert rows_of(updates.where("order_id is not null and order_id != '999'")) == rows_of(twin(spark, orders))


def test_stream_and_backfill_equal_batch_with_orders_of_any_lateness(spark, tmp_path):
    orders = [order(i, 5_000 * i) for i in range(60)]
    late = [orders[i] for i in (3, 4, 17, 30, 31, 59)]
    on_time = [o for o in orders if o not in late[:-1]]
    write(spark, f"{tmp_path}/orders", on_time[:20], on_time[20:40], late[:2], on_time[40:], late[2:-1], [LAST])
    got = streamed(spark, f"{tmp_path}/orders", f"{tmp_path}/out", "10 minutes").where("order_id is null or order_id != '999'")
    source = v.parsed(table(spark, orders))
    missed = ordered.missed_by(source, got, "2020-01-01", "2027-01-01")
    assert {r["order_id"] for r in missed.collect()} == {o["order_id"] for o in late[:-1]}
    fresh = ordered.backfill(source, missed)
    assert rows_of(ordered.merged(got, fresh)) == rows_of(twin(spark, orders))
    # only what changes is written again
    assert fresh.count() < v.fan_out(source).count() and ordered.backfill(source, missed.limit(0)).count() == 0


def context(spark, orders):
    rows = v.parsed(table(spark, orders)).select("order_id", *v.KEYS.values(), F.col("pence").alias("total_pence"), F.lit(1).alias("merchant_id"), F.lit("x").alias("domain"))
    plain = {"card_bin": F.lit("1"), "ip_is_tor": F.lit(False), "disposable_email": F.lit(False), "new_payment": F.lit(True), "new_address": F.lit(True), "ip_km": F.lit(0.0), "ip_country": F.lit("GB")}
    return rows.withColumns(plain)


def decided(spark, source, features, orders, out, wait):
    good = v.parsed(v.read_orders(spark, source, files_per_trigger=1)).where(~F.col("bad"))
    log = spark.readStream.schema(v.FEATURES).option("maxFilesPerTrigger", 1).parquet(features)
    ready = decisions.gathered(good, log, "40 days", wait)
    users = spark.createDataFrame([(f"u{i}", 100, 0) for i in range(9)], "user_id string, account_age_days long, lifetime_chargeback_count long")
    write = decisions.sink(context(spark, orders), {("user", "batch"): users}, F.lit(0.1), f"{out}/audit")
    v.start(ready, write, f"{out}/decisions", "append").awaitTermination()
    return spark.read.parquet(f"{out}/audit").collect()


def test_a_decision_stays_when_a_late_order_changes_features(spark, tmp_path):
    """Seven orders of one device put the last one to review; a late order of its user emits the user's row again, alone."""
    same = [order(i, 60 * i, user_id=f"u{i % 8}", device_id="d", payment_id=f"p{i}", ip=f"ip{i}") for i in range(7)]
    late = order(50, 30, user_id="u6", device_id="other", payment_id="px", ip="ipx", store_id="sx")
    write(spark, f"{tmp_path}/orders", same, [late])
    log = streamed(spark, f"{tmp_path}/orders", f"{tmp_path}/out", "10 days", v.velocity)
    again = log.where("order_id = '6' and entity = 'user'").count()
    assert again == 2
    log.where("order_id is not null").drop("batch").repartition(5).write.parquet(f"{tmp_path}/log")
    rows = decided(spark, f"{tmp_path}/orders", f"{tmp_path}/log", [*same, late], tmp_path, "complete")
    assert sorted(r["order_id"] for r in rows) == sorted(o["order_id"] for o in [*same, late])
    assert {r["order_id"]: (r["decision"], r["rules_triggered"]) for r in rows}["6"] == ("REVIEW", ["device_velocity"])


def test_decisions_over_shuffled_late_files_equal_the_batch(spark, tmp_path):
    orders = [order(i, 200 * i, user_id="u0" if i < 30 else "u1", device_id=f"d{i % 3}") for i in range(48)]
    late = [orders[(i * 29) % 48] for i in range(48)]
    write(spark, f"{tmp_path}/orders", *[late[8 * n : 8 * n + 8] for n in range(6)], [LAST])
    log = streamed(spark, f"{tmp_path}/orders", f"{tmp_path}/out", "40 days")
    log.where("order_id is not null").drop("batch").repartition(7).write.parquet(f"{tmp_path}/log")
    everything = [*orders, LAST]
    rows = [r for r in decided(spark, f"{tmp_path}/orders", f"{tmp_path}/log", everything, tmp_path, "complete") if r["order_id"] != "999"]
    users = spark.createDataFrame([(f"u{i}", 100, 0) for i in range(9)], "user_id string, account_age_days long, lifetime_chargeback_count long")
    batch = decisions.decide(context(spark, orders), twin(spark, orders), {("user", "batch"): users}, F.lit(0.1))
    want = {r["order_id"]: (r["decision"], r["rules_triggered"]) for r in batch.collect()}
    assert len(rows) == 48 and {r["order_id"]: (r["decision"], r["rules_triggered"]) for r in rows} == want
    assert {d for d, _ in want.values()} == {"APPROVE", "REVIEW"}


def test_orders_that_stay_incomplete_are_decided_when_the_watermark_passes(spark, tmp_path):
    orders = [order(0, 0), order(1, 100), order(2, 86_400 * 50)]
    write(spark, f"{tmp_path}/orders", orders[:2], orders[2:])
    twin(spark, orders).where("order_id = '0' or (order_id = '1' and entity = 'user')").coalesce(1).write.parquet(f"{tmp_path}/log")
    twin(spark, orders).where("order_id = '2'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    rows = decided(spark, f"{tmp_path}/orders", f"{tmp_path}/log", orders, tmp_path, "complete")
    assert sorted(r["order_id"] for r in rows) == ["0", "1", "2"]
    with pytest.raises(ValueError):
        decisions.gathered(table(spark, orders), table(spark, orders), wait="never")
