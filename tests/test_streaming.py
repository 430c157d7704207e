"""The stateful operator against its batch twin, set-aside events, repeats, and sinks."""

import pytest
from pyspark.sql import functions as F

from orderlens.sources import io
from orderlens.streaming import decisions
from orderlens.streaming import velocity as v


@pytest.fixture
def stream_orders(spark, tmp_path):
    rows = [
        (str(i), f"u{i % 4}", f"s{i % 3}", None if i % 5 == 0 else f"d{i % 6}", f"p{i % 7}", f"a{i % 3}", f"ip{i % 2}", "x" if i == 13 else str(100 + i), "DECLINED" if i % 8 == 0 else "PLACED", "bad" if i == 14 else f"2026-01-0{1 + i // 40} {(i * 7) % 24:02d}:{i % 60:02d}:00")
        for i in range(120)
    ]
    raw = spark.createDataFrame(rows + rows[:10], v.ORDER)
    raw.coalesce(1).write.parquet(f"{tmp_path}/orders")
    return f"{tmp_path}/orders"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*v.NAMES).collect()), key=repr)


def streamed(spark, source, out, delay, files=1):
    """The last update of each (entity, id, order), over as many micro-batches as there are files."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    good = v.parsed(v.read_orders(spark, source, files_per_trigger=files)).where(~F.col("bad"))
    features = v.velocity(v.fan_out(v.deduplicated(good, delay)))
    v.start(features, lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/rows/batch={i}"), f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def last(updates):
    return updates.where("order_id is not null").groupBy("entity", "id", "order_id").agg(F.max_by(F.struct(*v.NAMES), "batch").alias("r")).select("r.*")


def test_stream_equals_batch(spark, stream_orders, tmp_path):
    table = v.parsed(spark.read.schema(v.ORDER).parquet(stream_orders)).where(~F.col("bad")).dropDuplicates(["order_id"])
    assert rows_of(last(streamed(spark, stream_orders, f"{tmp_path}/out", "10 days"))) == rows_of(v.velocity_batch(v.fan_out(table)))


def test_stream_of_shuffled_files_equals_batch(spark, tmp_path):
    """Late and repeated orders in many micro-batches, all within the watermark's delay."""
    rows = [
        (str(i), f"u{i % 3}", f"s{i % 4}", f"d{i % 2}" if i % 5 else None, f"p{(i * 7) % 5}", None, f"ip{i % 2}", str(10 + i), "DECLINED" if i % 6 == 0 else "PLACED", f"2026-01-0{1 + i // 12} {(i * 2) % 24:02d}:{(i * 13) % 60:02d}:00")
        for i in range(48)
    ]
    order = [(i * 29) % 48 for i in range(48)]
    late = [rows[i] for i in order]
    for n in range(6):
        part = late[8 * n : 8 * n + 8] + [late[max(0, 8 * n - 3)]]
        spark.createDataFrame(part, v.ORDER).coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders")
    table = v.parsed(spark.createDataFrame(rows, v.ORDER))
    updates = streamed(spark, f"{tmp_path}/orders", f"{tmp_path}/out", "20 days")
    assert updates.select("batch").distinct().count() >= 5
    assert rows_of(last(updates)) == rows_of(v.velocity_batch(v.fan_out(table)))


def test_late_orders_find_what_was_before_them(spark, tmp_path):
    """An order that comes late but within the delay still sees the day before it; silent pairs are trimmed by a timer and tell it."""
    when = lambda s: F.timestamp_seconds(F.lit(1_767_225_600 + s)).cast("string")
    for n, (order, s) in enumerate([("a", 0), ("b", 86_700), ("c", 86_300), ("d", 86_700 + 3 * 86_400), ("e", 86_700 + 6 * 86_400)]):
        row = spark.range(1).select(F.lit(order).alias("order_id"), F.lit("u" if n < 3 else "w").alias("user_id"), *[F.lit(None).cast("string").alias(k) for k in ("store_id", "device_id", "payment_id", "address_id", "ip")], F.lit("5").alias("total_pence"), F.lit("PLACED").alias("status"), when(s).alias("placed_at"))
        row.coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders")
    updates = streamed(spark, f"{tmp_path}/orders", f"{tmp_path}/out", "20 minutes")
    got = {r["order_id"]: (r["orders_24h"], r["orders_1h"]) for r in last(updates).collect()}
    assert got == {"a": (1, 1), "b": (2, 2), "c": (2, 1), "d": (1, 1), "e": (1, 1)}
    silent = updates.where("order_id is null and id = 'u'").collect()
    assert silent and all(r["orders_24h"] == 0 for r in silent)


def test_current_state_equals_the_last_features(spark):
    at = 1_767_225_600
    rows = [(str(i), f"u{i % 3}", f"s{i % 2}", f"d{i % 4}" if i % 5 else None, f"p{i % 5}", "a", f"ip{i % 2}", 10 + i, "DECLINED" if i % 6 == 0 else "PLACED", at - 86_400 + 3_000 * i) for i in range(29)] + [("29", "u0", "s0", "d0", "p0", "a", "ip0", 5, "PLACED", at)]
    orders = spark.createDataFrame(rows, "order_id string, user_id string, store_id string, device_id string, payment_id string, address_id string, ip string, pence long, status string, s long").withColumn("ts", F.timestamp_seconds("s"))
    pairs = v.fan_out(orders)
    now = {(r["entity"], r["id"]): r for r in v.current(pairs, at).collect()}
    for r in v.velocity_batch(pairs).where(f"at_s = {at}").collect():
        same = now[r["entity"], r["id"]]
        assert all((same[x] or 0) == (r[x] or 0) for x in (*v.PLAIN, *v.COUNTS)), (r, same)


def test_decisions_on_the_stream(spark, tmp_path):
    rows = [(str(i), "u0" if i < 14 else f"u{i}", "s0", f"d{i}", f"p{i}", None, "ip0", "900", "PLACED", f"2026-01-01 10:{i:02d}:00") for i in range(20)]
    spark.createDataFrame(rows, v.ORDER).coalesce(1).write.parquet(f"{tmp_path}/orders")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    orders = v.parsed(spark.createDataFrame(rows, v.ORDER)).select("order_id", *v.KEYS.values(), F.col("pence").alias("total_pence"), F.lit(1).alias("merchant_id"), F.lit("x").alias("domain"))
    orders = orders.withColumns({"card_bin": F.when(F.col("order_id") == "19", "666").otherwise("1"), "ip_is_tor": F.lit(False), "disposable_email": F.lit(False), "new_payment": F.lit(True), "new_address": F.lit(True), "ip_km": F.lit(0.0), "ip_country": F.lit("GB")})
    users = spark.createDataFrame([(f"u{i}", 100, 5 if i == 18 else 0) for i in range(20)], "user_id string, account_age_days long, lifetime_chargeback_count long")
    score = F.when(F.col("order_id") == "17", 0.9).otherwise(0.1)
    streamed(spark, f"{tmp_path}/orders", f"{tmp_path}/out", "20 minutes").where("order_id is not null").drop("batch").write.parquet(f"{tmp_path}/log")
    ready = decisions.gathered(v.parsed(v.read_orders(spark, f"{tmp_path}/orders")), spark.readStream.schema(v.FEATURES).parquet(f"{tmp_path}/log"))
    v.start(ready, decisions.sink(orders, {("user", "batch"): users}, score, f"{tmp_path}/audit", ("666",)), f"{tmp_path}/checkpoint", "append").awaitTermination()
    got = {r["order_id"]: (r["decision"], r["rules_triggered"], r["new_status"]) for r in spark.read.parquet(f"{tmp_path}/audit").collect()}
    assert len(got) == 20 and got["3"] == ("APPROVE", [], None) and got["13"] == ("REVIEW", ["user_velocity"], None)
    assert got["17"] == ("DECLINE", [], "REJECTED") and got["18"][:2] == ("DECLINE", ["chargebacks"]) and got["19"][:2] == ("DECLINE", ["bin_blocklist"])


def test_dead_letters_and_ids_with_their_orders(spark, stream_orders, tmp_path):
    raw = v.read_orders(spark, stream_orders)
    v.dead_letters(raw, f"{tmp_path}/bad", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r["order_id"] for r in spark.read.json(f"{tmp_path}/bad").select("order_id").distinct().collect()) == ["13", "14"]
    table = spark.read.schema(v.ORDER).parquet(stream_orders).dropDuplicates(["order_id"])
    both = v.enriched(raw.select("order_id"), table.select("order_id", "user_id"))
    both.writeStream.format("memory").queryName("enriched").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("enriched").count() == 130


def test_bad_events_are_set_aside(spark, stream_orders):
    got = v.parsed(spark.read.schema(v.ORDER).parquet(stream_orders)).where("bad").select("order_id").distinct().collect()
    assert sorted(r["order_id"] for r in got) == ["13", "14"]


def test_tumbling_stream_in_complete_mode(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    v.per_minute(stream, "ts", "event_type", "5 minutes").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(spark.table("tumbling").collect()) == sorted(v.per_minute(events, "ts", "event_type", "5 minutes").collect())


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-01-05 00:00:00", 1.0), (2, "2026-01-11 23:59:59", 2.0), (3, "2026-01-12 00:00:00", 3.0)], "id long, t string, x double").select("id", F.col("t").cast("timestamp").alias("placed_at"), "x")
    io.write_weekly(rows, f"{tmp_path}/weekly")
    assert sorted(p.name for p in (tmp_path / "weekly").iterdir() if p.is_dir()) == ["placed_week=2026-01-05", "placed_week=2026-01-12"]
    assert io.read_weeks(spark, f"{tmp_path}/weekly", "2026-01-06 00:00:00", "2026-01-12 00:00:01").count() == 2
    io.write_run(rows, f"{tmp_path}/runs", "r1")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        io.write_run(rows, f"{tmp_path}/runs", "r1")
    io.append_log(rows, f"{tmp_path}/log")
    io.append_log(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 6
    io.write_document(rows, f"{tmp_path}/doc")
    io.write_splits(rows.withColumn("split", F.lit("train")), f"{tmp_path}/splits")
    rows.select("id", "x").write.option("header", True).csv(f"{tmp_path}/csv")
    assert io.read_csv(spark, f"{tmp_path}/csv", "id long, x double").agg(F.sum("x")).first()[0] == 6.0
    new = io.upsert(rows.select(F.lit(1).alias("k"), "x", F.col("placed_at").alias("updated_at")), rows.limit(0).select(F.lit(1).alias("k"), "x", F.col("placed_at").alias("updated_at")), ["k"])
    assert [(r["k"], r["x"]) for r in new.collect()] == [(1, 3.0)] and io.alive(new, "2026-01-13 00:00:01").count() == 0
