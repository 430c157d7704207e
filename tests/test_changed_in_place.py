"""Keyed feature tables and archive passes: what is written follows what changed, and runs can be repeated and interrupted."""

import pytest
from pyspark.sql import functions as F

from orderlens.operators import archive as archives
from orderlens.operators.archive import Archive
from orderlens.sources import keyed
from orderlens.sources.keyed import KeyedTable

DAY = 86_400_000_000
NOW = 1_777_593_600_000_000  # 2026-05-01


def rows(spark, *rows):
    return spark.createDataFrame(rows, "k long, x long, t string").select("k", "x", F.to_timestamp("t").alias("updated_at"))


def features(spark, tmp_path, **kw):
    return KeyedTable(spark, f"file://{tmp_path}/features", "k long, x long, updated_at timestamp", ["k"], **{"buckets": 8, "sweep": 0} | kw)


def files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_latest_row_of_a_key_holds(spark, tmp_path):
    table = features(spark, tmp_path)
    table.write(rows(spark, (1, 1, "2026-01-01 10:00"), (2, 1, "2026-01-01 10:00"), (1, 2, "2026-01-01 11:00"), (4, 9, "2026-01-01 11:30")), 0)
    for _ in range(2):  # a repeated batch changes nothing
        table.write(rows(spark, (2, 5, "2026-01-01 12:00"), (1, 0, "2026-01-01 09:00"), (3, 7, "2026-01-01 12:00"), (4, 8, "2026-01-01 11:30")), 1)
    assert sorted((r["k"], r["x"]) for r in table.read().collect()) == [(1, 2), (2, 5), (3, 7), (4, 8)]
    assert {c for c, _ in table.read().dtypes} == {"k", "x", "updated_at", "expires_at"}
    assert table.read("2026-01-02 11:15").count() == 3  # key 1 expired at 11:00 the day after


def test_a_batch_writes_its_buckets_only_and_expired_rows_leave(spark, tmp_path):
    table = features(spark, tmp_path)
    table.write(rows(spark, *[(k, k, "2020-01-01 00:00") for k in range(100)]), 0)
    assert table.read().count() == 100
    before = files(tmp_path / "features" / "rows")
    table.write(rows(spark, (7, 70, "2026-01-01 00:00")), 1)
    after = files(tmp_path / "features" / "rows")
    assert sum(before.get(p) != t for p, t in after.items()) == 1 and len(set(before) & set(after)) == 7
    assert [(r["k"], r["x"]) for r in table.read().collect()] == [(7, 70)]
    mine = table._stored().where(F.col("bucket") == table._stored().where("k = 7").first()["bucket"])
    assert mine.count() == 1  # the bucket's rows of 2020 are gone from its files
    sweeping = features(spark, tmp_path, sweep=4)
    for n in (2, 3):
        sweeping.write(rows(spark, (7, n, "2026-01-01 01:00")), n)
    assert sweeping._stored().count() == 1 and len(keyed.folders(spark, f"file://{tmp_path}/features/rows")) == 1


def test_an_interrupted_batch_is_repeated(spark, tmp_path, monkeypatch):
    table = features(spark, tmp_path)
    table.write(rows(spark, *[(k, 0, "2026-01-01 00:00") for k in range(20)]), 0)
    new = rows(spark, *[(k, 1, "2026-01-01 00:30") for k in range(5, 25)])
    whole = keyed.replace_parts

    def broken(staged, path, part, touched):
        whole(staged.where("bucket < 4"), path, part, [b for b in touched if b < 4])
        raise OSError("lost")

    monkeypatch.setattr(keyed, "replace_parts", broken)
    with pytest.raises(OSError):
        table.write(new, 1)
    monkeypatch.setattr(keyed, "replace_parts", whole)
    table.write(new.limit(0), 1)  # goes on from what was prepared
    assert sorted((r["k"], r["x"]) for r in table.read().collect()) == [(k, int(k >= 5)) for k in range(25)]


def test_streams_write_to_it(spark, tmp_path):
    for n in range(3):
        rows(spark, *[(k, n, f"2026-01-01 0{n}:00") for k in range(n, n + 4)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
    table = features(spark, tmp_path, sweep=1)
    stream = spark.readStream.schema("k long, x long, updated_at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/source")
    stream.writeStream.foreachBatch(table.write).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["k"], r["x"]) for r in table.read().collect()) == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 2), (5, 2)]


def hot_tables(spark):
    """14 weeks of orders, most of them terminal; equal terminal times among them."""
    orders = spark.range(100).select(
        F.col("id").alias("order_id"), (F.lit(NOW) - (100 - F.col("id")) * DAY).alias("placed_us"), F.when(F.col("id") % 7 == 6, "PLACED").otherwise("DELIVERED").alias("status"),
        (F.lit(NOW) - (100 - F.floor(F.col("id") / 4) * 4) * DAY).alias("terminal_us"),
    )
    items = orders.select("order_id", "placed_us", F.explode(F.sequence(F.lit(1), 1 + F.col("order_id") % 3)).alias("item"))
    return {"orders": orders, "items": items, "events": orders.select("order_id", "placed_us", F.col("status").alias("event"))}


def contents(store):
    return {(side, name): sorted(tuple(r) for r in getattr(store, side)(name).drop("placed_week", "pass").collect()) for side in ("hot", "cold") for name in store.tables}


def whole(store):
    c = contents(store)
    return {name: sorted(c["hot", name] + c["cold", name]) for name in store.tables}


def test_a_pass_moves_the_oldest_and_touches_their_weeks_only(spark, tmp_path):
    store = Archive(spark, f"file://{tmp_path}/a")
    store.load(hot_tables(spark))
    start, before = whole(store), files(tmp_path / "a" / "hot")
    assert store.run_pass(1, NOW, 20) == 20 and whole(store) == start
    archivable = sorted((r["terminal_us"], r["order_id"]) for r in hot_tables(spark)["orders"].where("status = 'DELIVERED'").collect())
    assert sorted(r["order_id"] for r in store.cold("orders").collect()) == sorted(i for _, i in archivable[:20])
    after = files(tmp_path / "a" / "hot")
    changed = {str(p).split("placed_week=")[1][:10] for p in {*before, *after} if after.get(p) != before.get(p)}
    assert changed == {str(r[0]) for r in store.cold("orders").select("placed_week").distinct().collect()} and 3 <= len(changed) <= 5
    assert store.run_pass(1, NOW, 20) == 0 and whole(store) == start and store.cold("orders").count() == 20  # the ledger has it
    assert {(r["table"], r["moved"]) for r in store.ledger().collect()} == {("orders", 20), ("items", store.cold("items").count()), ("events", 20)}


def test_passes_go_on_until_nothing_is_left(spark, tmp_path):
    store = Archive(spark, f"file://{tmp_path}/a")
    store.load(hot_tables(spark))
    start = whole(store)
    assert store.run(NOW, 50, passes=1) == 50 and store.run(NOW, 50) == 36 and store.run(NOW, 50) == 0
    assert whole(store) == start and {r["status"] for r in store.hot("orders").collect()} == {"PLACED"}
    assert store.cold("items").join(store.cold("orders"), "order_id", "left_anti").count() == 0


def fails_at(call, real):
    """real, which breaks off after so many calls."""
    calls = []

    def run(*args):
        calls.append(1)
        if len(calls) > call:
            raise OSError("lost")
        return real(*args)

    return run


@pytest.mark.parametrize(("what", "call"), [("replace_parts", 0), ("replace_parts", 2), ("delete", 0), ("with_count", 0)])
def test_an_interrupted_pass_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, what, call):
    """It breaks off before or between hot tables, after the ledger was written, or while it is prepared."""
    store = Archive(spark, f"file://{tmp_path}/a")
    store.load(hot_tables(spark))
    start = whole(store)
    if what == "with_count":
        monkeypatch.setattr(Archive, "_prepare", lambda self, n, as_of, batch, work: fails_at(call, None)(self.hot("orders").limit(3).write.parquet(f"{work}/chosen")))
    else:
        monkeypatch.setattr(archives, what, fails_at(call, getattr(archives, what)) if what == "replace_parts" else fails_at(call, None))
    with pytest.raises(OSError):
        store.run_pass(1, NOW, 50)
    monkeypatch.undo()
    store.run(NOW, 50, passes=1)
    assert whole(store) == start and store.cold("orders").where("pass = 1").count() == 50
    assert store.cold("orders").count() == store.cold("events").count()
