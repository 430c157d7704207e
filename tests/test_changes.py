"""The change stream: rows once each, in the order of their cursor, over restarts and ties."""

from pyspark.sql import functions as F

from orderlens.sources.changes import START, ChangeReader, ChangeSource


def add(spark, path, rows, files=1):
    spark.createDataFrame(rows, "order_id long, placed_us long, total long").repartition(files).write.mode("append").parquet(path)


def run(spark, path, tmp_path, limit, **options):
    spark.dataSource.register(ChangeSource)
    stream = spark.readStream.format("changes").option("path", path).option("limit", limit).option("cursor", f"{tmp_path}/cursor").options(**options).load()
    seen = []

    def keep(df, i):
        seen.append((i, sorted((r["placed_us"], r["order_id"]) for r in df.collect())))

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return [rows for _, rows in sorted(seen) if rows]


def test_rows_come_once_in_order_and_restarts_repeat_nothing(spark, tmp_path):
    path = f"{tmp_path}/orders"
    rows = [(i, 1_000 + i // 5, i) for i in range(57)]  # five orders at each time: cuts fall among equals
    add(spark, path, rows, 3)
    batches = run(spark, path, tmp_path, 7)
    assert all(len(b) <= 7 for b in batches) and len(batches) == 9
    assert [x for b in batches for x in b] == [(t, i) for i, t, _ in rows]
    later = [(100 + i, 1_011 + i // 3, i) for i in range(10)]  # the first ones at the time of the cursor, with larger ids
    add(spark, path, later, 2)
    again = run(spark, path, tmp_path, 100)
    assert [x for b in again for x in b] == sorted((t, i) for i, t, _ in later)
    assert run(spark, path, tmp_path, 100) == []


def test_a_cursor_to_start_from_and_large_gaps(spark, tmp_path):
    path = f"{tmp_path}/orders"
    add(spark, path, [(i, 10**15 * (i % 3) + i * i, i) for i in range(200)], 4)
    everything = sorted((10**15 * (i % 3) + i * i, i) for i in range(200))
    got = run(spark, path, tmp_path, 33, start='{"time": %d, "id": %d}' % everything[49])
    assert [x for b in got for x in b] == everything[50:] and all(len(b) <= 33 for b in got)


def test_next_cursor_and_pruned_files(spark, tmp_path):
    path = f"{tmp_path}/orders"
    for n in range(4):
        add(spark, path, [(100 * n + i, 1_000 * n + i, i) for i in range(50)])
    reader = ChangeReader({"path": path, "limit": "60", "cursor": f"{tmp_path}/cursor"}, ["order_id", "placed_us"])
    first = reader._next(START)
    assert first == {"time": 1_009, "id": 109} and reader._next({"time": 3_049, "id": 349}) == {"time": 3_049, "id": 349}
    parts = reader.partitions(START, first)
    assert sum(len(p.files) for p in parts) == 2
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 60


def test_partitioned_tables_and_columns(spark, tmp_path):
    path = f"{tmp_path}/orders"
    rows = spark.range(20).select(F.col("id").alias("order_id"), (F.col("id") * 10).alias("placed_us"), (F.col("id") % 3).cast("int").alias("week"))
    rows.write.partitionBy("week").parquet(path)
    spark.dataSource.register(ChangeSource)
    stream = spark.readStream.format("changes").option("path", path).option("cursor", f"{tmp_path}/cursor").load()
    stream.writeStream.format("memory").queryName("changed").option("checkpointLocation", f"{tmp_path}/c").start().processAllAvailable()
    assert sorted(tuple(r) for r in spark.table("changed").select("order_id", "week").collect()) == [(i, i % 3) for i in range(20)]
    for q in spark.streams.active:
        q.stop()
