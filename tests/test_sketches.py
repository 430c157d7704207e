"""Quantiles from panes against exact ones; merging; streams."""

import math

import numpy as np
from pyspark.sql import functions as F

from orderlens.operators import sketches

SECOND = 1_000_000


def sample(spark, n=6_000):
    rng = np.random.default_rng(8)
    values = np.concatenate((np.exp(rng.normal(3, 2, n - 300)), -np.exp(rng.normal(1, 1, 200)), np.zeros(100)))
    rows = [(int(i * 37 % 600) * SECOND // 4, float(v), "ab"[i % 2]) for i, v in enumerate(values)]
    return spark.createDataFrame([*rows, (None, 1.0, "a"), (5, None, "a"), (5, float("nan"), "b"), (5, float("inf"), "b")], "at long, v double, k string"), [r for r in rows]


def exact(values, share):
    return sorted(values)[max(0, math.ceil(share * len(values)) - 1)]


def near(got, want, error):
    return abs(got - want) <= error * abs(want) * (1 + 1e-9)


def test_quantiles_of_sliding_windows_are_within_the_error(spark):
    df, rows = sample(spark)
    shares = {"p01": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    parts = sketches.panes(df, "at", "v", 10 * SECOND, ("k",)).persist()
    got = sketches.quantiles(sketches.sliding(parts, 60 * SECOND, 10 * SECOND, ("k",)), shares, ("k", "start_us")).collect()
    starts = {(k, s) for t, _, k in rows for s in range(t // (10 * SECOND) * 10 * SECOND - 50 * SECOND, t + 1, 10 * SECOND)}
    assert {(r["k"], r["start_us"]) for r in got} == starts
    for r in got:
        inside = [v for t, v, k in rows if k == r["k"] and r["start_us"] <= t < r["start_us"] + 60 * SECOND]
        assert r["n"] == len(inside)
        assert all(near(r[name], exact(inside, s), sketches.ERROR) for name, s in shares.items())
    finer = sketches.quantiles(sketches.merged(sketches.panes(df, "at", "v", SECOND, error=0.001)), shares, error=0.001).first()
    assert all(near(finer[name], exact([v for _, v, _ in rows], s), 0.001) for name, s in shares.items())


def test_panes_of_a_stream_add_up(spark, tmp_path):
    df, _ = sample(spark, 900)
    df.repartition(3).write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    sketches.panes(stream, "at", "v", 10 * SECOND).writeStream.format("memory").queryName("panes").outputMode("complete").start().processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert sorted(map(tuple, spark.table("panes").collect())) == sorted(map(tuple, sketches.panes(df, "at", "v", 10 * SECOND).collect()))


def test_distance_of_a_day_to_its_reference(spark):
    df, rows = sample(spark, 2_000)
    parts = sketches.panes(df, "at", "v", 10 * SECOND)
    cut = 90 * SECOND
    got = sketches.distance(sketches.merged(parts.where(F.col("pane_us") >= cut)), sketches.merged(parts.where(F.col("pane_us") < cut))).first()
    a, b = ([v for t, v, _ in rows if (t >= cut) == new] for new in (True, False))
    want = max(abs(np.mean(np.array(a) <= x) - np.mean(np.array(b) <= x)) for x in a + b)
    assert got["n"] == len(a) and got["n_reference"] == len(b) and got["ks"] <= want + 1e-12 and got["ks"] >= want - 0.03
    assert sketches.distance(sketches.merged(parts.limit(0)), sketches.merged(parts)).first()["ks"] is None
