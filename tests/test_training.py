"""Boosting judged by round, and the weighted perceptron, against brute force."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from orderlens.operators import boosting, model, network


def sample(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.7 * rng.standard_normal(n) > 1.4).astype(int)
    rows = spark.createDataFrame([(int(i), [float(v) for v in row], int(t)) for i, (row, t) in enumerate(zip(x, y))], "id int, x array<double>, y int")
    return rows.withColumn("features", array_to_vector("x")), x, y


def brute_precision(score, y):
    total, tp, seen = 0.0, 0, 0
    for s in sorted(set(score), reverse=True):
        at = score == s
        tp, seen = tp + y[at].sum(), seen + at.sum()
        total += y[at].sum() / y.sum() * tp / seen
    return total


def test_trees_by_round(spark):
    rows, x, y = sample(spark)
    fit, curve = boosting.train(rows.where("id < 250"), rows.where("id >= 250"), rounds=12, depth=3, patience=4)
    k = boosting.stop_at(curve, 4)
    assert len(curve) == 12 and len(fit.trees) == k
    whole = model.GBTClassifier(labelCol="y", weightCol="weight", maxDepth=3, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=5, maxIter=12, seed=7).fit(boosting.checkpointed(model.weighted(rows.where("id < 250"), "y")))
    trees = boosting.nodes(whole)
    scored = {r["id"]: r["margins"] for r in boosting.staged(rows, trees).select("id", "margins").collect()}
    for r in whole.transform(rows).select("id", "rawPrediction").collect():
        assert scored[r["id"]][-1] == pytest.approx(r["rawPrediction"][1] / 1, abs=1e-9) or 2 * scored[r["id"]][-1] == pytest.approx(r["rawPrediction"][1], abs=1e-9)
    margins = np.array([scored[i] for i in range(250, 400)])
    want = [brute_precision(margins[:, j], y[250:]) for j in range(12)]
    assert np.allclose(curve, want, atol=1e-6)
    cut = {r["id"]: r["probability"][1] for r in fit.transform(rows).select("id", "probability").collect()}
    assert all(cut[i] == pytest.approx(1 / (1 + np.exp(-2 * scored[i][k - 1])), abs=1e-9) for i in range(400))
    gains = boosting.gains(trees, ["a", "b", "c"]).collect()
    assert gains[0]["feature"] == "a" and gains[0]["gain"] >= gains[-1]["gain"] > 0
    with pytest.raises(ValueError):
        boosting.train(rows.where("y = 0"), rows, rounds=1)


def test_early_stopping():
    assert boosting.stop_at([0.1, 0.5, 0.4, 0.45, 0.6], 2) == 2
    assert boosting.stop_at([0.1, 0.5, 0.4, 0.45, 0.6], 3) == 5 and boosting.stop_at([0.3], 30) == 1 and boosting.stop_at([0.5, 0.5], 1) == 1


def test_weighted_gradient_is_that_of_copied_positives(spark):
    rows, x, y = sample(spark, 120)
    ratio = 3
    weighted = rows.withColumn("weight", F.when(F.col("y") == 1, ratio).otherwise(1)).repartition(5)
    copied = rows.withColumn("weight", F.lit(1)).withColumn("_", F.explode(F.sequence(F.lit(1), F.when(F.col("y") == 1, ratio).otherwise(1)))).repartition(3)
    net = network.Perceptron([3, 6, 4])
    net.params = 0.5 * np.random.default_rng(4).standard_normal(len(net.params))  # away from the kinks at 0
    a, b = network.gradient(weighted, net), network.gradient(copied, net)
    assert a[0] == pytest.approx(b[0]) and np.allclose(a[1], b[1], atol=1e-12)
    # and the slope of the loss
    w = np.where(y == 1, ratio, 1.0)
    for i in range(0, len(net.params), 7):
        moved = net.params.copy()
        moved[i] += 1e-6
        up = network.Perceptron([3, 6, 4], moved).gradient(x, y, w)[0] / w.sum()
        assert (up - a[0]) / 1e-6 == pytest.approx(a[1][i], abs=1e-4)


def test_perceptron_learns_and_keeps_the_best(spark):
    rows, _, _ = sample(spark)
    net, curve = network.train(rows.where("id < 250"), rows.where("id >= 250"), 3, hidden=(8,), rounds=40, step=0.05, every=10, patience=2)
    assert max(curve) > 0.7 and len(curve) <= 4
    got = model.score(net, rows).select("score").collect()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert network.class_weights(rows)[1] == pytest.approx(rows.where("y = 0").count() / rows.where("y = 1").count())
    with pytest.raises(ValueError, match="both classes"):
        network.class_weights(rows.where("y = 1"))
