"""M2: a perceptron with class weights, trained by full gradients that Spark adds up.

Each task runs its rows forward and back and hands on one sum; sums are added in two levels, and the driver holds nothing but the
network's own parameters. Positives weigh as much as negatives in all, without being copied. Training stops when
average precision on the validation rows no longer rises, and keeps the best parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import checkpointed
from .evaluate import average_precision, ranking

#: First-level groups in which the tasks' gradients are added up.
FAN = 16


class Perceptron:
    """Layers with rectified units and one sigmoid output; all parameters in one array."""

    def __init__(self, sizes: list[int], params: np.ndarray | None = None, seed: int = 7) -> None:
        self.sizes = [*sizes, 1]
        if params is None:
            rng = np.random.default_rng(seed)
            parts = [np.concatenate([(rng.standard_normal((a, b)) * np.sqrt(2 / a)).ravel(), np.zeros(b)]) for a, b in zip(self.sizes, self.sizes[1:])]
            params = np.concatenate(parts)
        self.params = params

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((self.params[at : at + a * b].reshape(a, b), self.params[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """What each layer hands on; the last one is the margin."""
        out = [x]
        for i, (w, b) in enumerate(layers := self.layers()):
            z = out[-1] @ w + b
            out.append(z if i == len(layers) - 1 else np.maximum(z, 0))
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x)[-1][:, 0], -500, 500)))

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """The weighted sum of the rows' log losses, and its gradient."""
        outs = self.forward(x)
        margin = outs[-1][:, 0]
        loss = float((weight * (np.logaddexp(0, margin) - y * margin)).sum())
        delta = (weight * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y))[:, None]
        parts: list[np.ndarray] = []
        for i, (w, _) in reversed(list(enumerate(self.layers()))):
            parts[:0] = [(outs[i].T @ delta).ravel(), delta.sum(axis=0)]
            if i:
                delta = (delta @ w.T) * (outs[i] > 0)
        return loss, np.concatenate(parts)

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with rawPrediction, probability and prediction, as the models of pyspark.ml give them."""
        mine = Perceptron(self.sizes[:-1], self.params)

        @F.pandas_udf("double")
        def positive(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(mine.probability(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

        p = positive(vector_to_array("features"))
        out = rows.withColumn("_p", p)
        both = array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))
        return out.withColumn("rawPrediction", both).withColumn("probability", both).withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p")


def class_weights(rows: DataFrame, label: str = "y") -> dict[int, float]:
    """Negatives weigh 1, positives as many times as there are fewer of them. One class only is an error."""
    counts = rows.agg(F.coalesce(F.sum(label), F.lit(0)).alias("pos"), F.coalesce(F.sum(1 - F.col(label)), F.lit(0)).alias("neg")).first()
    if not counts["pos"] or not counts["neg"]:
        raise ValueError(f"training needs both classes: {counts['neg']} negatives, {counts['pos']} positives")
    return {0: 1.0, 1: counts["neg"] / counts["pos"]}


def gradient(rows: DataFrame, net: Perceptron) -> tuple[float, np.ndarray]:
    """Mean weighted loss and gradient over rows (x array<double>, y, weight)."""
    schema = "salt int, loss double, weight double, gradient array<double>"

    def packed(salt: int, loss: float, weight: float, total: np.ndarray) -> pa.Table:
        return pa.table([pa.array([salt], pa.int32()), pa.array([loss]), pa.array([weight]), pa.array([total], pa.list_(pa.float64()))], names=["salt", "loss", "weight", "gradient"])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, weight, total = 0.0, 0.0, np.zeros(len(net.params))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "weight"))
                one, grad = net.gradient(x, y, w)
                loss, weight, total = loss + one, weight + float(w.sum()), total + grad
        yield from packed(TaskContext.get().partitionId() % FAN, loss, weight, total).to_batches()

    def added(table: pa.Table) -> pa.Table:
        grads = np.stack([g.values.to_numpy(zero_copy_only=False) for g in table.column("gradient")])
        return packed(table.column("salt")[0].as_py(), sum(table.column("loss").to_pylist()), sum(table.column("weight").to_pylist()), grads.sum(axis=0))

    parts = rows.select("x", F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight")).mapInArrow(of_task, schema).groupBy("salt").applyInArrow(added, schema).collect()
    weight = sum(r["weight"] for r in parts)
    return sum(r["loss"] for r in parts) / weight, np.sum([r["gradient"] for r in parts], axis=0) / weight


def train(train_rows: DataFrame, val: DataFrame, n_features: int, label: str = "y", hidden: tuple[int, ...] = (256, 128, 64, 32), rounds: int = 300, step: float = 0.01, patience: int = 5, every: int = 10) -> tuple[Perceptron, list[float]]:
    """M2: adaptive-moment steps on the weighted loss; every `every` rounds average precision on the validation rows is looked at: after
    `patience` looks without a better one training stops, after three the step is halved. The best parameters, and the curve."""
    weights = class_weights(train_rows, label)
    rows = checkpointed(train_rows.select(vector_to_array("features").alias("x"), F.col(label).alias("y"), F.when(F.col(label) == 1, weights[1]).otherwise(weights[0]).alias("weight")))
    looked = checkpointed(val.select("features", F.col(label).alias("y")))
    net, best, curve, since = Perceptron([n_features, *hidden]), None, [], 0
    first, second = np.zeros_like(net.params), np.zeros_like(net.params)
    for i in range(1, rounds + 1):
        _, grad = gradient(rows, net)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        net = Perceptron([n_features, *hidden], net.params - step * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-7))
        if i % every and i < rounds:
            continue
        scored = net.transform(looked).withColumn("score", vector_to_array("probability")[1])
        value = ranking(scored, "score", "y").agg(average_precision().alias("a")).first()["a"] or 0.0
        if not curve or value > max(curve):
            best, since = net, 0
        else:
            since += 1
            step = step / 2 if since == 3 else step
        curve.append(value)
        if since >= patience:
            break
    return best, curve
