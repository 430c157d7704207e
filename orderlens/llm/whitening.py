"""Embedding whitening by spectrum slicing.

Vectors become integers, x = floor(64 c) + 1,000,000, so counts, sums and deviations are exact. Tasks add up their vectors,
then, with the sums known, the products of the centred ones; what is gathered of a table of any length is one matrix of
dimension by dimension. On that matrix V, LDLt factors of V - s I have as many positive pivots as V has eigenvalues above s:
bisection by these counts isolates each leading eigenvalue in an interval of its own (or shows that several can't be told
apart), inverse iteration within the interval finds the neighbourhood of its vector, Rayleigh quotient iteration makes it exact, and
counts on both sides of the result certify that it is the k-th. Every vector is then projected, and the covariance of what came out is measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
#: Largest entry that is taken: beyond it, 64 times the entry isn't exact.
LARGEST = float(2**46)
#: Eigenvalues up to this part of the trace count as zero: rounding decides their vectors.
ZERO = 1e-11
#: Eigenvalues closer than this part of the largest are found as one cluster.
CLOSE = 1e-7
#: First-level groups in which the tasks' matrices are added up.
FAN = 32


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors that are not null or empty and hold neither nulls nor non-finite entries (nor any beyond LARGEST)."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors of a batch."""
    lists = batch.column(column)
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, values[offsets[rows][:, None] + np.arange(d)]


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v).astype(np.int64) + OFFSET


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact; the nearest integer of the mean is taken off first, so that nothing overflows before the result does."""
    middle = sums // n
    near = x - middle
    if n * int(np.abs(near).max(initial=0)) < 2**62:
        return n * near - (sums - n * middle)
    return n * near.astype(object) - (sums - n * middle).astype(object)


def total(rows: DataFrame, column: str, add: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, tuple[int, np.ndarray]]:
    """For each length d of the vectors: their number, and the sum of add(matrix), an array of rows, over all batches.

    Each task adds up its own and hands on one row for each row of the sum; those are added in two levels.
    """
    sql = "array<long>" if kind == "long" else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for at, v in by_length(batch, column):
                for start in range(0, len(v), 4096):
                    part = add(v[start : start + 4096])
                    n, sums = held.get(v.shape[1], (0, 0))
                    held[v.shape[1]] = n + min(4096, len(v) - start), sums + part
        for d, (n, sums) in held.items():
            size = len(sums)
            arrays = [pa.array([d] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(list(sums), pa.list_(pa.int64() if kind == "long" else pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["d", "i", "n", "sums"])

    def added(table: pa.Table) -> pa.Table:
        sums = table.column("sums").combine_chunks()
        matrix = sums.values.to_numpy(zero_copy_only=False).reshape(len(sums), -1)
        sums = pa.array([matrix.sum(axis=0)], pa.list_(pa.int64() if kind == "long" else pa.float64()))
        one = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("d", "i")]
        return pa.table(one + [pa.array([sum(table.column("n").to_pylist())], pa.int64()), sums], names=["d", "i", "n", "sums"])

    schema = f"d int, i int, n long, sums {sql}"
    parts = rows.select(column).mapInArrow(run, schema).withColumn("salt", F.spark_partition_id() % FAN)
    first = parts.groupBy("d", "i", "salt").applyInArrow(lambda t: added(t.drop(["salt"])), schema)
    out: dict[int, tuple[int, list]] = {}
    for r in sorted(first.groupBy("d", "i").applyInArrow(added, schema).collect(), key=lambda r: (r["d"], r["i"])):
        out.setdefault(r["d"], (r["n"], []))[1].append(r["sums"])
    return {d: (n, np.array(sums, np.int64 if kind == "long" else np.float64)) for d, (n, sums) in out.items()}


def above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric matrix v above the shift: positive pivots of LDLt = v - shift I, with symmetric pivoting (1 by 1, and 2 by 2 where that is unstable)."""
    a = v - shift * np.eye(len(v))
    alpha, count = (1 + 17**0.5) / 8, 0
    while len(a):
        column = np.abs(a[1:, 0])
        most = column.max(initial=0.0)
        if abs(a[0, 0]) < alpha * most:
            r = 1 + int(column.argmax())
            other = np.abs(a[r]).copy()
            other[r] = 0
            if abs(a[0, 0]) * other.max() < alpha * most**2:
                if abs(a[r, r]) >= alpha * other.max():
                    order = [r, *range(1, r), 0, *range(r + 1, len(a))]
                    a = a[np.ix_(order, order)]
                else:
                    order = [0, r, *(i for i in range(1, len(a)) if i != r)]
                    a = a[np.ix_(order, order)]
                    count += 1  # the determinant of such a pivot is negative: one eigenvalue of each sign
                    a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
                    continue
        pivot = a[0, 0]
        count += pivot > 0
        a = a[1:, 1:] - np.outer(a[1:, 0] / pivot, a[0, 1:]) if pivot else a[1:, 1:]
    return count


def isolated(v: np.ndarray, k: int) -> list[tuple[float, float, int, int]]:
    """(low, high, first, last): disjoint intervals, highest first, that hold the first-th to last-th largest eigenvalue and together
    the k largest; of more than one only where they can't be told apart."""
    radius = np.abs(v).sum(axis=1).max() * (1 + 1e-12)
    done, todo = [], [(-radius * 1e-3, radius, above(v, -radius * 1e-3), 0)]
    while todo:
        low, high, upto, before = todo.pop()  # `before` eigenvalues above high, `upto` above low
        if upto == before or before >= k:
            continue
        width = high - low
        # With one width more on either side still alone: from the middle, this eigenvalue is three times as near as any other.
        if width <= CLOSE * radius or upto - before == 1 and above(v, low - width) == upto and above(v, high + width) == before:
            done.append((low, high, before + 1, upto))
            continue
        middle = (low + high) / 2
        at = above(v, middle)
        todo += [(low, middle, upto, at), (middle, high, at, before)]
    return sorted(done, key=lambda x: x[2])


def solve(v: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(v - shift * np.eye(len(v)), x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        return np.linalg.solve(v - (shift + 1e-15 * np.abs(v).max()) * np.eye(len(v)), x)


def eigen(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance, falling, and their unit vectors as rows; those that count as zero are left out."""
    scale = np.trace(v)
    if not scale > 0:
        return np.zeros(0), np.zeros((0, len(v)))
    rng, values, found = np.random.default_rng(11), [], []
    for low, high, first, last in isolated(v, k):
        many = last - first + 1
        block = np.linalg.qr(rng.standard_normal((len(v), many)))[0]
        for _ in range(6):
            block = np.linalg.qr(solve(v, (low + high) / 2, block))[0]
        own, turn = np.linalg.eigh(block.T @ v @ block)
        block = (block @ turn)[:, ::-1]
        for j, e in enumerate(own[::-1]):
            x = block[:, j]
            if many == 1:
                for _ in range(8):  # each round triples the right digits
                    y = solve(v, e, x)
                    x = y / np.linalg.norm(y)
                    before, e = e, x @ v @ x
                    if abs(e - before) <= 1e-15 * scale:
                        break
            values.append(e)
            found.append(x)
    # Neighbours that are close are made orthogonal to the last bit; the rest are so already.
    vectors = np.array(found).T
    if vectors.size:
        gram = vectors.T @ vectors
        vectors = vectors @ (1.5 * np.eye(len(gram)) - 0.5 * gram)
    values = np.array(values)
    for i, e in enumerate(values):
        slack = 2 * CLOSE * values[0]
        if not above(v, e + slack) <= i < above(v, e - slack):
            raise ArithmeticError(f"eigenvalue {i + 1} isn't certified by the counts")
    fine = np.flatnonzero(values[:k] > ZERO * scale)
    return values[fine], vectors[:, fine].T


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, dict[int, dict]]:
    """(rows, fits). rows, staged: (vec_id, d, n, deviation, whitened), a row per vector; fits, for each length d: n, values, explained, identity_error.

    Vectors of each length are a fit of their own, so none is lost. Null and empty vectors go, and so do those with null or
    non-finite entries, or entries beyond 2**46. Null and repeated ids stay, and so do repeated rows, each counting. Components without variance (fewer
    vectors than dimensions, equal vectors) are left out; then `whitened` is shorter, or empty. deviation is null where it is no long.
    Other columns aren't read. An empty table gives no rows and no fits. What reaches the driver is a matrix for each length.
    """
    rows = usable(vectors, id_col, vector_col)
    sums = {d: (n, s[0]) for d, (n, s) in total(rows, "v", lambda v: integers(v).sum(axis=0, keepdims=True), "long").items()}

    def products(v: np.ndarray) -> np.ndarray:
        z = (centred(integers(v), *sums[v.shape[1]]) / sums[v.shape[1]][0]).astype(np.float64)
        return z.T @ z

    fits = {}
    for d, (n, matrix) in (total(rows, "v", products, "double") if sums else {}).items():
        v = (matrix + matrix.T) / (2 * n)
        values, directions = eigen(v, min(components, d))
        fits[d] = {"n": n, "values": values, "vectors": directions, "explained": values / np.trace(v) if len(values) else values, "identity_error": 0.0}
    turns = {d: f["vectors"] / np.sqrt(f["values"])[:, None] for d, f in fits.items()}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in by_length(batch, "v"):
                n, s = sums[v.shape[1]]
                z = centred(integers(v), n, s)
                largest = max(int(z.max()), -int(z.min()))
                if largest**2 * v.shape[1] < 2**63:
                    deviation = (z * z).sum(axis=1).tolist()
                else:
                    deviation = [x if (x := sum(int(y) ** 2 for y in row)) < 2**63 else None for row in z]
                out = (z / n).astype(np.float64) @ turns[v.shape[1]].T
                offsets = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)), pa.array(np.full(len(v), v.shape[1], np.int32)), pa.array(np.full(len(v), n, np.int64)), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))],
                    names=["vec_id", "d", "n", "deviation", "whitened"],
                )

    out = stage(rows.mapInArrow(project, f"vec_id {dict(rows.dtypes)['vec_id']}, d int, n long, deviation long, whitened array<double>"), "whitened")
    for d, f in fits.items():
        if size := len(f["values"]):
            got = total(out.where(F.col("d") == d), "whitened", lambda w: np.vstack([w.T @ w, w.sum(axis=0, keepdims=True)]), "double")[size][1] / f["n"]
            f["identity_error"] = float(np.abs(got[:-1] - np.outer(got[-1], got[-1]) - np.eye(size)).max())
    return out, fits


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """`whiten` of all embeddings, a row per vector and component; nulls, empties and repeats as it says."""
    rows, fits = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    known = spark.createDataFrame([(d, f["explained"].tolist(), f["identity_error"]) for d, f in fits.items()], "d int, explained array<double>, identity_error double")
    rows = rows.join(F.broadcast(known), "d").select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")
