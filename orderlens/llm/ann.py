"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots, in order, and posted in the inverted files of the first few. A query goes
to the files of its own nearest pivots only; what it meets there is ranked by footrule distance (a pivot that is missing
counts as the rank after the last), and the closest part is ranked again by exact Euclidean distance. A vector that
stands in several of a query's files is looked at in the one of the pivot nearest to the query.

Equal vectors are one row of the index with the ids that can be asked for, so copies take no places from others. Files
are dealt to groups of a bounded number of rows, and a file that is too long is split by a salt. The number of pivots
grows with the square root of the rows, so a vector is copied as often, and a query meets the same share of the files, at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Pivots at least and at most (in between: four times the root of the rows); their number in a representation; files that a vector is posted in.
PIVOTS, MOST_PIVOTS, PREFIX, POSTED = 512, 8192, 32, 4
#: Share of the files that a query looks into, and how many at least; share of what it meets there that is ranked again.
PROBED, LEAST_PROBED, SHARE = 0.16, 64, 0.75
#: Posted rows of a group of files.
GROUP_ROWS = 32_768
#: Rows of a group that are ranked again besides the share, for each neighbour asked for: tiny tables have k answers.
SPARE = 10


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) without vectors that are null, zero, or hold null or non-finite components."""
    single = dict(vectors.dtypes)[vector_col] == "array<float>"  # exact in double precision, and half the size
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first (ties: the first pivot)."""
    distance = (pivots**2).sum(axis=1) - 2 * (x @ pivots.T)
    return np.argsort(distance, axis=1, kind="stable")[:, :prefix].astype(np.int16)


class Files:
    """A group of inverted files in a task: rows posted under the group's pivots."""

    def __init__(self, perms: np.ndarray, posted: int, pivots: int, group: int, groups: int) -> None:
        self.perms, self.posted, self.prefix, self.pivots, self.group, self.groups = perms, posted, perms.shape[1], pivots, group, groups
        flat = perms[:, :posted].ravel()
        order = np.argsort(flat, kind="stable")
        self.rows, self.start = order // posted, np.searchsorted(flat[order], np.arange(pivots + 1))

    def meet(self, query: np.ndarray, probed: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that a query (all pivots, nearest first) meets here and not under a nearer pivot elsewhere, in order, with their footrule distances."""
        rank = np.empty(self.pivots, np.int32)
        rank[query] = np.arange(self.pivots, dtype=np.int32)
        mine = [p for p in query[:probed].tolist() if p % self.groups == self.group]
        seen = np.zeros(len(self.perms), bool)
        for p in mine:
            seen[self.rows[self.start[p] : self.start[p + 1]]] = True
        at = np.flatnonzero(seen)
        first = self.perms[at, : self.posted]
        nearest = first[np.arange(len(at)), rank[first].argmin(axis=1)]
        at = at[nearest % self.groups == self.group]
        theirs, own = np.minimum(rank[self.perms[at]], self.prefix), np.arange(self.prefix, dtype=np.int32)
        # All ranks from 0 to prefix - 1 that are missing on either side count up to the rank after the last.
        saved = np.where(theirs < self.prefix, 2 * self.prefix - theirs - own - np.abs(theirs - own), 0).sum(axis=1)
        return at, self.prefix * (self.prefix + 1) - saved


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each vector once, with those of its ids, smallest first, that can be among k answers to any query.

    At most k rows of an id can be, and 2 k rows in all: k besides those of the query's own id. Both limits
    are applied before rows are shuffled too, so a vector of very many rows is no hot key.
    """
    limited = rows
    for keys, order, most in ((("v", "vec_id"), "vec_id", k), (("v",), "vec_id", 2 * k)):
        limited = limited.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("n") <= most).drop("n")
    return limited.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def neighbours(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, prefix: int = PREFIX, posted: int = POSTED, probed: float = PROBED, share: float = SHARE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which is_query holds, itself left out.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id. Pivots are the `pivots`
    vectors of smallest hash (a bounded sample); every usable vector is indexed, equal ones once. Rows that repeat an id are
    candidates each, but a query's own id never is; it is asked once, with its smallest vector. Null ids take no part. Vectors of
    different lengths have no distance: each length is an index of its own, so an id with vectors of two lengths is asked in both and its nearest
    of all hold. Other columns, whatever they are called, are not read. Empty in, empty out.
    """
    rows = stage(usable(vectors, id_col, vector_col), "vectors")
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    out = None
    for d in lengths or [0]:
        of_length = rows if len(lengths) < 2 else rows.where(F.size("v") == d)
        found = _found(of_length, is_query, k, pivots, prefix, posted, probed, share, group_rows)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(rows: DataFrame, is_query, k: int, pivots: int | None, prefix: int, posted: int, probed: float, share: float, group_rows: int) -> DataFrame:
    """(query_id, vec_id, score): of each group of files that a query looks into its k nearest; rows (vec_id, v) are of one length."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["v"]
    vectors = stage(distinct(rows, k), "distinct")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "query_id long, vec_id long, score double")
    wanted = pivots or min(MOST_PIVOTS, max(PIVOTS, 1 << int(np.ceil(np.log2(4 * np.sqrt(n))))))
    chosen = np.array([r["v"] for r in vectors.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(wanted).collect()], np.float64)
    many = len(chosen)
    prefix, posted, probed = min(prefix, many), min(posted, prefix, many), min(many, max(LEAST_PROBED, round(probed * many)))
    shared = spark.sparkContext.broadcast(chosen)

    def represent(length: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                    v = part.column("v")
                    p = permutations(v.flatten().to_numpy().reshape(len(v), -1).astype(np.float64), shared.value, length)
                    yield pa.RecordBatch.from_arrays([part.column(0), v, pa.ListArray.from_arrays(np.arange(0, p.size + 1, length, dtype=np.int32), pa.array(p.ravel()))], names=[part.schema.names[0], "v", "p"])

        return run

    index = stage(vectors.select("ids", "v").mapInArrow(represent(prefix), f"ids array<long>, v {kind}, p array<short>"), "index")
    asked = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    # A query's probed pivots, in order; further ones only count as the rank after the last.
    length = max(prefix, probed)
    queries = stage(asked.mapInArrow(represent(length), f"vec_id long, v {kind}, p array<short>"), "queries")
    groups = min(many, max(1, n * posted // group_rows))
    group = lambda p: F.array_distinct(F.transform(p, lambda x: (x % groups).cast("int")))
    placed = index.withColumn("group", F.explode(group(F.slice("p", 1, posted))))
    salts = stage(placed.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / (2 * group_rows)).cast("int").alias("salts")), "salts")  # at most a row a pivot
    left = placed.join(F.broadcast(salts), "group").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int")).drop("salts")
    right = queries.withColumn("group", F.explode(group(F.slice("p", 1, probed)))).join(F.broadcast(salts), "group")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def look(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(ask):
            data = data.assign(first=data["ids"].str[0]).sort_values("first", kind="stable")
            of, x = data["ids"].to_numpy(), np.stack(data["v"].to_numpy()).astype(np.float64)
            files = Files(np.stack(data["p"].to_numpy()), posted, many, int(data["group"].iloc[0]), groups)
            rest = np.arange(many)
            for me, v, p in zip(ask["vec_id"], ask["v"], ask["p"]):
                p = np.asarray(p)
                at, footrule = files.meet(np.concatenate((p, np.setdiff1d(rest, p, assume_unique=True))), probed)
                if not len(at):
                    continue
                top = min(len(at), int(share * len(at)) + SPARE * k)
                # Ties at the edge go to the smaller id: rows are in that order, so the stable order decides.
                edge = np.partition(footrule, top - 1)[top - 1]
                under = np.flatnonzero(footrule < edge)
                at = at[np.concatenate((under, np.flatnonzero(footrule == edge)[: top - len(under)]))]
                d = np.sqrt(((x[at] - np.asarray(v, np.float64)) ** 2).sum(axis=1))
                # One vector may have no id but the query's own; all others have one at least.
                near = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                ids = np.concatenate([of[j] for j in at[near]])
                d = np.repeat(d[near], [len(of[j]) for j in at[near]])
                ids, d = ids[ids != me], d[ids != me]
                best = np.lexsort((ids, d))[:k]
                out += zip([me] * len(best), ids[best].tolist(), d[best].tolist())
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return left.groupBy("group", "salt").cogroup(right.groupBy("group", "salt")).applyInPandas(look, "query_id long, vec_id long, score double")


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    """`neighbours` of every hundredth vector; nulls, zeros, repeats and other lengths as it says."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours(rows, lambda vec_id: vec_id % 100 == 0)
