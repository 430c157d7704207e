"""SimHash near-duplicates: meet-in-the-middle ball hashing.

Each document gets a 64-bit fingerprint. Every distinct fingerprint emits all variants within half
the radius; two fingerprints within the radius share a variant, and those that share one are within
the radius. Buckets hold at most 65 distinct fingerprints at radius 2, however many documents share
them, so no key is hot. Links go to the bucket's first member, which keeps connectivity without all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_key, fresh, slices, small, spread, stage
from .components import components

SEED = 42
#: Shingles whose bits are unpacked at once; fingerprints that a task turns into variants.
BLOCK, BALLS = 1 << 15, 1 << 15


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of the text's word shingles in order (A-Z lower-cased); a shorter text is one shingle, no word none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none: 0."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the text's word shingles (repeats count); no word: 0."""
    return simhash(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, row, fp): fp is the fingerprint as a signed long, row a hash of id and text. Null and empty texts: 0. One row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(fps)], names=["doc_id", "row", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", doc_key().alias("row"), "text").mapInArrow(run, "doc_id long, row long, fp long")


def masks(radius: int) -> list[int]:
    """All signed 64-bit words with at most radius bits set."""
    out = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between the nodes (node, fp; fp distinct) of each variant's bucket and its smallest node, verified."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: each side emits the ball of half of it")
    flips = F.explode(F.array(*[F.lit(m) for m in masks(radius // 2)]))
    balls = spread(nodes.select("node", "fp"), F.lit(1), BALLS).select("node", "fp", flips.alias("flip")).select("node", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    bucket = Window.partitionBy("variant").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    met = balls.select("node", "fp", F.first("node").over(bucket).alias("to"), F.first("fp").over(bucket).alias("to_fp"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("to_fp"))) <= radius
    return met.where((F.col("node") != F.col("to")) & near).select(F.col("node").alias("a"), F.col("to").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Fingerprints at most `radius` bits apart are linked. Null and empty texts have fingerprint zero and are
    linked like others. A null doc_id gets its fingerprint's component (null if no row with an id has that
    fingerprint). Repeated rows stay. Other columns of docs are not read. An empty table gives an empty table.
    """
    found = _grouped(docs, id_col, text_col, width, radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> DataFrame:
    prints = stage(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = stage(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    roots = components(links(nodes, radius))
    found = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(found, "fp", "left")


def dedup(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The documents (all columns, any names) whose fingerprint's component has no earlier doc_id.

    Rows go by id and text: of rows that repeat the first id of a component, each stays, and so do rows with a null doc_id.
    """
    (key,) = fresh(docs, "_row")
    gone = _grouped(docs, "doc_id", "text", width, radius).where("doc_id != component_id").select(F.col("row").alias(key)).distinct()
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.join(small(stage(gone, "copies")), own == F.col(key), "left_anti")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """`near_duplicates` of all documents; nulls, empties and repeats as it says."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
