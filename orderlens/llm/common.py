"""What the corpus operators share: the shared folder, staged tables, safe broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words in every operator here.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows, and bytes (as JSON), up to which `small()` lets a side be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 32 << 20

#: Bytes of a batch of texts in a task.
BATCH_BYTES = 4 << 20

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. If that is unset, a temporary one on a local master (tests), an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        made = tempfile.mkdtemp(prefix="orderlens-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own["dir"] = f"file://{made}"
    return _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Batches that travel to Python workers hold about BATCH_BYTES, however long texts are, unless the session has set a limit of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # the default
        spark.conf.set(key, f"{BATCH_BYTES}b")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and lost executors cost no recomputation."""
    small_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def unstage(staged: DataFrame | None) -> None:
    """Deletes what `stage` wrote, once nothing reads it any more. What results read stays until their owner clears the shared folder."""
    if staged is not None and (path := _paths.pop(staged, None)):
        jvm, sc = staged.sparkSession._jvm, staged.sparkSession.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def small(staged: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a staged table for broadcast if its rows and bytes are within the limits; else the join shuffles."""
    one = F.octet_length(F.to_json(F.struct("*"))) if staged.columns else F.lit(0)
    got = staged.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(one), F.lit(0)).alias("bytes")).first()
    return F.broadcast(staged) if got["n"] <= rows and got["bytes"] <= size else staged


def spread(staged: DataFrame, weight: Column, of_task: int) -> DataFrame:
    """The rows dealt out so that a task has about of_task of the weight (a column): for steps that make many rows of one."""
    total = staged.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    least = staged.sparkSession.sparkContext.defaultParallelism
    return staged.repartition(max(least, -(-int(total) // of_task)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it unlike all columns of df (in any case) and the others."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def doc_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits for a document row; rows equal in id and text share it."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def word_count(text: Column) -> Column:
    """Words of a text, null and empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about `size` bytes of a text column, so that long texts don't pile up in a task."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            held += n
            if held >= size:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < len(lengths):
            yield batch.slice(start)
