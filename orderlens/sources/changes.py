"""New orders as a stream with a (time, id) cursor: a streaming data source over the order table.

Other file streams see new files; this one sees new rows, wherever a writer put them. Its offset is the last row that was read, as
(time, id), so rows of equal times at a cut are neither lost nor read twice, and a batch is told by its two ends alone:
restarts read the same rows again. A batch admits at most `limit` rows (more only if one time and id is shared by more).

    spark.dataSource.register(ChangeSource)
    spark.readStream.format("changes").option("path", ...).option("time", "placed_us").option("id", "order_id").option("cursor", ...).load()

Only rows later than the cursor are seen, as with the reference's poll; what is inserted behind it is for `streaming.ordered.missed_by`.
Files are pruned by their row groups' statistics, and each batch's files are dealt to tasks. Paths are those of pyarrow's file
systems (local, HDFS, S3).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Counts of a time range are cut into this many ranges until one is small enough.
FAN = 64
START = {"time": -(2**63), "id": -(2**63)}


class Files(InputPartition):
    def __init__(self, files: list[str], low: dict, high: dict) -> None:
        self.files, self.low, self.high = files, low, high


def after(time: str, id_: str, at: dict) -> ds.Expression:
    """Rows behind the cursor."""
    t, i = ds.field(time), ds.field(id_)
    return (t > at["time"]) | ((t == at["time"]) & (i > at["id"]))


def upto(time: str, id_: str, at: dict) -> ds.Expression:
    t, i = ds.field(time), ds.field(id_)
    return (t < at["time"]) | ((t == at["time"]) & (i <= at["id"]))


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.time, self.id, self.limit, self.tasks = options["path"].removeprefix("file://"), options.get("time", "placed_us"), options.get("id", "order_id"), int(options.get("limit", 10_000)), int(options.get("tasks", 8))
        self.columns = columns
        self.start = json.loads(options["start"]) if "start" in options else dict(START)
        self.cursor = options.get("cursor")
        if not self.cursor:
            raise ValueError("the option cursor is missing: a file beside the query's checkpoint")
        self.end = self._kept() or dict(self.start)

    def _kept(self) -> dict | None:
        files, at = fs.FileSystem.from_uri(self.cursor) if "://" in self.cursor else (fs.LocalFileSystem(), self.cursor)
        if files.get_file_info(at).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(at) as f:
            return json.loads(f.read())

    def _keep(self) -> None:
        files, at = fs.FileSystem.from_uri(self.cursor) if "://" in self.cursor else (fs.LocalFileSystem(), self.cursor)
        with files.open_output_stream(f"{at}.new") as f:
            f.write(json.dumps(self.end).encode())
        files.move(f"{at}.new", at)

    def _table(self) -> ds.Dataset:
        return ds.dataset(self.path, format="parquet", partitioning="hive")

    def initialOffset(self) -> dict:
        return dict(self.start)

    def _next(self, low: dict) -> dict:
        """The cursor after at most `limit` more rows. Rows are counted by ranges of time until the cut's range holds few; only those are sorted."""
        table, none = self._table(), dict(low)
        wanted, lower = self.limit, after(self.time, self.id, low)
        ends = table.scanner(columns=[self.time], filter=lower).to_batches()
        first, last, count = None, None, 0
        for batch in ends:
            if batch.num_rows:
                least, most = pc.min_max(batch.column(0)).values()
                first = least.as_py() if first is None else min(first, least.as_py())
                last = most.as_py() if last is None else max(last, most.as_py())
                count += batch.num_rows
        if not count:
            return none
        while count > self.limit and last > first:
            edges = np.unique(np.linspace(first, last + 1, FAN + 1).astype(np.int64))
            edges[-1] = last + 1
            inside, counts = lower & (ds.field(self.time) >= first) & (ds.field(self.time) <= last), np.zeros(len(edges) - 1, np.int64)
            for batch in table.scanner(columns=[self.time], filter=inside).to_batches():
                counts += np.histogram(batch.column(0).to_numpy(zero_copy_only=False), edges)[0] if batch.num_rows else 0
            sums = np.cumsum(counts)
            at = int(np.searchsorted(sums, wanted))
            before = int(sums[at - 1]) if at else 0
            if sums[at] == wanted:
                first, last, count, wanted = int(edges[at]), int(edges[at + 1]) - 1, int(counts[at]), wanted - before
                break
            wanted -= before
            first, last, count = int(edges[at]), int(edges[at + 1]) - 1, int(counts[at])
            if count <= self.limit:
                break
        inside = lower & (ds.field(self.time) >= first) & (ds.field(self.time) <= last)
        rows = table.to_table(columns=[self.time, self.id], filter=inside).sort_by([(self.time, "ascending"), (self.id, "ascending")])
        row = rows.slice(min(wanted, rows.num_rows) - 1, 1).to_pylist()[0]
        return {"time": row[self.time], "id": row[self.id]}

    def latestOffset(self) -> dict:
        """The end of the next batch. It is kept before Spark logs it, so a restart, which tells a reader no offset, never goes back behind
        what was logged; if it wasn't logged, the next batch starts at the logged end all the same and is larger."""
        if (end := self._next(self.end)) != self.end:
            self.end = end
            self._keep()
        return dict(self.end)

    def partitions(self, start: dict, end: dict) -> list[Files]:
        wanted = after(self.time, self.id, start) & upto(self.time, self.id, end)
        files = sorted({f.path for f in self._table().get_fragments(filter=wanted) if f.subset(wanted).row_groups})
        return [Files(files[i :: self.tasks], start, end) for i in range(min(self.tasks, len(files)))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        table = ds.dataset(self.path, format="parquet", partitioning="hive")
        wanted = after(self.time, self.id, partition.low) & upto(self.time, self.id, partition.high)
        own = set(partition.files)
        for fragment in table.get_fragments(filter=wanted):
            if fragment.path in own:
                yield from fragment.to_batches(schema=table.schema, columns=self.columns, filter=wanted)

    def commit(self, end: dict) -> None:
        pass


class ChangeSource(DataSource):
    """format("changes"): options path, cursor (a file of the query, beside its checkpoint), time and id (columns of integers), limit, tasks, start (a cursor as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(ds.dataset(self.options["path"].removeprefix("file://"), format="parquet", partitioning="hive").schema)

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options), schema.fieldNames())
