"""WARC archives as seekable Zstandard bundles.

Each task writes bundles of independent frames (some records each), a skippable frame with the seek table
at the end (sizes of all frames; the public seekable format), and index rows that map record identifiers to
a bundle, a frame and an offset within the frame. Bundles get names of their own for each attempt and count
only if the index lists them, so a lost executor or a repeated task leaves no half-written archive in use.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small, stage

#: Fixed values of the seekable format: magic numbers of a skippable frame and of the seek table's footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame, and of compressed frames in a bundle, from which a new one begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 16 << 20
#: Rows of a payload that meet in one task.
GROUP_ROWS = 4_096
INDEX = "page_id long, bundle string, frame int, frame_at long, frame_bytes int, record_at int, record_bytes int, digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no body and names the record that it refers to."""
    body = payload if refers_to is None else b""
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Payload-Length": str(len(payload)),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": str(len(body)),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a frame: headers and body."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        n = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 8 + n


class Bundle:
    """Frames of one bundle in memory: about BUNDLE_BYTES, or one record if that is longer."""

    def __init__(self) -> None:
        self.name, self.frames, self.sizes, self.index, self.open, self.held = f"{uuid.uuid4().hex}.warc.zst", [], [], [], [], 0

    def add(self, page_id: int | None, payload_digest: str, data: bytes) -> None:
        self.open.append((page_id, payload_digest, self.held, len(data), data))
        self.held += len(data)
        if self.held >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = zstandard.ZstdCompressor(level=3).compress(b"".join(x[4] for x in self.open))
            at = sum(c for c, _ in self.sizes)
            self.index += [(p, self.name, len(self.frames), at, len(frame), a, n, d) for p, d, a, n, _ in self.open]
            self.sizes.append((len(frame), self.held))
            self.frames.append(frame)
            self.open, self.held = [], 0

    def data(self) -> bytes:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table

    def full(self) -> bool:
        return sum(c for c, _ in self.sizes) >= BUNDLE_BYTES


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, read from the bundle's end."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table at the bundle's end")
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - i))
        out.append((at, c, d))
        at += c
    return out


def judge(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the smallest page_id with an equal payload of at least `least` bytes, if another.

    A payload of very many rows is salted by their number; its smallest id is copied to each salt. Null html is
    empty. Rows with a null page_id are revisits if another row has the payload's smallest id. Rows that repeat
    the smallest id are responses each. Other columns are not read. Empty in, empty out.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    first = pages.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stage(first.withColumn("salts", F.ceil(F.col("n") / GROUP_ROWS).cast("int")).select("sha", "first", "salts"), "firsts")
    # At most a row in GROUP_ROWS; beyond the limits of a broadcast this join shuffles hashes of hot payloads only.
    hot = small(first.where("salts > 1").select("sha", F.col("salts").alias("of")))
    dealt = pages.join(hot, "sha", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("of", F.lit(1))).cast("int")).drop("of")
    first = small(first).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return dealt.join(first, ["sha", "salt"], "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Writes bundles to path/bundles and the index to path/index, and returns the index (INDEX).

    A record per row, repeated rows too, as `judge` says for nulls; a null url is empty, line breaks in one are blanks. No rows: no bundles, an empty index.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(f"{path}/bundles")
        store.create_dir(root, recursive=True)
        bundle = Bundle()

        def finish() -> Iterator[pa.RecordBatch]:
            bundle.close_frame()
            if bundle.frames:
                with store.open_output_stream(f"{root}/{bundle.name}", compression=None) as out:
                    out.write(bundle.data())
                columns = list(zip(*bundle.index))
                types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (c[i].as_py() for c in columns)
                payload = html.encode()
                d = digest(payload)
                bundle.add(page_id, d, record(page_id, url, payload, d, refers_to))
                if bundle.full():
                    yield from finish()
                    bundle = Bundle()
        yield from finish()

    index = judge(pages, least).mapInArrow(run, INDEX)
    index.write.option("compression", "zstd").parquet(f"{path}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


def read(index: DataFrame, path: str) -> DataFrame:
    """All records of the bundles in the index, frame by frame: page_id, url, type, refers_to, digest, length, body. A task a bundle; an empty index gives none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(f"{path}/bundles")
        number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with store.open_input_file(f"{root}/{name}") as file:
                    data_size = file.size()
                    tail = file.read_at(min(data_size, 9), max(0, data_size - 9))
                    tail_size = 9 + 8 * struct.unpack("<I", tail[:4])[0]
                    for at, c, d in seek_table(file.read_at(tail_size, data_size - tail_size)):
                        found = list(parse(zstandard.ZstdDecompressor().decompress(file.read_at(c, at), max_output_size=d)))
                        heads = [h for h, _ in found]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([number(h["WARC-Record-ID"]) for h in heads], pa.int64()),
                                pa.array([h["WARC-Target-URI"] for h in heads], pa.string()),
                                pa.array([h["WARC-Type"] for h in heads], pa.string()),
                                pa.array([number(h.get("WARC-Refers-To")) for h in heads], pa.int64()),
                                pa.array([h["WARC-Payload-Digest"][5:] for h in heads], pa.string()),
                                pa.array([int(h["WARC-Payload-Length"]) for h in heads], pa.int64()),
                                pa.array([b for _, b in found], pa.binary()),
                            ],
                            names=["page_id", "url", "type", "refers_to", "digest", "length", "body"],
                        )

    bundles = index.select("bundle").distinct()
    return bundles.repartition(max(1, bundles.count())).mapInArrow(run, "page_id long, url string, type string, refers_to long, digest string, length long, body binary")


def fetch(index: DataFrame, path: str) -> DataFrame:
    """(page_id, data): the single records of the index rows given (repeated ones again), by one seek each, without reading whole bundles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(f"{path}/bundles")
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with store.open_input_file(f"{root}/{r['bundle']}") as file:
                    frame = zstandard.ZstdDecompressor().decompress(file.read_at(r["frame_bytes"], r["frame_at"]))
                out.append((r["page_id"], frame[r["record_at"] : r["record_at"] + r["record_bytes"]]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["page_id", "data"])

    return index.mapInArrow(run, "page_id long, data binary")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """A WARC record per page, written and read back. Digests and lengths of responses are taken from the bodies read."""
    path = new_path(spark, "warc")
    back = read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path), path)
    body = F.col("type") == "response"
    return back.select(
        "page_id", F.when(body, F.length("body").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", F.when(body, F.sha1("body")).alias("body_sha1"),
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h),
b AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(bits, i, 5))::INT, 1), '' ORDER BY i) AS payload_digest
      FROM (SELECT page_id, bits, unnest(range(1, 161, 5)) AS i FROM (SELECT page_id, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '') AS bits FROM h)) GROUP BY page_id)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, CASE WHEN page_id = first THEN hex END AS body_sha1
FROM f JOIN b USING (page_id)
"""
