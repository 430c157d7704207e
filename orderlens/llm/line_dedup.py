"""Line dedup: deletion-neighbourhood join over all lines of a corpus.

A line goes if an equal line, or one within the edit bound, stands earlier in the corpus (by doc_id,
then line number). Lines are compared lower-cased with white space collapsed; lines without a letter or
digit (blank ones, rulers, brackets) are left alone. The edit bound holds for lines of `edit_chars` characters
or more: in shorter ones a single edit makes another word.

Equal lines meet by hash. For the edit bound, every line emits its text without one character, for each
character, as a hashed key. Lines that share a key are within two edits, and within one if they lost
the character at the same place or if one of them is the key itself; so each key's lines are linked only
to the earliest of the same place and to the whole line, and no pairs within a group are spelled out.
Before that, a line is set aside if no other line shares its first or its last 2**k characters (k the
largest with 2 * 2**k < length): one edit leaves one of the two intact, so such a line has no partner. By
the same rule a line that shares only one end emits only deletions outside that end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, doc_key, fresh, small, spread, stage

EDIT_CHARS = 20
#: Variants that a task emits; rows of a batch of them.
TASK_VARIANTS, BATCH = 1 << 21, 1 << 16
#: Odd multiplier of the variants' polynomial hash, mod 2**64.
BASE = 0x9E3779B97F4A7C15


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), f"[{SPACE}]+", " "))


def half(length: str) -> Column:
    """The largest power of two of which two are shorter than a line of this length (at least 3)."""
    return F.expr(f"shiftleft(1, length(bin(({length} - 1) div 2)) - 1)")


def occurrences(docs: DataFrame, edit_chars: int) -> DataFrame:
    """A row per line that counts: document key and id, line number, hash, and the keys of its ends (first, last, of both lengths)."""
    lines = docs.select(doc_key().alias("dkey"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("dkey", "doc_id", "line_no", normal(F.col("line")).alias("line")).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    lines = lines.withColumn("n", F.length("line")).withColumn("p", half("n")).withColumn("q", half("(n - 1)"))
    ends = [F.xxhash64(F.lit(end), F.col(p), part) for p in "pq" for end, part in (("first", F.expr(f"left(line, {p})")), ("last", F.expr(f"right(line, {p})")))]
    keys = F.when(F.col("n") < edit_chars, F.array().cast("array<bigint>")).when(F.col("p") == F.col("q"), F.array(*ends[:2])).otherwise(F.array(*ends))
    return lines.select("dkey", "doc_id", "line_no", F.xxhash64("line").alias("h"), keys.alias("keys"))


def place() -> Column:
    """Where a line stands: null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "dkey", "line_no")


def _coded(line: str) -> np.ndarray:
    """A mixed 64-bit word for each character."""
    x = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variants(line: str) -> np.ndarray:
    """Hashes of the line (first) and of the line without its i-th character, for each i, as signed longs."""
    x = _coded(line)
    powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(x), BASE, np.uint64))))
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * powers[:-1])))
    back = np.uint64(pow(BASE, -1, 1 << 64))
    out = np.concatenate((before[-1:], before[:-1] + (before[-1] - before[1:]) * back))
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def emitted(n: int, sides: int) -> slice:
    """Places whose deletions a line of n characters emits: sides 1, its first end is shared; 2, its last; 3, both."""
    least = 1 << (max(1, (n - 2) // 2).bit_length() - 1)
    return slice(least if sides == 1 else 0, n - least if sides == 2 else n)


def emit_variants(lines: DataFrame) -> DataFrame:
    """(v, place, ord) for each line (ord, line, sides); place -1: the whole line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            out = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["v", "place", "ord"])

        for batch in batches:
            for ord_, line, sides in zip(*(batch.column(c).to_pylist() for c in ("ord", "line", "sides"))):
                v = variants(line)
                cut = emitted(len(v) - 1, sides)
                at = np.arange(len(v) - 1, dtype=np.int32)[cut]
                held.append((np.concatenate((v[:1], v[1:][cut])), np.concatenate((np.full(1, -1, np.int32), at)), np.full(len(at) + 1, ord_, np.int64)))
                rows += len(at) + 1
                if rows >= BATCH:
                    yield flush()
                    rows = 0
        if held:
            yield flush()

    return spread(lines, F.length("line"), TASK_VARIANTS).mapInArrow(run, "v long, place int, ord long")


def near_lines(lines: DataFrame) -> DataFrame:
    """ord of each line (ord, line, sides; lines distinct, ord by first place) that is one edit from one of smaller ord."""
    out = emit_variants(lines.select("ord", "line", "sides")).repartition("v")
    same = Window.partitionBy("v", "place").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    bucket = Window.partitionBy("v").orderBy("place", "ord").rowsBetween(Window.unboundedPreceding, 0)
    met = out.withColumn("a", F.first("ord").over(same)).withColumn("whole", F.when(F.first("place").over(bucket) == -1, F.first("ord").over(bucket)))
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
    pairs = met.where("place >= 0 and (a != ord or whole != ord)").select(F.explode(F.array(pair("ord", "a"), pair("ord", F.coalesce("whole", "ord")))).alias("e"))
    pairs = pairs.select("e.hi", "e.lo").where("hi != lo").distinct()
    texts = lines.select(F.col("ord").alias("hi"), F.col("line").alias("hi_line")), lines.select(F.col("ord").alias("lo"), F.col("line").alias("lo_line"))
    checked = pairs.join(texts[0], "hi").join(texts[1], "lo").where(F.levenshtein("hi_line", "lo_line", 1) == 1)
    return checked.select(F.col("hi").alias("ord")).distinct()


def dropped_lines(docs: DataFrame, edits: int = 1, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """(dkey, drop): the numbers of the lines that go, for each document key that has any."""
    if edits not in (0, 1) or edit_chars < 4:
        raise ValueError("edits must be 0 or 1, and edit_chars at least 4")
    found = stage(occurrences(docs, edit_chars), "lines")
    lines = stage(found.groupBy("h").agg(F.count("*").alias("n"), F.min(place()).alias("first"), F.any_value("keys").alias("keys")), "distinct-lines")
    near = None
    if edits:
        keys = lines.select("h", F.posexplode("keys").alias("side", "key"))
        shared = stage(keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key"), "keys")
        some = stage(keys.join(shared, "key", "left_semi").groupBy("h").agg(F.bit_or(F.expr("1 + side % 2")).cast("int").alias("sides")), "some")
        wanted = stage(lines.join(some, "h").select("h", "sides", "first.*").groupBy("dkey").agg(F.collect_list(F.struct("h", "sides", "no_id", "doc_id", "line_no")).alias("at")), "wanted")
        texts = docs.select(doc_key().alias("dkey"), "text").join(small(wanted), "dkey").select("dkey", F.split("text", "\n").alias("lines"), F.explode("at").alias("at"))
        texts = texts.select("dkey", "at.*", normal(F.expr("lines[at.line_no]")).alias("line")).dropDuplicates(["h"])
        order = ["no_id", "doc_id", "dkey", "line_no"]
        texts = stage(texts.orderBy(*order).select("h", "line", "sides", F.monotonically_increasing_id().alias("ord")), "texts")
        near = texts.join(near_lines(texts), "ord", "left_semi").select("h", F.lit(True).alias("near"))
        lines = lines.join(near, "h", "left")
    else:
        lines = lines.withColumn("near", F.lit(None).cast("boolean"))
    judged = stage(lines.where("n > 1 or near").select("h", F.col("first.dkey").alias("first_dkey"), F.col("first.line_no").alias("first_line"), F.coalesce("near", F.lit(False)).alias("near")), "judged")
    gone = found.join(judged, "h").where("near or dkey != first_dkey or line_no != first_line")
    return gone.groupBy("dkey").agg(F.collect_set("line_no").alias("drop"))


def dedup_lines(docs: DataFrame, edits: int = 1, edit_chars: int = EDIT_CHARS, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the text left after line dedup, and n_lines, n_dropped (int).

    Needs doc_id and text; columns called like the results (names) are replaced, others pass through. Null texts
    stay null with no lines; lines without a letter or digit always stay. Rows equal in doc_id and text count as one document
    and get the same text; null ids come last. One document's line numbers are the only thing gathered in one row.
    Empty in, empty out.
    """
    docs = docs.drop(*names)
    n_lines, n_dropped, key, drop, pieces = fresh(docs, *names, "_dkey", "_drop", "_lines")
    drops = small(stage(dropped_lines(docs, edits, edit_chars), "drops")).select(F.col("dkey").alias(key), F.col("drop").alias(drop))
    rows = docs.withColumn(key, doc_key()).join(drops, key, "left")
    # No lambda over the drops for each line: set difference is linear, so long documents stay cheap.
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(drop))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(pieces), i)), "\n"))
    rows = rows.withColumn(pieces, F.split("text", "\n")).withColumn(n_lines, F.when(F.col("text").isNull(), 0).otherwise(F.size(pieces)))
    rows = rows.withColumn(n_dropped, F.coalesce(F.size(drop), F.lit(0))).withColumn("text", text)
    return rows.select(*docs.columns, n_lines, n_dropped)


def left_after(docs: DataFrame, edits: int = 1, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """The documents (all columns, whatever they are called) with the text left; those that lose all their text go."""
    names = tuple(fresh(docs, "n_lines", "n_dropped"))
    left = dedup_lines(docs, edits, edit_chars, names)
    return left.where((F.col(names[1]) == 0) | F.col("text").rlike(f"[^{SPACE}]")).select(*docs.columns)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """`dedup_lines` of all documents; nulls, empties and repeats as it says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE = f"""
WITH lines AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS raw, trim(regexp_replace(lower(ls[i]), '[ \\t-\\r]+', ' ', 'g')) AS line
               FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
kept AS (SELECT * FROM lines WHERE regexp_matches(line, '[\\p{{L}}\\p{{N}}]')),
firsts AS (SELECT line, min({{'d': doc_id, 'l': line_no}}) AS first FROM kept GROUP BY line),
ends AS (SELECT DISTINCT line, first, side, p, CASE side WHEN 0 THEN left(line, p) ELSE right(line, p) END AS part
         FROM (SELECT line, first, side, (1 << (length(bin((length(line) - 1 - less) // 2)) - 1))::BIGINT AS p
               FROM firsts, (VALUES (0), (1)) s(side), (VALUES (0), (1)) l(less) WHERE length(line) >= {EDIT_CHARS})),
near AS (SELECT DISTINCT b.line FROM ends a JOIN ends b ON a.side = b.side AND a.p = b.p AND a.part = b.part
         WHERE a.first < b.first AND abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= 1),
gone AS (SELECT DISTINCT k.doc_id, k.line_no FROM kept k JOIN firsts f USING (line)
         WHERE k.doc_id <> f.first.d OR k.line_no <> f.first.l OR k.line IN (SELECT line FROM near)),
left_over AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line_no) AS n_dropped,
                     coalesce(string_agg(l.raw, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL), '') AS text
              FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_dropped, 0)::INT AS n_dropped, o.text
FROM documents d LEFT JOIN left_over o ON d.doc_id = o.doc_id
"""
