"""Quality rules with cross-document line frequency, in SQL functions only.

A document's own measures (symbols, repeated lines, words in repeated five-word windows) fail it by fixed rules. Then its
lines are normalised and hashed together with their host, and each host counts in how many different texts a line stands
(copies of one text count once: they are for near-dedup). A line above both limits, a number of texts and a share of the
host's, is boilerplate there and is taken out; a document is rejected if it was depleted, i.e. most of its words went.

Texts are read once: what is written of them is measures, and a hash and a number of words a line. Counting goes by (line, text)
first, so the line that all documents of a host share is counted in as many tasks as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small, stage

#: Words of a window; base rules: fewest words, and the most words (per cent) in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: A line is boilerplate in a host if it stands in more texts than this, and in more than this share of the host's texts.
MOST_TEXTS, MOST_SHARE = 10, 0.01
#: A document is depleted if more than this share of its words stood in such lines.
DEPLETED = 0.7
SYMBOLS = r"[#*$%&|<>]"
#: Rows of one key that a task of a join may get before the key is salted.
SALT_ROWS = 1_000_000

#: White space that is not one blank between words of a line.
UNEVEN = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"


def pairs(left: Column, right: Column, apart: Column | int, n: Column) -> Column:
    """n hashes: of left's i-th and right's (i + apart)-th hash."""
    return F.zip_with(F.slice(left, 1, n), F.slice(right, F.lit(1) + apart, n), lambda x, y: F.xxhash64(x, y))


def covered(starts: Column, size: int = WINDOW) -> Column:
    """Words that windows at these places (ascending) cover."""
    each = F.transform(starts, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - x, F.lit(size))))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x).cast("long")


def with_repeats(rows: DataFrame) -> DataFrame:
    """rows with n_repeat_words in the place of `words`: words in five-word windows that are found twice or more in the text.

    A window's hash is put together of hashes of two, four and five words. Only texts that have a hash twice are sorted, by (hash, place).
    Each step is a column of its own, so that no step is computed again for every element of the next.
    """
    n, none = F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)), F.array().cast("array<bigint>")
    rows = rows.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("two", F.when(n > 0, pairs(F.col("one"), F.col("one"), 1, n + 2)).otherwise(none))
    rows = rows.withColumn("four", F.when(n > 0, pairs(F.col("two"), F.col("two"), 2, n)).otherwise(none))
    rows = rows.withColumn("five", F.when(n > 0, pairs(F.col("four"), F.col("one"), 4, n)).otherwise(none)).drop("words", "one", "two", "four")
    ranked = F.sort_array(F.transform("five", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    rows = rows.withColumn("ranked", F.when(F.size(F.array_distinct("five")) < F.size("five"), ranked)).drop("five")
    same = lambda e, i: F.coalesce(F.get("ranked", i)["h"] == e["h"], F.lit(False))
    twice = F.filter("ranked", lambda e, i: same(e, i - 1) | same(e, i + 1))
    rows = rows.withColumn("starts", F.when(F.col("ranked").isNotNull(), F.sort_array(F.transform(twice, lambda e: e["at"])))).drop("ranked")
    return rows.withColumn("n_repeat_words", F.when(F.col("starts").isNull(), 0).otherwise(covered(F.col("starts")))).drop("starts")


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A staged row per document: row (unique), its key, hashes of host and text, base measures, and of each \\n-split line its
    (h: hash of host and normalised line, null if it has no word; n: words). Lines are the same in lower case, with white
    space collapsed and numbers alike."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), _key(id_col, text_col, host_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("even", F.regexp_replace("text", UNEVEN, " "))
    rows = rows.withColumn("trimmed", F.transform(F.split("even", "\n"), lambda x: F.trim(x)))
    rows = rows.withColumn("norms", F.transform(F.split(F.regexp_replace(F.lower("even"), "[0-9]+", "0"), "\n"), lambda x: F.trim(x))).drop("even")
    line = lambda x: F.struct(F.when(x != "", F.xxhash64("host", x)).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))
    wordy = F.filter(F.split("text", "\n"), lambda x, i: F.get("trimmed", i) != "")
    rows = rows.withColumn("lines", F.transform("norms", line)).withColumn("wordy", wordy).drop("norms")
    rows = rows.withColumn("joined", F.array_join(F.filter("trimmed", lambda x: x != ""), " ")).drop("trimmed")
    rows = rows.withColumn("words", F.when(F.col("joined") == "", F.array().cast("array<string>")).otherwise(F.split("joined", " ")))
    n_words = F.size("words").cast("long")
    rows = rows.select(
        "doc_id", F.xxhash64("host", F.lit("host")).alias("host"), F.xxhash64("text", F.lit("text")).alias("same"), "key", n_words.alias("n_words"),
        (F.length("joined") - F.greatest(n_words - 1, F.lit(0))).alias("word_chars"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("wordy") - F.size(F.array_distinct("wordy"))).cast("long").alias("n_dup_lines"), "lines", "words",
    )
    return stage(with_repeats(rows).withColumn("row", F.monotonically_increasing_id()), "measured")


def _key(id_col: str, text_col: str, host_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.lit("id"), F.col(text_col), F.lit("text"), F.col(host_col).cast("string"))


def salted(rows: DataFrame, side: DataFrame, key: str, most: int) -> DataFrame:
    """rows joined with side on key; a key of up to `most` rows is dealt to that many tasks more as it has SALT_ROWS."""
    salts = -(-most // SALT_ROWS)
    if salts <= 1:
        return rows.join(side, key)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    return rows.join(side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), [key, "_salt"]).drop("_salt")


def boilerplate(rows: DataFrame, most_texts: int = MOST_TEXTS, most_share: float = MOST_SHARE) -> DataFrame:
    """(h, n_texts): the lines above both limits in their host, from `measured` rows."""
    lines = rows.select("host", "same", F.explode("lines").alias("line")).select("host", "same", "line.h").where("h is not null")
    seen = lines.select("host", "h", "same").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_texts"))
    many = stage(seen.where(F.col("n_texts") > most_texts).select("host", "h", "n_texts", F.col("h").alias("row")), "many")
    texts = rows.select("host", "same").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    hosts = stage(texts, "hosts")
    most = many.groupBy("host").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    above = salted(many, small(hosts), "host", most).where(F.col("n_texts") > F.col("texts") * F.lit(float(most_share)))
    return stage(above.select("h", "n_texts"), "boilerplate")


def line_hits(rows: DataFrame, above: DataFrame) -> DataFrame:
    """(row, key, line_no, n): the lines of `measured` rows that are boilerplate, with their words."""
    lines = rows.select("row", "key", F.posexplode("lines").alias("line_no", "line")).select("row", "key", "line_no", "line.h", "line.n").where("h is not null")
    most = above.agg(F.coalesce(F.max("n_texts"), F.lit(0))).first()[0]
    return salted(lines, small(above.select("h")), "h", most)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_texts: int = MOST_TEXTS, most_share: float = MOST_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_boilerplate_words, base_failed, kept.

    Null and empty texts have no word and fail the base rules. A null host is a host of its own. Repeated rows stay, each
    with its own row; equal texts of a host count once towards a line's limits. Ids may be null or repeat. Other columns of
    docs are not read, whatever they are called. An empty table gives an empty table.
    """
    rows = measured(docs, id_col, text_col, host_col)
    gone = line_hits(rows, boilerplate(rows, most_texts, most_share)).groupBy("row").agg(F.sum("n").alias("n_boilerplate_words"))
    out = rows.drop("lines").join(small(stage(gone, "depleted")), "row", "left").fillna(0, ["n_boilerplate_words"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kept = ~failed & (F.col("n_boilerplate_words") <= F.col("n_words") * F.lit(float(depleted)))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate_words"]
    return out.select(*names, failed.alias("base_failed"), kept.alias("kept"))


def clean(docs: DataFrame, most_texts: int = MOST_TEXTS, most_share: float = MOST_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """The documents that are kept (all columns, of any names), without their boilerplate lines.

    Needs doc_id, text, source. Rows equal in these three share their verdict and text. The numbers of one document's lines
    are the only thing gathered in one row.
    """
    rows = measured(docs, "doc_id", "text", "source")
    hits = line_hits(rows, boilerplate(rows, most_texts, most_share)).groupBy("row", "key").agg(F.sum("n").alias("gone_words"), F.collect_set("line_no").alias("gone"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    verdicts = rows.select("row", "key", failed.alias("failed"), "n_words").join(hits.drop("key"), "row", "left")
    verdicts = verdicts.where(F.col("failed") | F.col("gone_words").isNotNull()).groupBy("key").agg(
        F.max(F.col("failed") | F.coalesce(F.col("gone_words") > F.col("n_words") * F.lit(float(depleted)), F.lit(False))).alias("rejected"), F.first("gone", True).alias("gone")
    )
    key, rejected, gone, lines = fresh(docs, "_key", "_rejected", "_gone", "_lines")
    known = small(stage(verdicts, "verdicts")).select(F.col("key").alias(key), F.col("rejected").alias(rejected), F.col("gone").alias(gone))
    out = docs.withColumn(key, _key("doc_id", "text", "source")).join(known, key, "left").where(F.coalesce(~F.col(rejected), F.lit(True)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return out.withColumn(lines, F.split("text", "\n")).withColumn("text", text).select(*docs.columns)


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    """`quality` of all documents with their source as host; nulls, empties and repeats as it says."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^ \\t-\\r]+') AS w FROM docs),
windows AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, sum(least({WINDOW}, coalesce(later - i, {WINDOW})))::BIGINT AS n
            FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS later FROM twice) GROUP BY r),
lines AS (SELECT r, source, text, line, len(regexp_extract_all(line, '[^ \\t-\\r]+')) AS n,
                 trim(regexp_replace(regexp_replace(lower(line), '[ \\t-\\r]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS norm
          FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^ \\t-\\r]')),
dups AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM docs GROUP BY source),
above AS (SELECT l.source, norm FROM (SELECT source, norm, count(DISTINCT text) AS n FROM lines GROUP BY source, norm) l
          JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE n > {MOST_TEXTS} AND n > texts * {MOST_SHARE}::DOUBLE),
gone AS (SELECT r, sum(n)::BIGINT AS n FROM lines l JOIN above a ON l.norm = a.norm AND l.source IS NOT DISTINCT FROM a.source GROUP BY r),
found AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[ \\t-\\r]+', '', 'g'))::BIGINT AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
                 coalesce(repeats.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_boilerplate_words
          FROM docs d JOIN words USING (r) LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND n_boilerplate_words <= n_words * {DEPLETED}::DOUBLE AS kept
FROM found
"""
