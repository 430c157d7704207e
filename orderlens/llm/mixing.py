"""Mixing sources to target weights: capped water-filling.

Every source asks for its weight's share of the mix; one that would repeat its text more than
`max_epochs` times is clamped there, and the rest is shared again by weight until no target is above.
In closed form: sort sources by cap over weight, and find the first prefix of clamped ones after which
the level (what is left over the weights that are left) fits under the next cap.

A document is taken floor(target / size of its source) times whole, and a fraction of its words once more: a run that
starts at a seeded word and goes on at the document's start when it meets its end, so every word is as likely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, fresh, small, stage, word_count

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, the only thing that isn't distributed (two numbers a source meet in one task).

    Sources by code point, null last, take the weights in turn. Sources of size 0 get 0.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("goal", F.sum("source_size").over(everything) * F.lit(share))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("goal") - F.col("full")) / F.col("rest")).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything).getField("level")
    return rows.withColumn("level", level).select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and taken: the words of each document that the mix takes.

    Each row counts as a document: repeated rows too. Null text: size 0. Null source: a source of its own,
    last. Null doc_id: all such rows draw the same number. Equal seeds give equal mixes. Columns that are
    called like the results are replaced; others pass through. Empty in, empty out.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    sized = docs.withColumn("size", word_count(F.col("text")))
    sizes = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    (of,) = fresh(docs, "_source")
    goal = small(stage(targets(sizes, weights, share, max_epochs), "targets")).withColumnRenamed("source", of)
    rows = sized.join(goal, F.col("source").eqNullSafe(F.col(of)), "left").drop(of)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(times)
    return rows.withColumn("taken", (whole * F.col("size") + F.least(F.floor((times - whole) * F.col("size") + draw), F.col("size"))).cast("long")).select(*docs.columns, "size", "source_size", "target", "taken")


def _rest() -> Column:
    """How many words the mix takes of a row beside its whole repetitions."""
    return F.when(F.col("size") > 0, F.pmod(F.col("taken"), F.col("size"))).otherwise(0)


def _whole() -> Column:
    return F.when(F.col("size") > 0, (F.col("taken") - _rest()) / F.col("size")).otherwise(0).cast("int")


def _cut(n: Column, seed: str) -> Column:
    """n words (fewer than all) of the text, from a word drawn by seed, id and text, and on at the text's start after a line break; white space within stays."""
    words = F.regexp_extract_all("text", F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0))
    size = F.col("size").cast("int")
    start = F.pmod(F.xxhash64(F.lit(f"{seed}:start"), F.col("doc_id").cast("string"), "text"), F.col("size")).cast("int")
    run = lambda at, many: F.regexp_replace(F.array_join(F.slice(words, at, many), ""), rf"^[{SPACE}]+", "")
    over = start + n - size
    return F.when(over > 0, F.concat_ws("\n", run(start + 1, size - start), run(F.lit(1), over))).otherwise(run(start + 1, n))


def spelled(mixed: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of `mix` with what the mix takes: the text `whole` times (int), and `part` once (string; null: nothing).

    Null and empty texts: 0 times and no part. Repeated rows take theirs each. Columns called whole and part are replaced. No rows, none.
    """
    mixed = mixed.drop("whole", "part")
    return mixed.withColumn("whole", _whole()).withColumn("part", F.when(_rest() > 0, _cut(_rest().cast("int"), seed)))


def repetitions(mixed: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: a row per whole repetition and one for the fraction, with its text, from the rows of `mix`.

    Rows of size 0 or taken 0, null and empty texts among them, give none; repeated rows give their repetitions each. No rows, no mix.
    The fraction starts at a word drawn by seed, id and text. White space within it stays; where it goes on at the start, a line break parts the two.
    """
    parts = F.concat(F.array_repeat(F.col("size"), _whole()), F.when(_rest() > 0, F.array(_rest())).otherwise(F.array().cast("array<bigint>")))
    rows = mixed.withColumn("n_words", F.explode(parts))
    return rows.withColumn("text", F.when(F.col("n_words") == F.col("size"), F.col("text")).otherwise(_cut(F.col("n_words").cast("int"), seed)))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """`mix` of all documents; nulls, empties and repeats as it says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap,
            1.5::DOUBLE * sum(source_size) OVER () AS goal FROM sizes),
filled AS (SELECT *, (goal - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM weighed
           WINDOW before AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lowest AS (SELECT *, first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM filled),
goals AS (SELECT source, source_size, CASE WHEN lv IS NULL THEN cap ELSE least(cap, lv * w) END::DOUBLE AS target FROM lowest),
drawn AS (SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END::DOUBLE AS times,
          ('0x' || substr(md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS draw
          FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (floor(times) * size + least(floor((times - floor(times)) * size + draw), size))::BIGINT AS taken FROM drawn
"""
