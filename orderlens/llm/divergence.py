"""Source divergence audit: how unlike the sources of a language are in the terms they use, and by which terms.

Every (lang, source) group gives each term that its language keeps an integer share p of a billion, smoothed by one; a group
with shares q is p's price list, and floor((p - q)**2 / q) is what a term costs. The sum over all kept terms is the pair's
divergence, both ways; against the whole language's shares the dearest terms show what a source has too much of.

Terms are counted in each task before they are shuffled, by (lang, term): a frequent term comes once a source and flush. In
that shuffle each kept term gets an id in order, and ids are cut into blocks of 2**BLOCK rows, so nothing that a task merges grows
with the corpus, the vocabulary or a hot source. Sparse merges are pair tasks: the sorted (term id, count) arrays of a
block's groups meet in tiles of TILE sources, and each unordered pair looks its shorter array up in the longer one. Only
terms that both have need that: what one-sided terms cost follows from how often each count occurs in a group, and what
terms cost that neither has from their number. Overlaps are then corrected both ways.

All arithmetic is in 64-bit integers, exact up to 9e15 occurrences of kept terms in a group.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small, stage

#: Documents of its language that a kept term is in; terms listed for each group.
LEAST_DOCS, TOP = 3, 200
#: Rows (term, source) of a block, as a power of two; sources of a tile; (source, term) entries that a task counts before it hands them on.
BLOCK, TILE, HELD = 17, 64, 400_000
#: Bits of monotonically_increasing_id that count rows of a partition.
PARTITION = 33
#: What parts terms, in UTF-8 bytes: all of ASCII but letters.
TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, counted within tasks; a key comes once for each flush of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        total: dict[tuple, Counter] = {}
        seen: dict[tuple, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in total.items():
                terms = list(counts)
                within = seen[lang, source]
                for at in range(0, len(terms), 1 << 16):
                    part = terms[at : at + (1 << 16)]
                    columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary())]
                    numbers = [pa.array([c[t] for t in part], pa.int64()) for c in (counts, within)]
                    yield pa.RecordBatch.from_arrays(columns + numbers, names=["lang", "source", "term", "n", "docs"])
            total.clear()
            seen.clear()

        for batch in batches:
            for part in slices(iter([batch]), "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for text, key in zip(texts, zip(part.column("lang").to_pylist(), part.column("source").to_pylist())):
                    terms = find(text.lower())
                    total.setdefault(key, Counter()).update(terms)
                    seen.setdefault(key, Counter()).update(set(terms))
                if sum(map(len, total.values())) >= HELD:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def share(n: Column, total: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / total), three decimal digits at a time, so that nothing overflows."""
    out, rest = F.lit(1).cast("long"), n + 1
    for weight in (1_000_000, 1_000, 1):
        rest = rest * F.lit(1000).cast("long")
        out, rest = out + F.call_function("div", rest, total) * weight, F.pmod(rest, total)
    return out


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """`share` of an array."""
    out, rest = np.ones(len(n), np.int64), n + 1
    for weight in (1_000_000, 1_000, 1):
        rest = rest * 1000
        out += rest // total * weight
        rest %= total
    return out


def prices(p: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    return (p - q) ** 2 // q


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, id, first, lang_n), staged: terms in at least least_docs documents of their language; ids are the
    language's own and dense enough to be cut into blocks; `first` marks one row of each (lang, term)."""
    of_group = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    rows = of_group.withColumn("lang_n", F.sum("n").over(term)).withColumn("lang_docs", F.sum("docs").over(term)).where(F.col("lang_docs") >= least_docs)
    rows = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("id", F.min("at").over(term))
    return stage(rows.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "id", (F.col("at") == F.col("id")).alias("first"), "lang_n"), "kept")


def dense(kept: DataFrame) -> DataFrame:
    """kept with ids without the gaps between the partitions that gave them, so that the number of blocks follows the rows alone. One row a partition meets in one task."""
    part = F.shiftright("id", PARTITION)
    sizes = kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = small(stage(sizes.select("part", before.alias("start")), "starts"))
    return kept.join(starts, part == F.col("part")).withColumn("id", F.col("id") - F.shiftleft("part", PARTITION) + F.col("start")).drop("part", "start")


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, idx, terms, total, v), staged: each group with its place in its language, its number of terms, the denominator of its
    shares (0 if its language keeps no term), and its language's number of terms."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms"))
    v = kept.groupBy("lang").agg(F.count_if("first").alias("v"))
    rows = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(v, "lang", "left").fillna(0, ["n", "terms", "v"])
    idx = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return stage(rows.select("lang", "source", idx.alias("idx"), "terms", (F.col("n") + F.col("v")).alias("total"), "v"), "groups")


def overlaps(kept: DataFrame, of: DataFrame) -> DataFrame:
    """(lang, x, y, value): what terms that both x and y (idx) have change of the price of x's shares against y's, a row for each block and direction."""
    where = small(of.select("lang", "source", "idx", "total"))
    rows = dense(kept).join(where, ["lang", "source"]).select("lang", F.shiftright("id", BLOCK).alias("block"), "idx", "total", "id", "n")
    arrays = rows.groupBy("lang", "block", "idx", "total").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("terms"))
    last = of.groupBy("lang").agg(F.floor(F.max("idx") / TILE).alias("last"))
    tile, other = F.floor(F.col("idx") / TILE), F.col("other")
    tiled = arrays.join(small(stage(last, "tiles")), "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    tiled = tiled.select("lang", "block", F.least(tile, other).alias("low"), F.greatest(tile, other).alias("high"), "idx", "total", F.col("terms.id").alias("ids"), F.col("terms.n").alias("counts"))

    def merge(table: pa.Table) -> pa.Table:
        lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
        held = []
        for idx, total, ids, counts in zip(table.column("idx").to_pylist(), table.column("total").to_pylist(), table.column("ids"), table.column("counts")):
            n = counts.values.to_numpy(zero_copy_only=False)
            held.append((idx, ids.values.to_numpy(zero_copy_only=False), shares(n, total), int(shares(np.zeros(1, np.int64), total)[0])))
        held.sort(key=lambda g: g[0])
        out = []
        for i, (x, x_ids, x_p, x_none) in enumerate(held):
            for y, y_ids, y_p, y_none in held[i + 1 :]:
                if low != high and x // TILE == y // TILE:
                    continue
                short, long, swap = (x_ids, y_ids, False) if len(x_ids) <= len(y_ids) else (y_ids, x_ids, True)
                at = np.minimum(np.searchsorted(long, short), len(long) - 1)
                both = long[at] == short
                mine, theirs = (at[both], np.flatnonzero(both)) if swap else (np.flatnonzero(both), at[both])
                p, q = x_p[mine], y_p[theirs]
                if len(p):
                    for a, b, from_, to, none_a, none_b in ((x, y, p, q, x_none, y_none), (y, x, q, p, y_none, x_none)):
                        change = prices(from_, to) - prices(from_, none_b) - prices(np.int64(none_a), to)
                        out.append((a, b, int(change.sum()) + len(p) * ((none_a - none_b) ** 2 // none_b)))
        xs, ys, values = zip(*out) if out else ((), (), ())
        return pa.table({"lang": pa.array([lang] * len(xs), pa.string()), "x": pa.array(xs, pa.int32()), "y": pa.array(ys, pa.int32()), "value": pa.array(values, pa.int64())})

    return tiled.groupBy("lang", "block", "low", "high").applyInArrow(merge, "lang string, x int, y int, value long")


def one_sided(kept: DataFrame, of: DataFrame) -> DataFrame:
    """(lang, x, y, value): the price of x's shares against y's if no term were in both, from the number of terms of each count."""
    counts = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms"))
    side = lambda name: of.select("lang", F.col("idx").alias(name), F.col("source").alias(f"{name}_source"), F.col("total").alias(f"{name}_total"), F.col("terms").alias(f"{name}_terms"), F.col("v"))
    priced = counts.withColumnRenamed("source", "x_source").withColumnRenamed("terms", "many").join(small(side("x").drop("x_terms", "v")), ["lang", "x_source"]).join(small(side("y").drop("y_terms", "v")), "lang")
    priced = priced.where("x != y").withColumn("p", share(F.col("n"), F.col("x_total"))).withColumn("q", share(F.lit(0).cast("long"), F.col("y_total")))
    sums = priced.groupBy("lang", "x", "y").agg(F.sum(F.col("many") * price(F.col("p"), F.col("q"))).alias("to"), F.sum(F.col("many") * price(F.col("q"), F.col("p"))).alias("back"))
    ways = F.inline(F.array(F.struct("x", "y", F.col("to").alias("value")), F.struct(F.col("y").alias("x"), F.col("x").alias("y"), F.col("back").alias("value"))))
    pairs = small(side("x")).join(small(side("y").drop("v")), "lang").where("x != y")
    none = price(share(F.lit(0).cast("long"), F.col("x_total")), share(F.lit(0).cast("long"), F.col("y_total"))) * (F.col("v") - F.col("x_terms") - F.col("y_terms"))
    neither = pairs.select("lang", "x", "y", F.when(F.col("v") > 0, none).otherwise(0).alias("value"))
    return sums.select("lang", ways).unionByName(neither)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair`: all other sources of the language, the most unlike first; part `term`: up to
    `top` kept terms that the source uses more than its language, the dearest first. Ties go by item in UTF-8 order.

    Null text, lang and source count as ''. Texts without a term count for nothing but the group they are of. Every row is a document,
    repeated ones too. A language that keeps no term gives its pairs the value 0 and no terms. Columns other than text, lang and
    source aren't read, whatever they are called. An empty table gives an empty table.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = kept_terms(docs, least_docs)
    of = groups(docs, kept)
    values = one_sided(kept, of).unionByName(overlaps(kept, of)).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    names = lambda idx, source: small(of.select("lang", F.col("idx").alias(idx), F.col("source").alias(source)))
    pairs = values.join(names("x", "source"), ["lang", "x"]).join(names("y", "item"), ["lang", "y"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))

    langs = kept.where("first").groupBy("lang").agg((F.sum("lang_n") + F.count(F.lit(1))).alias("lang_total"))
    rows = kept.join(small(of.select("lang", "source", "total")), ["lang", "source"]).join(small(stage(langs, "langs")), "lang")
    rows = rows.withColumn("p", share(F.col("n"), F.col("total"))).withColumn("q", share(F.col("lang_n"), F.col("lang_total"))).where("p > q")
    ranked = rows.select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.unionByName(ranked.withColumn("part", F.lit("term")))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    """`audit` of all documents; nulls, empties and repeats as it says."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
toks AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
terms AS (SELECT lang, term, count(*) AS n FROM toks GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM terms GROUP BY lang),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM toks t JOIN terms k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS n
           FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l ON g.lang = l.lang),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS p
           FROM groups g JOIN terms k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
over AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p, 1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v) AS q
         FROM shares s JOIN terms k ON s.lang = k.lang AND s.term = k.term JOIN langs l ON s.lang = l.lang WHERE s.n > 0),
dear AS (SELECT lang, source, part, item, ((p - q) * (p - q) // q)::BIGINT AS value FROM over WHERE p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM dear))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
