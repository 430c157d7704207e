"""The pipeline's near-dedup: pairs proposed by SimHash and by rare shingles, each verified by the Jaccard similarity of word shingles.

A document is the set of its shingles' hashes; equal sets are one node. It goes if a document before it is a near copy of it,
whether that one goes, too, or not. No such pair is lost: all shingles are brought into one order, and two sets of n and m that reach the
similarity t share a shingle after which, itself included, each still has t / (1 + t) * (n + m) of its own; so it is among
the first n - t * n + 1 of each. A document lists these, and the documents of a shingle meet (`listed`). Any order is right; the cheap one
puts shingles that many documents share last, so that common passages are on no list. Shingles met twice in 4 MB of text are taken for common.

Among many documents most pairs meet by chance, in a shingle or two, and their number grows with the square of the documents. Whole sets are read
only of pairs that can still reach the similarity, by how many shingles of their lists they share and where the last of these stands (`reaching`).

Large groups of copies don't meet pair by pair: first, documents within a SimHash ball are compared with the first of it
(`simhash.links`), and those of a shingle with its first, then with the first that is left, as long as that makes them markedly fewer. Those that are
still there are compared with all documents before them on their lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import fresh, slices, small, stage, unstage

#: Words of a shingle; the least similarity of near copies; SimHash bits that may differ.
WIDTH, SIMILARITY, RADIUS = 5, 0.8, 2
#: Common shingles that the order knows (2 MB); further ones stand among the others, which costs time alone.
COMMON = 1 << 18
#: Rounds of first ones end when no more pairs are left than PAIRS, or than EACH for a row of the lists, or when a round left over STALLED of them.
PAIRS, EACH, STALLED = 50_000, 2, 0.8
SEED = 42
#: Keeps rounding on the safe side: counts are whole, so that it lets no pair more through.
SLACK = 1e-6

PRINTS = "doc_id long, row long, whole long, n long, fp long, common array<struct<token: long, times: long>>"


def _signed(x: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), values)


def _shingles(text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """The hashes, the distinct ones sorted, and a hash of these."""
    hashes = simhash.shingle_hashes(text, WIDTH)
    distinct = np.unique(hashes)
    return hashes, distinct, xxhash.xxh64_intdigest(distinct.tobytes(), SEED)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PRINTS of each row; the last of a slice holds the shingles that several different texts of the slice have."""
    for part in slices(batches, "text"):
        whole, n, fp, sets = [], [], [], {}
        for text in part.column("text").cast(pa.binary()).to_pylist():
            hashes, distinct, key = _shingles(text)
            whole.append(key)
            n.append(len(distinct))
            fp.append(simhash.simhash(hashes))
            sets[key] = distinct
        tokens, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        tokens, times = tokens[times > 1], times[times > 1]
        pairs = pa.StructArray.from_arrays([_signed(tokens), pa.array(times, pa.int64())], names=["token", "times"])
        common = _lists([*[()] * (len(n) - 1), tokens], pairs)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), _signed(whole), pa.array(n, pa.int64()), _signed(fp), common], names=["doc_id", "row", "whole", "n", "fp", "common"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        sets = [_shingles(t)[1].view(np.int64) for t in part.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("whole"), pa.array(sets, pa.list_(pa.int64()))], names=["whole", "set"])


def common_shingles(prints: DataFrame) -> np.ndarray:
    """The commonest shingles, rarest first: at most about COMMON of those that slices met twice."""
    found = stage(prints.select(F.explode("common").alias("c")).groupBy("c.token").agg(F.sum("c.times").alias("times")), "common")
    n = found.count()
    least = found.approxQuantile("times", [1 - COMMON / n], 1e-4)[0] if n > COMMON else 0
    got = found.where(F.col("times") > least).toArrow()
    unstage(found)
    tokens, times = got["token"].to_numpy().view(np.uint64), got["times"].to_numpy()
    return tokens[np.lexsort((tokens, times))]


def firsts(common: np.ndarray, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each row the first n - similarity * n + 1 shingles: others by their hash, then the common ones in their order."""
    by_hash = np.argsort(common)
    known = common[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            whole, n, lists = [], [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                _, distinct, key = _shingles(text)
                at = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
                is_common = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
                ordered = np.concatenate((distinct[~is_common], common[np.sort(by_hash[at[is_common]])] if len(known) else distinct[:0]))
                whole.append(key)
                n.append(len(distinct))
                lists.append(ordered[: len(distinct) - int(np.ceil(similarity * len(distinct) - SLACK)) + 1])
            tokens = _lists(lists, _signed(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), _signed(whole), pa.array(n, pa.int64()), tokens], names=["doc_id", "row", "whole", "n", "tokens"])

    return run


def listed(rows: DataFrame, common: np.ndarray, similarity: float) -> DataFrame:
    """(token, place, rest, before): the shingles on the lists of two nodes or more; rest: how many the node has from there on, before: how many nodes before it list it."""
    found = rows.mapInArrow(firsts(common, similarity), "doc_id long, row long, whole long, n long, tokens array<long>")
    nodes = found.groupBy("whole").agg(F.min(F.struct("doc_id", "row", "n", "tokens")).alias("one"))
    place = F.struct("one.doc_id", "whole", "one.n").alias("place")
    each = nodes.select(place, F.posexplode("one.tokens").alias("at", "token")).select("token", "place", (F.col("place.n") - F.col("at")).alias("rest"))
    of_token = Window.partitionBy("token")
    counted = each.withColumns({"before": F.row_number().over(of_token.orderBy("place")) - 1, "m": F.count("*").over(of_token)})
    return counted.where("m > 1").drop("m")


def may_be_near(similarity: float) -> Column:
    """Whether rows of a shingle, (later, later_rest) and (to, to_rest), can be near copies whose first common shingle it is; holds for a shingle of each pair of near copies."""
    return (1 + similarity) * F.least("later_rest", "to_rest") >= similarity * (F.col("later.n") + F.col("to.n")) - SLACK


def reaching(pairs: DataFrame, lists: DataFrame, similarity: float) -> DataFrame:
    """The pairs (later, to) that can be near copies by the shingles that are on both lists.

    Up to the last of these, included, a pair shares no others; behind it, at most what either has left. Where the list that ends
    first ends, its node has only what is off the list left, so no more than that is shared unseen, either.
    """
    ends = stage(pairs.select("later.whole").union(pairs.select("to.whole")).distinct(), "ends")
    each = lists.select("place.whole", "rest", "token").join(small(ends), "whole", "left_semi")
    listed = each.groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("rest", "token")), asc=False).alias("list")).select("whole", "list.token", "list.rest")
    one, other = (listed.select(F.col("whole").alias(f"{end}_whole"), F.col("token").alias(f"{end}_tokens"), F.col("rest").alias(f"{end}_rests")) for end in ("later", "to"))
    both = pairs.join(one, F.col("later.whole") == F.col("later_whole")).join(other, F.col("to.whole") == F.col("to_whole")).withColumn("shared", F.array_intersect("later_tokens", "to_tokens"))
    last = F.element_at("shared", -1)
    left = F.least(*[F.element_at(f"{end}_rests", F.array_position(f"{end}_tokens", last).cast("int")) for end in ("later", "to")]) - 1
    off = F.greatest(*[F.ceil(F.lit(similarity) * F.col(f"{end}.n") - SLACK) - 1 for end in ("later", "to")])
    can = (1 + similarity) * (F.size("shared") + F.least(left, off)) >= similarity * (F.col("later.n") + F.col("to.n")) - SLACK
    return both.where((F.size("shared") > 0) & can).select("later", "to")


def ball_pairs(nodes: DataFrame) -> DataFrame:
    """(later, to): nodes with equal or near fingerprints, each linked to the first of its fingerprint, and those as `simhash.links` says."""
    prints = nodes.groupBy("fp").agg(F.min("place").alias("first"))
    same = nodes.join(prints, "fp").where(F.col("place") != F.col("first")).select(F.col("place").alias("later"), F.col("first").alias("to"))
    named = stage(prints.select("fp", "first", F.col("fp").alias("node")), "fingerprints")
    near = simhash.links(named, RADIUS)
    ends = [named.select(F.col("node").alias(end), F.col("first").alias(f"{end}_first")) for end in ("a", "b")]
    pairs = near.join(ends[0], "a").join(ends[1], "b").select(F.greatest("a_first", "b_first").alias("later"), F.least("a_first", "b_first").alias("to"))
    return same.unionByName(pairs)


def copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row): the rows, by id and hash of id and text, that are near copies of a document before them (by doc_id, then by a hash of their shingles).

    Documents without a word are copies of each other. Rows with a null doc_id take no part. No rows give none.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text")).select("doc_id", "row", "text")
    prints = stage(rows.mapInArrow(_prints, PRINTS), "prints")
    one = prints.groupBy("whole").agg(F.min(F.struct("doc_id", "row", "n", "fp")).alias("one"))
    nodes = stage(one.select("whole", F.struct("one.doc_id", "whole", "one.n").alias("place"), "one.doc_id", "one.row", "one.fp"), "nodes")
    lists = stage(listed(rows, common_shingles(prints), similarity), "lists")

    def near_of(met: DataFrame) -> DataFrame:
        pairs = stage(met.where(may_be_near(similarity)).select("later", "to").distinct(), "met")
        out = near(reaching(pairs, lists, similarity))
        unstage(pairs)
        return out

    def near(pairs: DataFrame) -> DataFrame:
        asked = stage(pairs.select(F.col("later.whole").alias("whole"), F.col("to.whole").alias("to")).distinct(), "pairs")
        used = stage(asked.select("whole").union(asked.select("to")).distinct().join(nodes.select("whole", "row"), "whole"), "used")
        found = rows.join(small(used), "row").select("whole", "text").mapInArrow(_sets, "whole long, set array<long>")
        sets = stage(found.dropDuplicates(["whole"]), "sets")
        both = asked.join(sets, "whole").join(sets.select(F.col("whole").alias("to"), F.col("set").alias("other")), "to")
        common = F.size(F.array_intersect("set", "other"))
        out = stage(both.where(common >= F.lit(similarity) * (F.size("set") + F.size("other") - common) - SLACK).select("whole").distinct(), "near")
        for table in (asked, used, sets):
            unstage(table)
        return out

    later = lambda df: df.select("token", F.col("place").alias("later"), F.col("rest").alias("later_rest"))
    left = lambda df, gone: df.join(small(gone), F.col("place.whole") == F.col("whole"), "left_anti")
    fits = F.least("later.n", "to.n") >= F.lit(similarity) * F.greatest("later.n", "to.n") - SLACK
    gone = near(ball_pairs(nodes).where(fits))
    size, members, held, pairs_left = lists.count(), left(lists, gone), None, None
    while True:
        members = stage(members, "members")
        unstage(held)
        held, before = members, pairs_left
        pairs_left = left(lists, stage(gone, "gone")).agg(F.coalesce(F.sum("before"), F.lit(0))).first()[0]
        if pairs_left <= max(PAIRS, EACH * size) or before and pairs_left > STALLED * before:
            break
        lead = members.groupBy("token").agg(F.min(F.struct("place", "rest")).alias("lead")).select("token", F.col("lead.place").alias("to"), F.col("lead.rest").alias("to_rest"))
        met = later(members).join(lead, "token").where(F.col("later") != F.col("to"))
        now = near_of(met)
        gone = gone.unionByName(now)
        members = left(met.select("token", F.col("later").alias("place"), F.col("later_rest").alias("rest")), now)
    rest = later(left(lists.where("before > 0"), stage(gone, "gone")))
    earlier = lists.select("token", F.col("place").alias("to"), F.col("rest").alias("to_rest"))
    gone = gone.unionByName(near_of(rest.join(earlier, "token").where(F.col("to") < F.col("later"))))
    for table in (lists, held):
        unstage(table)
    rows_of = prints.select("doc_id", "row", "whole").join(nodes.select("whole", F.col("row").alias("first"), F.col("doc_id").alias("first_id")), "whole")
    out = rows_of.where("doc_id != first_id").select("doc_id", "row")
    return out.unionByName(rows_of.join(small(stage(gone.distinct(), "gone")), "whole").select("doc_id", "row")).distinct()


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents (all columns, any names) that are no near copies of one before them. Rows with a null doc_id stay; of rows that repeat the first's id and words, each stays."""
    (key,) = fresh(docs, "_row")
    gone = small(stage(copies(docs, similarity).select(F.col("row").alias(key)), "copies"))
    return docs.join(gone, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")) == F.col(key), "left_anti")
