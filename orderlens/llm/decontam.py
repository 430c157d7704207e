"""Benchmark decontamination: rare word-pair seeds join passages to test items, then Smith-Waterman alignment scores them.

The words of test items (lower-cased letters and digits) give pairs of neighbours. Alignment scores match 2,
mismatch -1, gap -1, and the result is divided by the score of a whole exact copy. However an item of n words is
edited, cut or filled up, a score s keeps T = n (4 s - 1) / 3 - 1 of its pairs (rounded up), if a pair counts
with one word put in between as well: matched words next to each other in the item stay within two words of each
other unless two words went in between, and all of these edits cost score. So of all pairs of an item but its T - 1 most common
ones, a copy holds at least one. Those are the item's seeds. How common a pair is, one pass counts over all
documents; the counts decide what a search costs and never what it finds.

A second, map-only pass looks the seeds up in the documents, keeps places that hold T pairs and s n words of the item,
and aligns the item with the words around the others. Items too short to keep a pair (of three words,
at a score of 0.5) are sought by single words in the same way, T being s n; items of two words as they stand.

Test items are a stated query set: they travel to the tasks in blocks of bounded size. No key can be hot and no
passages are shuffled; the counting pass shuffles numbers, summed up in each task. A task spells out a bounded number of hits at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Words of a seed; the least score of a leak.
WIDTH, MIN_SCORE = 2, 0.5
#: Characters of test items that travel to the tasks at once.
BLOCK_CHARS = 8_000_000
#: Alignment cells, and hits of seeds, worked on at once in a task.
CELLS, HITS = 2_000_000, 2_000_000
#: Kinds of seeds, and how far apart their words may stand in a text.
WORD, PAIR, WHOLE = 1, 2, 3
APART = {WORD: [0], PAIR: [1, 2], WHOLE: [1]}

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _codes(numbers: np.ndarray, kind: int, apart: int) -> np.ndarray:
    """A code for the words at each place and `apart` places on; 0 where one of them is unknown (0) or a text ends (-1) before the second."""
    n = max(0, len(numbers) - apart)
    first, second = numbers[:n], numbers[apart:]
    known = (first > 0) & (second > 0)
    for k in range(1, apart):
        known &= numbers[k : k + n] >= 0
    return np.where(known, (kind << 60) | (first << 30) | second, 0)


@dataclass
class Items:
    """A block of test items: words as numbers, one item after the other with a -1 after each, and the pairs (or words) that start there."""

    ids: list[int]
    words: np.ndarray
    starts: np.ndarray  # of the items in words
    vocabulary: dict[str, int]
    codes: np.ndarray  # sorted
    grams: np.ndarray  # index into codes of what starts at each word; -1: nothing
    need: np.ndarray  # how many of an item's grams any leak holds
    kinds: list[int]
    seeds: np.ndarray  # code index * items + item, sorted

    @classmethod
    def build(cls, rows: list[tuple[int, str]], min_score: float) -> Items:
        vocabulary: dict[str, int] = {}
        words, starts = _numbered([t for _, t in rows], vocabulary, learn=True)
        length = np.diff(starts) - 1
        kept = np.ceil((4 * min_score - 1) * length / 3 - 1 - 1e-9).astype(np.int64)
        kind = np.select([length == WIDTH, kept >= 1], [WHOLE, PAIR], WORD)
        need = np.where(kind == PAIR, kept, np.where(kind == WHOLE, 1, np.maximum(1, np.ceil(min_score * length - 1e-9).astype(np.int64))))
        code, of_kind = np.zeros(len(words), np.int64), np.repeat(kind, np.diff(starts))
        for k in (kinds := sorted(set(kind.tolist()))):
            found = _codes(words, k, APART[k][0])
            code[: len(found)] = np.where(of_kind[: len(found)] == k, found, code[: len(found)])
        codes = np.unique(code[code > 0])
        grams = np.where(code > 0, np.searchsorted(codes, code), -1)
        return cls([r[0] for r in rows], words, starts, vocabulary, codes, grams, need, kinds, np.zeros(0, np.int64))

    def seeded(self, counts: np.ndarray) -> Items:
        """With the seeds of each item: all its grams but the need - 1 most common ones, by counts of codes."""
        at = np.flatnonzero(self.grams >= 0)
        item = np.searchsorted(self.starts, at, "right") - 1
        order = np.lexsort((at, -counts[self.grams[at]], item))
        at, item = at[order], item[order]
        rank = np.arange(len(at)) - np.searchsorted(item, item, "left")
        rare = rank >= self.need[item] - 1
        return replace(self, seeds=np.unique(self.grams[at[rare]] * len(self.ids) + item[rare]))

    def lookup(self, numbers: np.ndarray) -> list[np.ndarray]:
        """For each way that grams may stand in a text: the index into codes of what starts at each place; -1: nothing."""
        out = []
        for kind in self.kinds:
            for apart in APART[kind]:
                code, found = _codes(numbers, kind, apart), np.full(len(numbers), -1, np.int64)
                at = np.flatnonzero(code)
                k = np.minimum(np.searchsorted(self.codes, code[at]), max(0, len(self.codes) - 1))
                ok = self.codes[k] == code[at] if len(self.codes) else np.zeros(len(at), bool)
                found[at[ok]] = k[ok]
                out.append(found)
        return out


def _numbered(texts: list[str | None], vocabulary: dict[str, int], learn: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts (0: unknown), a -1 after each, and where each text starts; learn: unknown words get a number."""
    get, out, starts = vocabulary.get, [], np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t and learn:
            out += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(t)]
        elif t:
            out += [get(w, 0) for w in words_of(t)]
        out.append(-1)
        starts[i + 1] = len(out)
    return np.array(out, np.int64), starts


def _align(jobs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over (item, window) pairs at once: the best score, and the window's word where it ends."""
    rows, width = max(len(a) for a, _ in jobs), max(len(b) for _, b in jobs)
    a, b = np.full((len(jobs), rows), -1, np.int64), np.full((len(jobs), width), -2, np.int64)
    for i, (x, y) in enumerate(jobs):
        a[i, : len(x)], b[i, : len(y)] = x, y
    ramp = np.arange(1, width + 1, dtype=np.int32)
    h, best, end = np.zeros((len(jobs), width + 1), np.int32), np.zeros(len(jobs), np.int32), np.zeros(len(jobs), np.int64)
    for r in range(rows):
        up = np.maximum(h[:, :-1] + np.where(b == a[:, r : r + 1], 2, -1), h[:, 1:] - 1)
        h[:, 1:] = np.maximum.accumulate(np.maximum(up, 0) + ramp, axis=1) - ramp
        at = h[:, 1:].argmax(axis=1)
        top = h[np.arange(len(jobs)), at + 1]
        end = np.where(top > best, at, end)
        best = np.maximum(best, top)
    return best, end


def _hits(found: list[np.ndarray], items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, item) of all seeds found, sorted by item and place: all hits of a run of items at a time, HITS or a single item's at most."""
    at = np.concatenate([np.flatnonzero(f >= 0) for f in found])
    k = np.concatenate([f[f >= 0] for f in found])
    n_items = len(items.ids)
    code, item = items.seeds // n_items, items.seeds % n_items
    of_item = np.bincount(item, np.bincount(k, minlength=len(items.codes))[code], n_items)
    run = (np.cumsum(of_item) // HITS).astype(np.int64)
    cuts = np.unique(np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1, [n_items])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        lo, hi = np.searchsorted(items.seeds, k * n_items + a), np.searchsorted(items.seeds, k * n_items + b)
        n = hi - lo
        if not (total := int(n.sum())):
            continue
        which = item[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(total)]
        place = np.repeat(at, n)
        order = np.lexsort((place, which))
        yield place[order], which[order]


def _matches(texts: list[str | None], items: Items, min_score: float) -> list[tuple[int, int, float, int, int, int]]:
    """(text's index, item id, score, its grams that stand there, first and last word) of the best place of each item in each text."""
    numbers, starts = _numbered(texts, items.vocabulary)
    found, best = items.lookup(numbers), {}
    if not any((f >= 0).any() for f in found):
        return []
    length = np.diff(items.starts) - 1
    # The words that an alignment of the least score spans at most.
    span = length + np.floor(2 * (1 - min_score) * length).astype(np.int64)
    has_word, has_gram = np.zeros(len(items.vocabulary) + 1, bool), np.zeros(len(items.codes) + 1, bool)
    for at, item in _hits(found, items):
        doc = np.searchsorted(starts, at, "right") - 1
        cut = np.flatnonzero((np.diff(item) != 0) | (np.diff(doc) != 0) | (np.diff(at) > span[item[1:]])) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
        i, d = item[first], doc[first]
        lo, hi = np.maximum(starts[d], at[first] - span[i]), np.minimum(starts[d + 1] - 1, at[last] + span[i])
        jobs, meta = [], []
        for i, d, lo, hi in zip(i.tolist(), d.tolist(), lo.tolist(), hi.tolist()):
            known, window = items.words[items.starts[i] : items.starts[i + 1] - 1], numbers[lo:hi]
            grams = items.grams[items.starts[i] : items.starts[i + 1] - 1]
            # No alignment has more matches than the item has words that stand here.
            has_word[window] = True
            enough = has_word[known].sum() >= min_score * len(known)
            has_word[window] = False
            if enough:
                near = [f[lo:hi] for f in found]
                for f in near:
                    has_gram[f] = True
                has_gram[-1] = False
                stand = int(has_gram[grams].sum())
                for f in near:
                    has_gram[f] = False
                if stand >= items.need[i]:
                    jobs.append((known, window))
                    meta.append((d, i, stand, lo - int(starts[d])))
        order = sorted(range(len(jobs)), key=lambda j: (len(jobs[j][0]), len(jobs[j][1])))
        while order:
            size = max(1, CELLS // (len(jobs[order[-1]][0]) * max(1, len(jobs[order[-1]][1])) // 8 + 1))
            part, order = order[-size:], order[:-size]
            scores, ends = _align([jobs[j] for j in part])
            for j, score, end in zip(part, scores.tolist(), ends.tolist()):
                d, i, stand, lo = meta[j]
                score /= 2 * len(jobs[j][0])
                new = (score, stand, max(lo, lo + end - int(length[i]) + 1), lo + end)
                if score >= min_score and ((d, i) not in best or (new[0], -new[2]) > (best[d, i][0], -best[d, i][2])):
                    best[d, i] = new
    return [(d, items.ids[i], *v) for (d, i), v in sorted(best.items())]


def _seeded(docs: DataFrame, items: Items) -> Items:
    """The items with their seeds: how often each gram stands in all documents decides. Counts are summed up in tasks; a number a gram of the block reaches the driver."""
    counts = np.zeros(len(items.codes), np.int64)
    if (items.need > 1).any():
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(shared.value.codes), np.int64)
            for part in slices(batches, "text"):
                for found in shared.value.lookup(_numbered(part.column("text").to_pylist(), shared.value.vocabulary)[0]):
                    n += np.bincount(found[found >= 0], minlength=len(n))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["code", "n"])

        got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        counts[got["code"].to_numpy()] = got["n"].to_numpy()
        shared.destroy()
    return items.seeded(counts)


def _blocks(docs: DataFrame, benchmark: DataFrame, min_score: float, block_chars: int) -> Iterator[Items]:
    """The items in blocks of about block_chars characters, with their seeds; one block at a time is on the driver. Items without a word match nothing."""
    rows, held = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        held += len(r[1])
        if held >= block_chars:
            yield _seeded(docs, Items.build(rows, min_score))
            rows, held = [], 0
    if rows:
        yield _seeded(docs, Items.build(rows, min_score))


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per document and test item that it holds a copy of: doc_id, item_id, score (0 to 1), n_seeds, first_word, last_word.

    Found is every place that scores min_score, whatever the edits. The place is the item's best one in the document, as word numbers
    from 0; n_seeds says how many of the item's pairs stand there. The documents are read twice, at once to count pairs. Null and empty texts and items
    hold nothing; items of one or two words match where all of them stand in order; a null doc_id stays null; repeated rows and
    repeated items repeat their rows. Other columns are not read. Empty tables give an empty table.
    """
    small_batches(docs.sparkSession)
    spark, schema = docs.sparkSession, "doc_id long, item_id long, score double, n_seeds int, first_word int, last_word int"
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None
    for items in _blocks(docs, benchmark, min_score, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                ids = part.column("doc_id").to_pylist()
                found = _matches(part.column("text").to_pylist(), shared.value, min_score)
                if found:
                    d, item, score, seeds, first, last = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in d], pa.int64()), pa.array(item, pa.int64()), pa.array(score, pa.float64()), *(pa.array(x, pa.int32()) for x in (seeds, first, last))], names=["doc_id", "item_id", "score", "n_seeds", "first_word", "last_word"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents (all columns, any number, any names) that hold no test item, as `leaks` finds them. Map-only, after the pass that counts pairs."""
    small_batches(docs.sparkSession)
    for items in _blocks(docs, benchmark, min_score, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                found = _matches(part.column("text").to_pylist(), shared.value, min_score)
                mask = np.ones(part.num_rows, bool)
                mask[[f[0] for f in found]] = False
                yield part.filter(pa.array(mask))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """`leaks` of all documents and test items; nulls, empties and repeats as it says."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, items)
