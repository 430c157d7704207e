"""Language ID: nearest centroid over TF-IDF vectors of character n-grams.

Texts become unit vectors of hashed 1- to 3-gram counts (square roots) times inverse document frequency.
Each language is described by several centroids, found by spherical k-means over a bounded sample of its
labelled documents; a text takes the language of the centroid of greatest cosine. A text is rejected if
that cosine is well under those that the language's own documents have to centroids learned without them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, small, small_batches, stage

UNKNOWN = "und"
#: Labelled documents of a language to learn from (about; fewer if there are fewer); centroids of a language; hashed n-grams.
SAMPLE, CENTROIDS, BINS = 2000, 4, 1 << 13
#: Cosine below which the pipeline rejects a document of any language, however little was learned.
REJECT = 0.02
#: A language's own rejection cosine: this quantile of its documents' cosines, times the margin; documents needed for it.
LOW, MARGIN, ENOUGH = 0.005, 0.7, 20
#: Characters vectorised at once, so that a text of any length takes bounded memory.
CHUNK = 1 << 20
#: Rows that are written out in full at once while centroids are sought (4 MB).
ROWS = 128

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None, bins: int) -> np.ndarray | None:
    """Counts of the hashed n-grams of lower-cased letters, other runs as one space; None if there is no letter."""
    if not text:
        return None
    table, total, any_letter, tail = letter_table(), np.zeros(bins), False, np.full(1, 32, np.uint32)
    for at in range(0, len(text) + 1, CHUNK):
        piece = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = table[piece]
        any_letter |= bool(letter.any())
        x = np.concatenate((tail, np.where(letter, piece, 32).astype(np.uint32), np.full(int(at + CHUNK > len(text)), 32, np.uint32)))
        x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
        a = x * np.uint32(0x9E3779B1)
        two = (a[:-1] ^ (a[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + a[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + a[2:]
        for h in (a[len(tail) :], two, three):
            total += np.bincount(((h ^ (h >> np.uint32(16))) & np.uint32(bins - 1)).astype(np.int64), minlength=bins)
        tail = x[-1:]
    return total if any_letter else None


@dataclass
class Model:
    """Languages of the centroids (rows, unit length), the inverse document frequencies, and each language's rejection cosine."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floors: dict[str, float]

    def predict(self, text: str | None) -> tuple[str, float]:
        n = counts(text, len(self.idf))
        if n is None or not self.languages:
            return UNKNOWN, 0.0
        v = np.sqrt(n) * self.idf
        cosine = self.centroids @ v.astype(np.float32) / max(float(np.linalg.norm(v)), 1e-12)
        best = int(cosine.argmax())
        return self.languages[best], min(1.0, max(0.0, float(cosine[best])))


def blocks(rows: list[tuple[np.ndarray, np.ndarray]], bins: int) -> Iterator[np.ndarray]:
    """The sparse rows (places, values) in full, ROWS at a time: all of a language at once took 65 MB of a worker, and each copy as much."""
    for start in range(0, len(rows), ROWS):
        part = rows[start : start + ROWS]
        x = np.zeros((len(part), bins), np.float32)
        for one, (at, v) in zip(x, part):
            one[at] = v
        yield x


def cosines(rows: list[tuple[np.ndarray, np.ndarray]], c: np.ndarray) -> np.ndarray:
    """Of each unit row with each unit centroid."""
    return np.concatenate([x @ c.T for x in blocks(rows, c.shape[1])])


def kmeans(rows: list[tuple[np.ndarray, np.ndarray]], k: int, bins: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of sparse unit rows by cosine; starts are rows far from those before, so no chance is involved."""
    c = next(blocks(rows[:1], bins))
    near = cosines(rows, c)[:, 0]
    while len(c) < min(k, len(rows)):
        start = int(near.argmin())
        c = np.concatenate((c, next(blocks(rows[start : start + 1], bins))))
        near = np.maximum(near, cosines(rows, c[-1:])[:, 0])
    for _ in range(rounds):
        total, n = np.zeros(c.shape), np.zeros((len(c), 1))
        for x in blocks(rows, bins):
            member = ((x @ c.T).argmax(axis=1) == np.arange(len(c))[:, None]).astype(np.float32)
            total += member @ x
            n += member.sum(axis=1, keepdims=True)
        c = np.where(n > 0, total / np.maximum(n, 1), c)
        c = (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return c


def floor(rows: list[tuple[np.ndarray, np.ndarray]], k: int, bins: int) -> float:
    """The rejection cosine of a language with these unit rows: each half's cosines to centroids of the other half. Few rows: 0."""
    if len(rows) < ENOUGH:
        return 0.0
    found = [cosines(rows[i::2], kmeans(rows[1 - i :: 2], k, bins)).max(axis=1) for i in range(2)]
    return MARGIN * float(np.quantile(np.concatenate(found), LOW))


def described(lang: str, found: pa.Table, idf: np.ndarray, centroids: int) -> pa.Table:
    """(lang, centroid, floor) of a language's sampled documents, whose n-grams (at) and their counts (n) found holds; the same in whatever order they come."""
    rows = [tuple(one.values.to_numpy() for one in pair) for pair in zip(found.column("at"), found.column("n"))]
    rows.sort(key=lambda r: (len(r[0]), r[0].astype(">i4").tobytes(), r[1].astype(">f4").tobytes()))
    for i, (at, n) in enumerate(rows):
        v = np.sqrt(n) * idf[at]
        rows[i] = at, (v / max(float(np.linalg.norm(v)), 1e-12)).astype(np.float32)
    c = kmeans(rows, centroids, len(idf))
    return pa.table({"lang": pa.array([lang] * len(c), pa.string()), "centroid": pa.array(list(c), pa.list_(pa.float32())), "floor": [floor(rows, centroids, len(idf))] * len(c)})


def train(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, bins: int = BINS) -> Model:
    """Learns from labelled rows (doc_id, text, lang); null lang and texts without a letter teach nothing.

    Of each language about `sample` documents are used: those whose hashed id falls in that share of its count.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("h"))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share"))
    share = small(stage(share, "shares"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            langs, at, n = [], [], []
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                if (c := counts(text, bins)) is not None:
                    langs.append(lang)
                    at.append(np.flatnonzero(c).astype(np.int32))
                    n.append(c[at[-1]].astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], names=["lang", "at", "n"])

    chosen = rows.join(share, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text")
    chosen = stage(chosen.mapInArrow(vectors, "lang string, at array<int>, n array<float>"), "vectors")
    total, frequency = chosen.count(), np.zeros(bins)
    for r in chosen.select(F.explode("at").alias("at")).groupBy("at").count().toLocalIterator():
        frequency[r["at"]] = r["count"]
    idf = np.log((1 + total) / (1 + frequency)) + 0.05

    def cluster(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return described(key[0].as_py(), rows, idf, centroids)

    found = chosen.groupBy("lang").applyInArrow(cluster, "lang string, centroid array<float>, floor double").orderBy("lang").collect()
    return Model([r["lang"] for r in found], np.array([r["centroid"] for r in found], np.float32).reshape(-1, bins), idf, {r["lang"]: r["floor"] for r in found})


def learnable(doc_id: str = "doc_id") -> Column:
    """Whether a document may be learned from: crc32 of its id isn't a multiple of five. Null ids aren't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 0, F.lit(False))


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score; text decides alone. Null or no letter: `und` and 0.

    Columns called like the results (names) are replaced; others pass through. Repeated rows stay; empty in, empty out.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [shared.value.predict(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*part.schema.names, *names])

    clean = docs.drop(*names)
    return clean.mapInArrow(run, T.StructType([*clean.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def keep_known(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """The documents whose language is known: not `und`, and not farther than its rejection distance from the nearest centroid.

    That distance is learned (see `floor`); a cosine under `reject` goes in any case.

    All columns pass through, whatever they are called. An empty table, or one without labelled documents, teaches nothing; then only documents without a letter go.
    """
    model = train(docs.where(learnable()))
    found = predict(docs, model, tuple(names := fresh(docs, "lang_pred", "score")))
    least = F.coalesce(*[F.when(F.col(names[0]) == lang, F.lit(max(reject, low))) for lang, low in model.floors.items()], F.lit(reject))
    known = F.col(names[1]) >= least if model.languages else F.col("text").rlike(r"\p{L}")
    return found.where(known).select(*docs.columns)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """`predict` for all documents by a model of those that may be learned from. A null doc_id is held out; a null text is `und`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(learnable()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score")
