"""Language identification by the nearest centroid.

A text becomes a vector of hashed byte trigrams, weighted by TF-IDF and scaled
to length one. Every language has a few centroids, found by clustering its
training texts. The nearest centroid by cosine names the language; a text
farther from it than the training texts of that language lie is rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import flat_bytes, text_blocks
from lodestone.llm.tables import stored

#: Dimensions of a vector.
SIZE = 4096
#: Training texts of a language, those with the smallest hash of their id. The
#: bound holds for the classifier alone; every text is classified, and whole.
TRAIN_ROWS = 1000
#: Ids drawn by their hash before the smallest are taken, as a multiple of ``TRAIN_ROWS``.
DRAWN = 4
CENTROIDS = 4
ROUNDS = 8
#: A text is rejected below this share of the cosine that 99 % of the training texts reach.
REJECT_SHARE = 0.5
#: Bytes below which a text is too short to be rejected by its distance.
SHORT = 100
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
ROWS = 256
BLOCK = 1 << 20

FOLD = np.arange(256, dtype=np.uint32)
FOLD[:128] = [ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)]


def counts(column: pa.Array) -> np.ndarray:
    """Trigram counts of every text, a row of ``SIZE`` numbers each."""
    data, bounds = flat_bytes(column)
    rows = len(bounds) - 1
    if len(data) < 3:
        return np.zeros((rows, SIZE), np.float32)
    folded = FOLD[data]
    grams = folded[:-2] << np.uint32(16) | folded[1:-1] << np.uint32(8) | folded[2:]
    bucket = grams * np.uint32(2654435761) >> np.uint32(20)
    document = np.repeat(np.arange(rows), np.diff(bounds))
    same = document[:-2] == document[2:]
    key = document[:-2][same] * SIZE + bucket[same]
    return np.bincount(key, minlength=rows * SIZE).reshape(rows, SIZE).astype(np.float32)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(found) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def cluster(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Up to ``k`` centroids of unit vectors by cosine, the first ones chosen far apart."""
    centres = [points.mean(axis=0)]
    for _ in range(min(k, len(points)) - 1):
        centres.append(points[np.argmin(np.max(points @ np.array(centres).T, axis=1))])
    centres = np.array(centres)
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        nearest = np.argmax(points @ centres.T, axis=1)
        centres = np.array(
            [points[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))]
        )
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Centroids of all languages; ``CENTROIDS`` times ``SIZE`` numbers per language."""

    langs: list[str]
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected."""
        plain = column.to_pylist()
        letters = np.array([t is not None and LETTER.search(t) is not None for t in plain], bool)
        if not self.langs:
            return [UNKNOWN] * len(plain), np.zeros(len(plain)), np.ones(len(plain), bool)
        cosine = vectors(counts(column), self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        langs = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
        score = np.where(letters, score, 0.0)
        long_enough = np.diff(flat_bytes(column)[1]) >= SHORT
        far = long_enough & (score < self.floors[best])
        return langs, np.round(score.astype(np.float64), 6), ~letters | far


def remainder() -> F.Column:
    """crc32 of the id as text modulo 3; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from text and non-null ``lang`` of the rows whose ``remainder`` is not 1."""
    usable = docs.select("doc_id", "text", "lang").filter(
        (remainder() != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    mark = F.xxhash64(F.col("doc_id").cast("string"))
    # few ids per language reach the window that takes the smallest, however many there are
    sizes = usable.groupBy("lang").count().collect()
    drawn = F.lit(False)
    for lang, rows in sizes:
        drawn = drawn | ((F.col("lang") == lang) & (mark / 2.0**64 + 0.5 <= DRAWN * train_rows / rows))
    chosen = (
        usable.filter(drawn)
        .select("doc_id", "lang", mark.alias("mark"))
        .distinct()
        .withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("mark", "doc_id")))
        .filter(F.col("place") <= train_rows)
        .select("doc_id", "lang")
    )
    sample = usable.select("doc_id", "text", "lang").join(stored(chosen, "lang-ids"), ["doc_id", "lang"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = counts(part.column(1))
                rows = pa.array([row.tobytes() for row in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), rows], ["lang", "counts"])

    # repeated rows of an id can exceed the bound; cut again, now by row
    found = stored(
        sample.select("lang", "text").mapInArrow(count, "lang string, counts binary"), "lang-counts"
    )
    found = (
        found.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("counts"), "counts")))
        .filter(F.col("place") <= train_rows)
        .select("lang", "counts")
    )

    def present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros(SIZE, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_py(), np.float32) > 0
                rows += 1
        if rows:
            arrays = [pa.array([rows], pa.int64()), pa.array([total.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["n", "present"])

    parts = found.select("counts").mapInArrow(present, "n long, present binary").collect()
    rows = sum(p.n for p in parts)
    seen = sum((np.frombuffer(p.present, np.int64) for p in parts), np.zeros(SIZE, np.int64))
    idf = np.log((1 + rows) / (1 + seen)).astype(np.float32) + np.float32(1)

    def centroids(part: pd.DataFrame) -> pd.DataFrame:
        points = vectors(np.array([np.frombuffer(c, np.float32) for c in part["counts"]]), idf)
        points = points[np.lexsort(points.T[:8])]
        centres = cluster(points, CENTROIDS, ROUNDS)
        floor = float(np.quantile(np.max(points @ centres.T, axis=1), 0.01)) * REJECT_SHARE
        return pd.DataFrame(
            {"lang": part["lang"].iloc[0], "centre": [c.astype(np.float32).tobytes() for c in centres], "floor": floor}
        )

    learned = found.groupBy("lang").applyInPandas(centroids, "lang string, centre binary, floor double").collect()
    learned.sort(key=lambda r: (r.lang, r.centre))
    matrix = np.array([np.frombuffer(r.centre, np.float32) for r in learned]).reshape(-1, SIZE)
    return Model([r.lang for r in learned], matrix, np.array([r.floor for r in learned]), idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, rejected``.

    ``lang_pred`` is the language of the nearest centroid, ``und`` where the text
    is null or has no letter or nothing was learned; such texts are rejected,
    with score 0. ``score`` is the cosine. A null ``doc_id`` is not held out, nor
    learned from. Only ``text`` enters a prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for block in text_blocks(batches, "text", BLOCK):
            for at in range(0, block.num_rows, ROWS):
                part = block.slice(at, ROWS)
                langs, score, rejected = own.predict(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    schema = T.StructType([docs.schema["doc_id"]]).add("lang_pred", "string").add("score", "double")
    found = docs.select("doc_id", "text").mapInArrow(predict, schema.add("rejected", "boolean"))
    held_out = F.coalesce(remainder() == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; nothing is joined or moved."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def clear(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for block in text_blocks(batches, "text", BLOCK):
            place = block.schema.get_field_index("text")
            for at in range(0, block.num_rows, ROWS):
                part = block.slice(at, ROWS)
                yield part.filter(pa.array(~own.predict(part.column(place))[2]))

    return docs.mapInArrow(clear, docs.schema)
