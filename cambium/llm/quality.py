"""A quality classifier: hashed word n-grams, follow-the-regularised-leader, sparse dot products.

A text's features are its words and pairs of words, and the same for the
words' shapes (runs of lower case, upper case, digits and each sign), hashed
into ``DIMS`` places, plus a place for word pairs that the text had before. A
feature's value is its share of the text's words, so a text's length does not
enter. Labels, languages, sources and ids are no features.

The model is fitted on the driver from a sample of ``TRAIN_ROWS`` labelled
rows at most, whatever the table's size, drawn by a hash of the id; the
features are computed by the executors and read in parts of bounded bytes. Scoring is one narrow pass
over the texts with the weights (``DIMS`` floats) in the closure.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cambium.llm.columns import draw60
from cambium.llm.words import U64, hashed, in_small_batches, mix, one_array, returning, steps, tidy, words_of
from cambium.scratch import written

DIMS = 1 << 18
#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 4000
#: Bytes of features that the driver holds at once.
PART_BYTES = 8 << 20
FOLDS, THRESHOLD, EPOCHS, SEED = 5, 0.3, 4, 11
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.002, 0.001
_RUN = re.compile(rb"(.)\1+", re.S)
_SHAPE = bytes((97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b) for b in range(256))


def _shape_hash(unique: pa.Array) -> np.ndarray:
    """Hash of each word's shape."""
    shapes = [_RUN.sub(rb"\1", w.translate(_SHAPE)) for w in unique.cast(pa.binary()).to_pylist()]
    known = {s: 0 for s in shapes}
    names = list(known)
    known = dict(zip(names, hashed(pa.array(names, pa.binary()), 1).tolist(), strict=True))
    return np.fromiter((known[s] for s in shapes), dtype=U64, count=len(shapes))


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: (text number, place, value) of the features, by text. Blank texts have none."""
    w = words_of(text)
    doc, n = w.doc_of(), len(w.ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    h, s = hashed(w.unique)[w.ids], _shape_hash(w.unique)[w.ids]
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    two = mix(h[pair] * U64(3) + h[pair + 1])
    shape_two = mix(s[pair] * U64(5) + s[pair + 1])
    # A pair that stood in this text before: equal neighbours after sorting by text and pair.
    key = mix(two + doc[pair].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(pair), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    same = h[pair] == h[pair + 1]
    docs = np.concatenate([doc, doc, doc[pair], doc[pair], doc[pair][again], doc[pair][same]])
    place = np.concatenate([mix(h), mix(s + U64(1)), two, shape_two, np.full(again.sum(), 12345, U64), np.full(same.sum(), 54321, U64)])
    place = (place & U64(DIMS - 1)).astype(np.int64)
    key, count = np.unique(docs * DIMS + place, return_counts=True)
    docs, place = key // DIMS, key % DIMS
    return docs, place, count / w.counts[docs]


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches, "text"):
        doc, place, value = features(one_array(b, "text"))
        ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
        blobs = [pa.array([x[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary()) for x in (place.astype(np.int32), value.astype(np.float32))]
        yield pa.RecordBatch.from_arrays([one_array(b, "draw"), one_array(b, "quality"), *blobs], names=["draw", "quality", "place", "value"])


class Ftrl:
    """Logistic regression by per-coordinate follow-the-regularised-leader with L1 and L2."""

    def __init__(self, dims: int = DIMS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n, self.how = np.zeros(dims + 1), np.zeros(dims + 1), (alpha, beta, l1, l2)

    def weights(self, at=slice(None)) -> np.ndarray:
        alpha, beta, l1, l2 = self.how
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """One example; the last place is the intercept."""
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.how[0]
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def in_fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is 0; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from labelled rows outside the held-out fold; the last is the intercept.

    The sample is the ``rows`` labels of least draw, fewer if there are no
    more. Rows with a null label or id teach nothing; a label that occurs
    twice teaches twice. Without any labelled row all weights are 0. The
    driver holds one part of the sample's features at a time, of about
    ``PART_BYTES`` (a single text's are never divided).
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~in_fold(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"), draw60(F.lit(SEED), F.col("doc_id")).alias("draw"))
    sample = usable.orderBy("draw", "doc_id", "quality").limit(rows)
    examples = in_small_batches(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("draw", "quality", "text"))
    got = written(examples.mapInArrow(tidy(_sparse), "draw long, quality int, place binary, value binary"), "sample")
    size = got.agg(F.sum(F.octet_length("place") + F.octet_length("value"))).first()[0] or 0
    parts = got.repartitionByRange(-(-size // PART_BYTES) or 1, "draw").sortWithinPartitions("draw", "quality", "place", "value")
    model = Ftrl()
    for epoch in range(EPOCHS):
        for i, part in enumerate(_parts(parts)):
            for k in np.random.default_rng([epoch, i]).permutation(len(part)):
                place, value, y = part[k]
                model.learn(np.frombuffer(place, np.int32), np.frombuffer(value, np.float32).astype(float), int(y > 0))
    returning()(0)
    return model.weights().astype(np.float32)


def _parts(rows: DataFrame) -> Iterator[list[tuple[bytes, bytes, int]]]:
    """The rows in order, in lists of about ``PART_BYTES``."""
    part, size = [], 0
    for _, y, place, value in rows.toLocalIterator():
        part.append((bytes(place), bytes(value), y))
        size += len(place) + len(value)
        if size >= PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def scores(text: pa.Array, weights: np.ndarray) -> np.ndarray:
    doc, place, value = features(text)
    dot = np.bincount(doc, weights=weights[place] * value, minlength=len(text)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with its ``_score``. Null and blank texts get the intercept's score.

    Only ``keep`` and the text go to the workers, the text once.
    """
    rows = in_small_batches(docs.select(*dict.fromkeys([*keep, text_col])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text_col):
            out = pa.array(scores(one_array(b, text_col), weights))
            yield pa.RecordBatch.from_arrays([*(one_array(b, k) for k in keep), out], names=[*keep, "_score"])

    return rows.mapInArrow(tidy(run), StructType([*(rows.schema[k] for k in keep), StructField("_score", DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Equal texts score alike, whatever their ids; rows that repeat are returned as often. Texts of any length are
    scored whole, blank ones by the intercept. A score of exactly ``THRESHOLD`` is accepted. An empty table gives no rows.
    """
    out = scored(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns as they were; none of an empty table."""
    cols = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    out = scored(plain, train(docs, labels), plain.columns, f"c{cols.index('text')}")
    return out.where(F.col("_score") >= THRESHOLD).drop("_score").toDF(*cols)
