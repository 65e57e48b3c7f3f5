"""Words of many texts at once: a columnar form that the Python operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

#: Bytes of text that one step of an operator holds in columnar form, a longer single text excepted.
STEP_BYTES = 3 << 20
#: Bytes of one Arrow batch that Spark hands to a worker, a longer single row excepted.
BATCH_BYTES = 4 << 20
U64 = np.uint64


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session told to send Arrow batches of ``BATCH_BYTES`` at most.

    The setting is the session's, for Spark reads it when a plan runs; a lesser one stays.
    """
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(conf.get(key).rstrip("bB"))
    if now <= 0 or now > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


@dataclass
class Words:
    """``ids[first[i]:first[i + 1]]`` are text i's words as indexes of ``unique``."""

    first: np.ndarray
    ids: np.ndarray
    unique: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts come to about ``most`` bytes; a row is never divided.

    What has been set free goes back to the system after each batch: workers live on and would keep it.
    """
    trim = returning()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
        del batch
        pa.default_memory_pool().release_unused()
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving back at its end what its last step held: an idle worker keeps no more than its modules."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        returning()(0)

    return whole


@cache
def returning() -> Callable[[int], int]:
    """Make the C library give arrays of 1 MB and more their own pages, which go back when they are freed, and return its trim."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD; it no longer rises by itself
    return getattr(libc, "malloc_trim", lambda _: 0)


def words_of(text: pa.Array) -> Words:
    """Split at runs of the six ASCII white-space characters; null and blank texts have no words."""
    text = pc.ascii_trim_whitespace(pc.fill_null(text, ""))
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    enc = flat.dictionary_encode()
    ids = enc.indices.to_numpy(zero_copy_only=False)
    blank = pc.equal(text, "").to_numpy(zero_copy_only=False)
    if blank.any():
        ids = ids[~np.repeat(blank, counts)]
        counts = np.where(blank, 0, counts)
    return Words(np.concatenate([[0], np.cumsum(counts)]), ids, enc.dictionary)


#: ASCII bytes but letters (and, in the second table, digits) become a space and A-Z lower case; others stay.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_LETTERS_DIGITS = np.array([b if 48 <= b <= 57 else _LETTERS[b] for b in range(256)], np.uint8)


def letters_only(texts: pa.Array, digits: bool = False) -> pa.Array:
    """The texts with every ASCII character that is no letter (or digit) made a space, and A-Z in lower case; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    out = (_LETTERS_DIGITS if digits else _LETTERS)[raw[ends[0] : ends[-1]]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(out))


def hashed(unique: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in unique.cast(pa.binary()).to_pylist()), dtype=U64, count=len(unique))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def shingles(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text, and each one's text.

    A text with 1 to n - 1 words has its whole sequence as its one run; a text without words has none.
    """
    h = hashes[words.ids]
    counts = words.counts
    acc = mix(h)
    width = np.minimum(np.maximum(counts, 1), n)
    runs = np.where(counts > 0, counts - width + 1, 0)
    last = len(h)
    keep = np.zeros(last, bool)
    doc = words.doc_of()
    place = np.arange(last) - words.first[:-1][doc]
    keep[:] = place < runs[doc]
    starts, owner = np.flatnonzero(keep), doc[keep]
    acc = acc[starts]
    for j in range(1, n):
        at = starts + j
        inside = j < width[owner]
        nxt = h[np.minimum(at, max(last - 1, 0))]
        acc = np.where(inside, mix(acc * U64(0x9E3779B97F4A7C15) + nxt), acc)
    return mix(acc + width[owner].astype(U64)), owner


def one_array(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
