"""License scans: templates are retrieved by banded MinHash of text windows and verified by containment.

Words are runs of letters and digits in lower case, shingles are five of them
in a row. A template's shingles form its set. Texts are read through
overlapping windows, one width for each class of template lengths, at steps
short enough that some window holds any occurrence whole, even one that is
longer than the template by ``STRETCH``. Windows are runs of blocks of
``BLOCK`` shingles, so a signature is made once for each block and a window's
is the least of its blocks'.

A signature has one minimum under a seeded permutation for each band, and a
window retrieves the templates that agree with it in a band. A band has one
row: a window that holds ``LEVEL`` of a template beside other words has a
Jaccard index of a tenth to a half (``worst_case``), at which bands of more rows
would need more minima for the same guarantee. Their number (``bands_for``)
follows from that index, so that the chance to miss a template is below
``MISS``.

Retrieved templates are verified exactly: the distinct shingles of the
template in the window over all distinct shingles of the template. The
templates are a fixed list in the closure, and rows stay in their partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cambium.llm.license_texts import TEMPLATES
from cambium.llm.words import U64, hashed, in_small_batches, letters_only, mix, one_array, shingles, steps, words_of

SHINGLE, BLOCK, LEVEL, STRETCH, SEED, MISS = 5, 8, 0.8, 1.25, 3, 1e-5


def worst_case(n_distinct: int, span: int) -> float:
    """Least Jaccard index of a template of so many distinct shingles and a window of ``span`` shingles that holds ``LEVEL`` of it."""
    common = math.ceil(LEVEL * n_distinct)
    return common / (max(span, common) + n_distinct - common)


def bands_for(index: float) -> int:
    """Bands of one row by which a pair with this Jaccard index is missed with a chance below ``MISS``."""
    return 1 if index >= 1 else math.ceil(math.log(MISS) / math.log1p(-index))


class Windows:
    """Windows of one class of lengths: their blocks, and how far one is from the next."""

    def __init__(self, longest: int):
        """``longest``: shingles of the longest template, a power of two."""
        reach = int(longest * STRETCH)
        self.step = max(1, reach // (2 * BLOCK))
        self.wide = -(-(self.step * BLOCK + reach - 1) // BLOCK)
        self.span = self.wide * BLOCK


class Scanner:
    """The templates' signatures by class of lengths, and the scan of a column of texts."""

    def __init__(self, templates: dict[str, str] | None = None):
        self.names = list(TEMPLATES if templates is None else templates)
        self.sets, lengths = self._sets([(templates or TEMPLATES)[k] for k in self.names])
        if any(n == 0 for n in lengths):
            raise ValueError("a template has no words")
        classes: dict[int, list[int]] = {}
        for i, n in enumerate(lengths):
            classes.setdefault(1 << (max(1, n - SHINGLE + 1) - 1).bit_length(), []).append(i)
        self.classes = [(Windows(n), members) for n, members in sorted(classes.items())]
        self.n_bands = [max(bands_for(worst_case(len(self.sets[i]), w.span)) for i in members) for w, members in self.classes]
        self.odd = mix(np.arange(1, max(self.n_bands, default=0) + 1).astype(U64) * U64(2 * SEED + 1)) | U64(1)
        #: Each template's minimum in each band.
        self.low = [np.array([self._permuted(s, b).min() for b in range(len(self.odd))], np.uint32) for s in self.sets]

    @staticmethod
    def _sets(texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        w = words_of(letters_only(pa.array(texts, pa.string()), digits=True))
        h, owner = shingles(w, hashed(w.unique), SHINGLE)
        return [np.unique(h[owner == i]) for i in range(len(texts))], w.counts.tolist()

    def _permuted(self, h: np.ndarray, band: int) -> np.ndarray:
        return ((h * self.odd[band]) >> U64(32)).astype(np.uint32)

    def retrieved(self, h: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(template, texts, first shingles and spans within the text) of all windows that agree with it in a band."""
        blocks = -(-sizes // BLOCK)
        text = np.repeat(np.arange(len(sizes)), blocks)
        first_block = np.concatenate([[0], np.cumsum(blocks)])[:-1]
        cuts = begins[text] + BLOCK * (np.arange(len(text)) - first_block[text])
        if not len(cuts):
            return
        plans = []
        for w, members in self.classes:
            many = np.where(sizes > 0, 1 + np.maximum(0, -(-(blocks - w.wide) // w.step)), 0)
            of = np.repeat(np.arange(len(sizes)), many)
            start = w.step * (np.arange(len(of)) - (np.cumsum(many) - many)[of])
            a = first_block[of] + start
            plans.append((of, start, np.stack([a, np.minimum(a + w.wide, first_block[of] + blocks[of])], axis=1).ravel(), [np.zeros(len(of), bool) for _ in members]))
        for band in range(len(self.odd)):
            low = np.append(np.minimum.reduceat(self._permuted(h, band), cuts), np.uint32(0xFFFFFFFF))
            for (_, members), n_bands, (_, _, edges, found) in zip(self.classes, self.n_bands, plans, strict=True):
                if band < n_bands:
                    mine = np.minimum.reduceat(low, edges)[::2]
                    for i, hit in zip(members, found, strict=True):
                        hit |= mine == self.low[i][band]
        for (w, members), (of, start, _, found) in zip(self.classes, plans, strict=True):
            for i, hit in zip(members, found, strict=True):
                yield i, of[hit], start[hit] * BLOCK, np.full(int(hit.sum()), w.span)

    def scan(self, text: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(text number, template, first word, end word, containment) of each best window of a text and template."""
        w = words_of(letters_only(text, digits=True))
        if not len(w.ids):
            return []
        h, owner = shingles(w, hashed(w.unique), SHINGLE)
        begins = np.searchsorted(owner, np.arange(len(text) + 1))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for i, texts, starts, spans in self.retrieved(h, begins[:-1], np.diff(begins)):
            for d, start, span in zip(texts.tolist(), starts.tolist(), spans.tolist(), strict=True):
                own = h[begins[d] + start : min(begins[d] + start + span, begins[d + 1])]
                inside = np.isin(own, self.sets[i])
                share = len(np.unique(own[inside])) / len(self.sets[i])
                if share >= LEVEL and share > best.get((d, i), (0.0,))[0]:
                    where = np.flatnonzero(inside)
                    best[d, i] = (share, start + int(where[0]), min(start + int(where[-1]) + SHINGLE, int(w.counts[d])))
        return [(d, i, a, b, share) for (d, i), (share, a, b) in sorted(best.items())]


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each text and template found in it: doc_id, license, first_word, end_word, containment.

    The span is that of the template's shingles in the text's best window, in
    words, the first such window on ties. Null and blank texts, and texts of
    fewer than five words unless a template is that very sequence, give none.
    Texts of any length are scanned whole. Equal rows give equal rows, and an
    empty table gives none.
    """
    scanner = Scanner(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            rows = scanner.scan(one_array(b, "text"))
            if rows:
                d, i, a, z, share = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [one_array(b, "doc_id").take(pa.array(d)), pa.array([scanner.names[k] for k in i]), pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(share, pa.float64())],
                    names=["doc_id", "license", "first_word", "end_word", "containment"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, license string, first_word long, end_word long, containment double")
