"""MinHash near-duplicates by SuperMinHash signatures and bands.

*Signatures.* Each element of a set draws a random permutation of the
signature's places. Its j-th place gets the rank j plus a random fraction, and
a place keeps the least value over all elements. One element's ranks differ from
place to place, which makes the estimate of the Jaccard index less scattered than
independent hashes do. All elements of many sets are taken rank by rank: no later
rank can beat an earlier one, so a set stops as soon as all its places are
filled, after about m * ln(m) / n ranks for n elements and m places.

*Bands.* ``BANDS`` bands of ``ROWS`` places are the keys. Sets with an index of
0.8 share none with a chance of (1 - 0.8^6)^40 < 6e-6.

*Verification and grouping.* Classes of equal sets that share a key go through
``ngram_join``: hubs first, then what is left across components, each link
confirmed on full sets; connected components group them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm.ngram_join import Level, joined
from cambium.llm.words import U64, mix

BANDS, ROWS = 40, 6
#: Ranks that are traced through the swaps before; from then on the permutations are kept.
TRACED = 6
#: Elements that are taken together, a longer single set excepted.
TOGETHER = 1 << 15
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def _places(rank: int, chosen: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """What stands at the chosen places after the swaps of the ranks before, each of which put the content of place i at its own choice."""
    at = chosen
    for i in range(rank - 1, -1, -1):
        at = np.where(before[i] == at, i, at)
    return at


def signatures(tokens: np.ndarray, owner: np.ndarray, n_sets: int, places: int) -> np.ndarray:
    """The signature of each set as a row: rank * 2^32 + fraction for each place. No set is empty; ``owner`` names each token's set."""
    sig = np.full(n_sets * places, _EMPTY, U64)
    free = np.full(n_sets, places)
    before: list[np.ndarray] = []
    order: np.ndarray | None = None
    for rank in range(places):
        on = free[owner] > 0
        if not on.all():
            tokens, owner, before = tokens[on], owner[on], [x[on] for x in before]
            order = None if order is None else order[on]
        if not len(tokens):
            break
        x = mix(tokens + U64((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        chosen = (((x & U64(0xFFFFFFFF)) * U64(places - rank)) >> U64(32)).astype(np.int32) + np.int32(rank)
        if rank < TRACED:
            at = _places(rank, chosen, before)
            before.append(chosen)
        else:
            line = np.arange(len(tokens))
            if order is None:
                order = np.tile(np.arange(places, dtype=np.int16), (len(tokens), 1))
                for i, c in enumerate(before):
                    order[:, i], order[line, c] = order[line, c], order[:, i].copy()
                before = []
            at = order[line, chosen].astype(np.int64)
            order[line, chosen] = order[:, rank]
            order[:, rank] = at
        to = owner * places + at
        fresh = np.unique(to[sig[to] == _EMPTY])
        np.minimum.at(sig, to, (x >> U64(32)) | U64(rank << 32))
        free -= np.bincount(fresh // places, minlength=n_sets)
    return sig.reshape(n_sets, places)


def band_keys(sets: list[np.ndarray], level: Level | None = None) -> list[np.ndarray]:
    """A key for each band of each set; no set is empty."""
    out: list[np.ndarray] = []
    size = np.array([len(s) for s in sets])
    group = (np.cumsum(size) - size) // TOGETHER
    for g in np.unique(group):
        some = np.flatnonzero(group == g)
        sig = signatures(np.concatenate([sets[i] for i in some]), np.repeat(np.arange(len(some)), size[some]), len(some), BANDS * ROWS).reshape(len(some), BANDS, ROWS)
        key = np.broadcast_to(mix(np.arange(1, BANDS + 1).astype(U64)), (len(some), BANDS)).copy()
        for r in range(ROWS):
            key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, :, r])
        out += list(key)
    return out


def near_duplicates(docs: DataFrame, level: Level | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the row has its component's least id) of every row of ``docs``.

    A set holds the distinct shingles of a whole text, A-Z in lower case. Null, empty and blank texts have no shingles and link with
    nothing; they are kept. Rows of equal sets count as linked, and rows alike
    in id and set are all kept if one is. Null ids are above all others. An
    empty table gives no rows; columns but doc_id and text play no part.
    """
    out = joined(docs, level or Level(2, 8, 10), links=False, keys_for=band_keys)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
