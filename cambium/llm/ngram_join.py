"""Exact n-gram Jaccard join by partitioning the universe of tokens.

A text's set holds its distinct word shingles. Texts with equal sets are one
class. Sizes fall into bands; a band's scheme serves all pairs whose larger
set is in it. If the Jaccard index reaches the level, the sets differ in at
most H tokens, H from the band's largest size. The universe of tokens is
hashed into H + 1 + g segments, so at least g + 1 segments hold the very same
subset in both sets: the segments' subsets are the index keys.

Empty subsets are worthless as keys, for any two sets may have them. Each set
leaves out its own, h of them, at a cost: h <= g still guarantees a common key. Beyond g, the pair's
common subsets may all be left out; then its other segments differ in one
token or more each, at most h - 1 - g of them in more than one. So the first
2h - g segments of such a set are also indexed by one-deletion neighbourhoods:
the subset, and the subset without each one of its tokens. A subset's key is a
sum over tokens, so a neighbour's key takes one subtraction.

*Links.* Each class is first compared with one hub, the central class with which
it shares the most keys, which settles a key if all its members end in one component,
as for most copies. Of keys whose members are still in several components, those with few
members give the pairs across these. The others belong to families of near
copies, of which many are just too far apart. A family gets a consensus, the
tokens that over half of its members have, and each member is written as its
difference from it, what it has besides and what it lacks. Two sets differ as
their differences do, so the join is made on these short sets: the member
nearest the consensus is compared with all, which covers every pair that
needs no token in common, and the other pairs meet in choices of several tokens
from a prefix of their differences, rare tokens first. Every candidate is verified by intersecting the
sets or, which is the same, the differences, after bits of parity have told most that cannot link; only texts with candidates are read again, for their bits
and, where these allow a link or a family needs them, for their sets. No link between
different components is missed, and components need no pair within one. Where
the links themselves are asked for, all pairs of classes that share a key are
verified, as many as the square of a family's classes.

Tokens are 64-bit hashes of shingles, and equality of sets goes by a 128-bit
hash of the tokens: both stand for the texts in every comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from cambium.llm.components import components
from cambium.llm.filters import bit_array, bitmap_of, holds, may_contain
from cambium.llm.words import U64, hashed, in_small_batches, mix, one_array, shingles, steps, tidy, words_of
from cambium.scratch import dropped, temporary, written

#: Members of an unsettled key up to which all its pairs across components are verified at once.
FEW = 4
#: Ratio of a band's bounds.
RATIO = 1.25
#: Classes of a family's members: the bound of the first, and the ratio of the bounds of the others.
FIRST, WIDTH = 0.5, 1.5
#: Least numbers of differences that have a token, by which tokens are ordered; the first tells those that one alone has.
CLASSES = (2, 3, 5, 9, 33, 257)
#: Families, 16 bytes each, up to which their least w is broadcast.
FAMILIES = 1 << 16
#: Bits, as a power of two, of the largest filter of tokens that several members of a family have: 32 MB.
MEMBER_BITS = 28
#: Keys of a member on average, and tokens in a key, for two classes of a family.
KEYS, MOST_TOKENS = 24, 8


@dataclass(frozen=True)
class Level:
    """Shingles of ``n`` words, and a pair links if ``den * intersection >= num * union``."""

    n: int = 5
    num: int = 8
    den: int = 10


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    segments: int
    slack: int


_bands: dict[Level, list[Band]] = {}


def bands(level: Level, size: int) -> list[Band]:
    """The bands up to the one after ``size``'s; the same list for every caller."""
    out = _bands.setdefault(level, [])
    while len(out) < 2 or out[-2].high < size:
        low = out[-1].high + 1 if out else 1
        high = max(low, math.ceil(low * RATIO) - 1)
        most = (level.den - level.num) * 2 * high // (level.den + level.num)
        slack = 0
        least = max(1, low * level.num // level.den)
        while slack <= most // 4 and (most + 1 + slack) * (1 - 1 / (most + 1 + slack)) ** least > slack + 0.5:
            slack += 1
        out.append(Band(low, high, most + 1 + slack, slack))
    return out


def schemes(level: Level, size: int) -> list[tuple[int, Band]]:
    """Bands whose pairs a set of this size can be in: its own, and the next ones as far as a partner may reach."""
    all_bands = bands(level, size * level.den // level.num)
    return [(k, b) for k, b in enumerate(all_bands) if b.high >= size and level.num * b.low <= level.den * size]


def keys_of(tokens: np.ndarray, level: Level) -> np.ndarray:
    """Keys of a set of token hashes: exact subsets, and one-deletion neighbourhoods where they are due."""
    keys = [np.zeros(0, U64)]
    token = mix(tokens)
    for k, band in schemes(level, len(tokens)):
        m = band.segments
        segment = (((tokens >> U64(32)) * U64(m)) >> U64(32)).astype(np.int64)
        value = np.bincount(segment, weights=(token & U64(0xFFFFFFFF)).astype(float), minlength=m).astype(U64)
        value += np.bincount(segment, weights=(token >> U64(32)).astype(float), minlength=m).astype(U64) << U64(32)
        full = np.bincount(segment, minlength=m) > 0
        salt = mix(np.arange(m).astype(U64) + U64((k + 1) << 24))
        keys.append(mix(value ^ salt)[full])
        left_out = m - int(full.sum())
        if left_out > band.slack:
            due = min(m, 2 * left_out - band.slack)
            other = mix(salt + U64(1))
            keys.append(mix(value[:due] ^ other[:due]))
            inside = segment < due
            keys.append(mix((value[segment[inside]] - token[inside]) ^ other[segment[inside]]))
    return np.concatenate(keys)


def sets_of(text: pa.Array, level: Level) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes, A-Z in lower case."""
    w = words_of(pc.ascii_lower(text))
    h, owner = shingles(w, hashed(w.unique), level.n)
    ends = np.searchsorted(owner, np.arange(len(text) + 1))
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        s = np.sort(h[a:b])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def _print(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signed(b: bytes) -> int:
    return int.from_bytes(b[8:], "little", signed=True)


def _described(level: Level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            sets = sets_of(one_array(b, "text"), level)
            prints = [_print(s) for s in sets]
            yield pa.RecordBatch.from_arrays([one_array(b, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([_signed(p) for p in prints], pa.int64())], names=["doc_id", "n_shingles", "print", "node"])

    return run


def subset_keys(sets: list[np.ndarray], level: Level) -> list[np.ndarray]:
    return [keys_of(s, level) for s in sets]


def _keyed(level: Level, keys_for):
    """Keys of distinct sets, each set once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in steps(batches, "text"):
            fresh, nodes = [], []
            for s in sets_of(one_array(b, "text"), level):
                if not len(s) or (p := _print(s)) in seen:
                    continue
                seen.add(p)
                fresh.append(s)
                nodes.append(_signed(p))
            if fresh:
                keys = keys_for(fresh, level)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), [len(k) for k in keys]))], names=["key", "node"])

    return run


def parities(tokens: np.ndarray) -> np.ndarray:
    """Two bits or more for each token, a power of two in all, each the parity of the tokens that hash to it; as longs.

    Two sets' parities differ in no more bits than the sets in tokens.
    """
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    odd = np.bincount((tokens & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in arrays)])))


def _with_sets(level: Level, name: str):
    """Each text's print, and as ``name`` its ``tokens`` or their parities, ``odd``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            sets = sets_of(one_array(b, "text"), level)
            values = _longs([parities(s) for s in sets] if name == "odd" else sets)
            yield pa.RecordBatch.from_arrays([pa.array([_print(s) for s in sets], pa.binary()), values], names=["print", name])

    return run


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a family's members: all choices of k tokens from those that come first in its difference."""
    for b in batches:
        out: list[list[int]] = [[] for _ in range(8)]
        for row in b.to_pylist():
            tokens, many = row["shared"], row["many"]
            for s in row["schemes"]:
                k, need = s["k"], max(s["need"], row["least_need"])
                side = 2 if s["low"] == s["high"] else int(row["rank"] == s["high"])
                for choice in combinations(range(max(0, min(many, many - need + k))), k):
                    name = [row["family"], s["low"], s["high"], *(tokens[i] for i in choice)]
                    key = xxhash.xxh3_64_intdigest(np.array(name, np.int64).tobytes())
                    for column, value in zip(out, (key - (1 << 64) if key >> 63 else key, side, row["cid"], row["n"], row["c"], row["w"], many - choice[-1] - 1, k), strict=True):
                        column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["key", "side", "cid", "n", "c", "w", "left", "k"])


def _token_hashes(family: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of sets: all tokens, the number of each one's row, and a hash of token and family."""
    size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    flat = tokens.flatten().to_numpy(zero_copy_only=False).view(U64)
    return flat, row, mix(flat + mix(family.to_numpy(zero_copy_only=False).view(U64))[row])


def _counted_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, h, n): how many sets of a batch have a token, by its hash."""
    for b in batches:
        family = one_array(b, "family")
        _, row, h = _token_hashes(family, one_array(b, "tokens"))
        found, first, n = np.unique(h, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([family.take(pa.array(row[first])), pa.array(found.view(np.int64)), pa.array(n.astype(np.int32))], names=["family", "h", "n"])


def _shared_tokens(often: Broadcast):
    """Members with those of their tokens whose hash may be in the bitmap, and in ``own`` the number of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, row, h = _token_hashes(one_array(b, "family"), one_array(b, "tokens"))
            use = holds(h, often.value)
            size = np.bincount(row[use], minlength=b.num_rows)
            own = np.bincount(row, minlength=b.num_rows) - size
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat[use].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.select(["family", "cid", "n"]).columns, pa.array(own.astype(np.int32)), lists], names=["family", "cid", "n", "own", "tokens"])

    return run


def _common_tokens(major: Broadcast):
    """(family, t, h) of the tokens whose hash may be in the bitmap, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            family = one_array(b, "family")
            flat, row, h = _token_hashes(family, one_array(b, "tokens"))
            found, first = np.unique(h, return_index=True)
            first = first[holds(found, major.value)]
            yield pa.RecordBatch.from_arrays([family.take(pa.array(row[first])), pa.array(flat[first].view(np.int64)), pa.array(h[first].view(np.int64))], names=["family", "t", "h"])

    return run


def _rare_first(classes: list[Broadcast], two_k: int):
    """Members that may link with any: how many tokens of their difference others have too, and the first of these, from rare to frequent by class and then by value.

    ``least`` is the family's least w: whoever a member links with, they have so many tokens in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, row, h = _token_hashes(one_array(b, "family"), one_array(b, "diff"))
            often = np.zeros(len(h), np.int8)
            for c in classes:
                often += holds(h, c.value)
            use = often > 0
            flat, row, often = flat[use], row[use], often[use]
            order = np.lexsort((flat, often, row))
            flat = flat[order].view(np.int64)
            many = np.bincount(row, minlength=b.num_rows)
            start = np.cumsum(many) - many
            w, least = (one_array(b, c).to_numpy(zero_copy_only=False) for c in ("w", "least"))
            need = np.maximum(1, np.ceil((w + least) / two_k - 1e-9)).astype(np.int64)
            kept = np.flatnonzero(many >= need)
            first = [flat[start[i] : start[i] + min(many[i], many[i] - need[i] + MOST_TOKENS)] for i in kept]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in first])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
            some = b.select(["family", "cid", "n", "w"]).take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(many[kept].astype(np.int32)), pa.array(need[kept].astype(np.int32)), lists], names=["family", "cid", "n", "w", "many", "least_need", "shared"])

    return run


class Join:
    """One run of the join over a table; ``rows`` and ``classes`` are written tables.

    ``keys_for`` gives each set's keys: sets that link must share one.
    """

    def __init__(self, docs: DataFrame, level: Level, keys_for=subset_keys):
        self.level = level
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.docs = docs.select("doc_id", "text")
        text = in_small_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
        self.rows = written(text.mapInArrow(tidy(_described(level)), f"doc_id {kind}, n_shingles long, print binary, node long"), "sets")
        classes = self.rows.where("n_shingles > 0").groupBy("print", "node", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
        self.classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        keyed = text.mapInArrow(tidy(_keyed(level, keys_for)), "key long, node long")
        by_key = Window.partitionBy("key")
        keyed = keyed.withColumn("hub", F.min("node").over(by_key)).withColumn("far", F.max("node").over(by_key)).withColumn("size", F.count("*").over(by_key)).where("hub <> far").select("key", "node", "size")
        small = self.classes.select("node", "cid", F.col("n_shingles").alias("n"))
        self.members = written(keyed.distinct().join(small, "node").select("key", "cid", "n", "size"), "members")

    def load_parities(self) -> None:
        """The classes that share a key with another, and the parities of their sets."""
        shared = self.classes.join(self.members.select("cid").distinct(), "cid", "left_semi")
        self.wanted = written(shared.select("cid", "print", F.col("n_shingles").alias("n"), F.col("doc_id").alias("id")), "wanted")
        self.odd = written(self.of_sets("odd", self.wanted).select("cid", "n", "odd"), "parities")

    def of_sets(self, name: str, wanted: DataFrame) -> DataFrame:
        """``wanted``, a written table of classes, with the ``tokens`` of their sets or their parities, ``odd``: from their texts, which are read again."""
        bitmap, bits = bitmap_of(wanted, F.col("id"), wanted.count())
        some = may_contain(self.docs, F.col("doc_id"), bitmap, bits)
        ids = wanted.select("id").distinct()
        some = some.join(ids, some["doc_id"].eqNullSafe(ids["id"]), "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
        sets = some.mapInArrow(tidy(_with_sets(self.level, name)), f"print binary, {name} array<long>").dropDuplicates(["print"])
        return sets.join(wanted.drop("id"), "print").drop("print")

    def close(self, a: str, b: str) -> Column:
        """Whether sizes alone allow a link."""
        return F.least(a, b) * self.level.den >= F.greatest(a, b) * self.level.num

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose parities differ in no more bits than linked sets may in tokens: all that link, and few others.

        The longer parities are folded to the length of the shorter ones.
        """
        a, b = (self.odd.select(F.col("cid").alias(k), F.col("odd").alias(f"o{k}"), F.col("n").alias(f"n{k}")) for k in ("a", "b"))
        half = lambda o: F.zip_with(F.slice(o, 1, (F.size(o) / 2).cast("int")), F.slice(o, (F.size(o) / 2).cast("int") + 1, (F.size(o) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
        both = pairs.select("a", "b").join(b, "b").join(a, "a")
        for k, o in (("oa", "ob"), ("ob", "oa")):
            both = both.withColumn(k, F.when(F.size(k) > F.size(o), half(k)).otherwise(F.col(k)))
        differ = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
        most = (F.col("na") + F.col("nb")) * (self.level.den - self.level.num)
        return both.where((F.size("oa") != F.size("ob")) | (differ * (self.level.den + self.level.num) <= most)).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, written; ``pairs`` is a written table. Only sets that a possible pair needs are read, and they are deleted again."""
        pairs = written(self.possible(pairs), "possible")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        tokens = written(self.of_sets("tokens", written(self.wanted.join(ids, "cid", "left_semi"), "sought")), "tokens")
        left = tokens.select(F.col("cid").alias("a"), F.col("tokens").alias("x"))
        right = tokens.select(F.col("cid").alias("b"), F.col("tokens").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - both
        out = written(pairs.select("a", "b").join(right, "b").join(left, "a").where(both * self.level.den >= union * self.level.num).select("a", "b"), "verified")
        dropped(tokens)
        return out

    def stars(self, members: DataFrame) -> DataFrame:
        """Pairs (a, b), a < b, of each class and the hub with which it shares the most keys.

        A key's hub is its most central member: the one with the most keys, each
        counted by the digits of its size. Copies of one text thus meet at the
        copy with the fewest changes, whatever else shares a key with some of them.
        """
        central = members.groupBy("cid").agg(F.sum(F.ceil(F.log2("size"))).alias("score"))
        hubs = members.join(central, "cid").groupBy("key").agg(F.max(F.struct("score", "cid", "n")).alias("hub"))
        near = members.join(hubs, "key").where((F.col("cid") != F.col("hub.cid")) & self.close("n", "hub.n"))
        near = near.groupBy("cid", F.col("hub.cid").alias("hub"), F.col("hub.score").alias("score")).agg(F.count("*").alias("keys"))
        best = near.groupBy("cid").agg(F.max(F.struct("keys", "score", "hub")).alias("best"))
        return best.select(F.least("cid", "best.hub").alias("a"), F.greatest("cid", "best.hub").alias("b")).distinct()

    def named(self, members: DataFrame, label: DataFrame) -> DataFrame:
        """Members with their component ``c``."""
        out = members.join(label.select(F.col("node").alias("cid"), "component"), "cid", "left")
        return out.withColumn("c", F.coalesce("component", "cid")).drop("component")

    def unsettled(self, members: DataFrame, label: DataFrame) -> DataFrame:
        """Members of keys that are in several components, with component ``c`` and the key's members ``size``."""
        out = self.named(members, label)
        keys = out.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        return out.join(keys, "key").select("key", "cid", "n", "c", "size")

    def across(self, open_: DataFrame) -> DataFrame:
        """Pairs of members of a key in different components."""
        x = open_.select("key", F.col("cid").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
        y = open_.select("key", F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
        return x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & self.close("na", "nb")).select("a", "b").distinct()

    def described(self, many: DataFrame) -> DataFrame:
        """Members (family, cid, n) of the families that keys connect, each with its difference from the family's consensus.

        ``w`` is e * (den + num) - n * (den - num) for e tokens that either the
        member or the consensus has. Two members have
        ``w1 + w2 <= 2 * (den + num) * common`` exactly if they link, where
        ``common`` counts the tokens in both differences. A token that one
        member alone has is in no other difference: ``diff`` leaves it out.
        """
        hubs = many.groupBy("key").agg(F.min("cid").alias("hub"))
        hub = many.join(hubs, "key").where("cid <> hub").select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
        family = components(hub, "family").select(F.col("node").alias("cid"), F.col("component").alias("family"))
        family = written(self.wanted.join(many.select("cid").distinct().join(family, "cid"), "cid"), "families")
        whole = written(self.of_sets("tokens", family), "family")
        size = family.groupBy("family").agg(F.count("*").alias("members"))
        counts = in_small_batches(whole.select("family", "tokens")).mapInArrow(tidy(_counted_tokens), "family long, h long, n int")
        often = counts.groupBy("family", "h").agg(F.sum("n").alias("f")).where("f > 1").join(size, "family")
        often = written(often.withColumn("major", F.expr("2 * f > members")), "often")
        send = whole.sparkSession.sparkContext.broadcast
        bitmap = send(bit_array(often, F.col("h"), MEMBER_BITS))
        rows = shared = written(whole.mapInArrow(tidy(_shared_tokens(bitmap)), "family long, cid long, n long, own int, tokens array<long>"), "shared")
        bitmap.destroy()
        dropped(whole)
        major = often.where("major").select("family", "h")
        bitmap = send(bit_array(major, F.col("h")))
        common = rows.select("family", "tokens").mapInArrow(tidy(_common_tokens(bitmap)), "family long, t long, h long").distinct().join(major, ["family", "h"])
        consensus = common.groupBy("family").agg(F.collect_list("t").alias("consensus"))  # at most twice the mean size of a set
        rows = rows.join(consensus, "family", "left").withColumn("consensus", F.coalesce("consensus", F.array().cast("array<long>")))
        rows = rows.withColumn("diff", F.concat(F.array_except("tokens", "consensus"), F.array_except("consensus", "tokens")))
        w = (F.size("diff") + F.col("own")) * (self.level.den + self.level.num) - F.col("n") * (self.level.den - self.level.num)
        out = written(rows.select("family", "cid", "n", "diff", w.alias("w")), "described")
        bitmap.destroy()
        dropped(shared)
        # In how many differences a token is: those that have it or, of the consensus, those that lack it.
        often = often.select("h", F.expr("if(major, members - f, f)").alias("f"))
        self.often = [send(bit_array(often.where(F.col("f") >= k), F.col("h"))) for k in CLASSES]
        return out

    def alike(self, w1: str, w2: str, diff1: str, diff2: str) -> Column:
        """Whether two members of a family link, from their differences."""
        return F.col(w1) + F.col(w2) <= 2 * (self.level.den + self.level.num) * F.size(F.array_intersect(diff1, diff2))

    def centre_links(self, d: DataFrame) -> DataFrame:
        """Links with the member of least ``w``: any two with w1 + w2 <= 0 link, and so does each of them with this one."""
        mid = d.groupBy("family").agg(F.min(F.struct("w", "cid", "diff")).alias("m"))
        out = d.join(mid, "family").where((F.col("cid") != F.col("m.cid")) & self.alike("w", "m.w", "diff", "m.diff"))
        return out.select(F.least("cid", "m.cid").alias("a"), F.greatest("cid", "m.cid").alias("b"))

    def near_consensus(self, d: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs across components that may link by common tokens of their differences.

        A pair of members needs o >= (w1 + w2) / 2 (den + num) common tokens.
        Members fall into classes by w, and two classes have a least o. Of the tokens that
        two differences at least have, in one order for all, from rare to frequent, a
        difference with m of them that has o in common with another has the first k
        of these, k <= o, among its first m - o + k, and what comes after the last of the k in
        either bounds how many there are. So all k of these tokens together are a key. Greater k
        make fewer pairs meet and cost more keys: each two classes of a family take the
        greatest k whose keys, counted, stay within ``KEYS`` a member on average.
        """
        two_k = 2 * (self.level.den + self.level.num)
        least = written(d.groupBy("family").agg(F.min("w").alias("least")), "least")
        least = F.broadcast(least) if least.count() <= FAMILIES else least
        first = in_small_batches(d.join(least, "family").select("family", "cid", "n", "w", "least", "diff"))
        first = first.mapInArrow(tidy(_rare_first(self.often, two_k)), "family long, cid long, n long, w long, many int, least_need int, shared array<long>")
        u = F.col("w") / two_k
        rank = F.when(u <= FIRST, 0).otherwise(F.ceil(F.log(u / FIRST) / math.log(WIDTH)).cast("int"))
        d = written(self.named(written(first, "first"), label).withColumn("rank", rank), "ranked")
        schemes = written(self.classes_that_meet(d), "schemes")
        kinds = schemes.groupBy("family", "rank").agg(F.collect_list(F.struct("low", "high", "need", "k")).alias("schemes"))
        keyed = d.join(kinds, ["family", "rank"]).mapInArrow(tidy(_combined), "key long, side int, cid long, n long, c long, w long, left int, k int")
        keyed = written(keyed, "combined")
        one, two = (keyed.select("key", *[F.col(y).alias(f"{y}{i}") for y in ("side", "cid", "n", "c", "w", "left", "k")]) for i in (1, 2))
        facing = ((F.col("side1") == 0) & (F.col("side2") == 1)) | ((F.col("side1") == 2) & (F.col("side2") == 2) & (F.col("cid1") < F.col("cid2")))
        # If these are the first common tokens, so many can still follow.
        most = F.col("k1") + F.least("left1", "left2")
        out = one.join(two, "key").where(facing & (F.col("c1") != F.col("c2")) & self.close("n1", "n2") & (F.col("w1") + F.col("w2") <= two_k * most))
        return out.select(F.least("cid1", "cid2").alias("a"), F.greatest("cid1", "cid2").alias("b")).distinct()

    def classes_that_meet(self, d: DataFrame) -> DataFrame:
        """For each family, class (rank) and class that it may meet: (family, rank, low, high, need, k), low <= high the two classes.

        ``need`` is the least number of common tokens, ``k`` that of tokens in a key.
        """
        two_k = 2 * (self.level.den + self.level.num)
        ranks = d.groupBy("family", "rank").agg((F.min("w") / two_k).alias("u"))
        size = d.groupBy("family").agg(F.count("*").alias("members"))
        x, y = (ranks.select("family", F.col("rank").alias(r), F.col("u").alias(f"u{r}")) for r in ("low", "high"))
        pairs = x.join(y, "family").where("low <= high").join(size, "family")  # a family has as many classes as powers of WIDTH
        pairs = pairs.select("family", "low", "high", "members", F.greatest(F.lit(1), F.ceil(F.col("ulow") + F.col("uhigh") - 1e-9)).cast("int").alias("need"))
        sides = pairs.withColumn("rank", F.explode(F.array_distinct(F.array("low", "high"))))
        tokens = d.groupBy("family", "rank", "many").agg(F.count("*").alias("rows"))
        each = sides.join(tokens, ["family", "rank"]).withColumn("slack", F.col("many") - F.col("need")).where("slack >= 0")
        sums = [F.lit(1)]
        for k in range(2, MOST_TOKENS + 1):
            keys = F.lit(1.0)
            for i in range(1, k + 1):
                keys = keys * (F.col("slack") + i) / i
            sums.append(F.when((F.sum(keys * F.col("rows")) <= F.sum("rows") * F.least(F.lit(KEYS), F.max("members") / 2)) & (F.max(keys) <= 8 * KEYS) & (F.max("need") >= k), k).otherwise(1))
        best = each.groupBy("family", "low", "high", "need", "rank").agg(F.greatest(*sums).alias("k"))
        agreed = best.groupBy("family", "low", "high", "need").agg(F.min("k").alias("k"), F.count("*").alias("sides")).where("sides = if(low = high, 1, 2)")
        return agreed.withColumn("rank", F.explode(F.array_distinct(F.array("low", "high")))).select("family", "rank", "low", "high", "need", "k")

    def labels(self) -> DataFrame:
        """(node, component) over class ids, for classes with links."""
        self.load_parities()
        self.tried = written(self.stars(self.members), "pairs")
        self.links = written(self.verified(self.tried), "links")
        label = components(self.links)
        open_ = written(self.unsettled(self.members.drop("size"), label), "open")
        few, many = open_.where(F.col("size") <= FEW), open_.where(F.col("size") > FEW)
        if many.isEmpty():
            return label if few.isEmpty() else self.settled(self.across(few), label)
        d = self.described(many)
        label = self.settled(self.across(few), label, self.centre_links(d))
        pairs = written(self.near_consensus(d, label), "near")
        x, y = (d.select(F.col("cid").alias(k), F.col("w").alias(f"w{k}"), F.col("diff").alias(f"d{k}")) for k in ("a", "b"))
        found = written(pairs.join(x, "a").join(y, "b").where(self.alike("wa", "wb", "da", "db")).select("a", "b"), "links")
        self.links = self.links.unionByName(found)
        return components(self.links)

    def all_links(self) -> DataFrame:
        """All pairs (a, b) of distinct classes that link, a < b; after ``labels``."""
        x, y = (self.members.select("key", F.col("cid").alias(k), F.col("n").alias(f"n{k}")) for k in ("a", "b"))
        pairs = x.join(y, "key").where((F.col("a") < F.col("b")) & self.close("na", "nb")).select("a", "b").distinct()
        more = written(pairs.join(self.tried, ["a", "b"], "left_anti"), "more")
        return written(self.links.unionByName(self.verified(more)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    def settled(self, pairs: DataFrame, label: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Components after verifying those of the pairs that weren't before, and with links that are ``known``."""
        more = written(pairs.distinct().join(self.tried, ["a", "b"], "left_anti"), "more")
        self.tried = self.tried.unionByName(more)
        found = self.verified(more)
        found = written(found if known is None else found.unionByName(known), "links")
        if found.isEmpty():
            return label
        self.links = self.links.unionByName(found)
        return components(self.links)


def joined(docs: DataFrame, level: Level | None = None, links: bool = True, keys_for=subset_keys) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size and class_links of every row of ``docs``.

    The component is the least doc_id that links lead to, the row's own
    included; rows of equal sets count as linked. A text with fewer words than
    a shingle is one shingle; without words (null, blank) it has none and
    links with nothing, not even its like. Null ids are above all others. An
    empty table gives no rows. ``class_size`` is the number of rows with an
    equal set, ``class_links`` that of other sets that link with the row's;
    without ``links`` it is left out, and pairs within a known component are
    not verified.
    """
    with temporary(docs.sparkSession) as stay:
        run = Join(docs, level or Level(), keys_for)
        label = run.labels().withColumnRenamed("node", "cid")
        named = run.classes.join(label, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        degrees = []
        if links:
            degree = run.all_links().select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("class_links"))
            named, degrees = named.join(degree, "cid", "left").withColumn("class_links", F.coalesce("class_links", F.lit(0))), ["class_links"]
        named = named.select("print", "component", "doc_id", *degrees)
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        by_print = written(named.join(least, "component").select("print", "component_id", *degrees), "named")
        stay += [run.rows, by_print]
    # A class may hold a third of all rows: it is found from each of SALTS parts of it.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    rows = run.rows.withColumn("salt", salt)
    spread = rows.where("n_shingles > 0").groupBy("print", "salt").agg(F.count("*").alias("rows"))
    sizes = spread.groupBy("print").agg(F.sum("rows").alias("class_size"))
    spread = spread.select("print", "salt").join(by_print.join(sizes, "print"), "print")
    out = rows.join(spread, ["print", "salt"], "left")
    blank = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(blank, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(blank, 1).otherwise(F.col("class_size")).alias("class_size"), *[F.coalesce(k, F.lit(0)).alias(k) for k in degrees])


SALTS = 64


def _printed(text: str, level: Level):
    """Batches with the print of each text's set beside their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text):
            prints = pa.array([_print(s) for s in sets_of(one_array(b, text), level)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, prints], names=[*b.schema.names, "print"])

    return run


def one_of_each(docs: DataFrame, level: Level | None = None) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id, and all rows without words.

    Columns stay as they were. Of rows alike in id and set one stays; if a
    component's ids are all null, one of its rows stays. Of rows of one component
    alike in id, the one with the least print stays; components are told apart by
    their own label, so they may share ids.
    """
    level = level or Level()
    cols = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    i, t = f"c{cols.index('doc_id')}", f"c{cols.index('text')}"
    with temporary(docs.sparkSession) as stay:
        run = Join(plain.select(F.col(i).alias("doc_id"), F.col(t).alias("text")), level)
        named = run.classes.join(run.labels().withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), F.col("print").alias("_print")))
        stays = written(named.groupBy("component").agg(first.alias("first")).select("first._id", "first._print"), "stays")
        # An id of one row names that row; rows that share an id, or have none, are told apart by their prints.
        shared = written(run.rows.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("rows")).where("rows > 1").select("_id"), "shared")
        stay += [stays, shared]
    blank = F.coalesce(F.length(F.regexp_replace(F.coalesce(t, F.lit("")), r"[\x20\x09-\x0D]", "")), F.lit(0)) == 0
    worded = plain.where(~blank)
    kept = worded.join(stays.join(shared, "_id", "left_anti"), F.col(i) == F.col("_id"), "left_semi")
    if not stays.where("_id is null").isEmpty() or not shared.isEmpty():
        several = worded.where(F.col(i).isNull()).unionByName(worded.join(shared, F.col(i) == F.col("_id"), "left_semi"))
        several = several.mapInArrow(tidy(_printed(t, level)), StructType([*several.schema.fields, StructField("print", BinaryType())]))
        several = several.join(stays, (F.col("print") == F.col("_print")) & F.col(i).eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["print"])
        kept = kept.unionByName(several.drop("print"))
    return kept.unionByName(plain.where(blank)).toDF(*cols)
