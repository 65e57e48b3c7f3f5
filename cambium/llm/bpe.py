"""Byte-pair encoding with content-defined chunk reuse, and decoding.

A text is cut into chunks where a rolling hash over its last ``WINDOW`` words
meets a mask, so equal passages of different texts are cut alike. Workers
remember what chunks encode to, across texts, steps and tasks, by a 128-bit
hash of the chunk's words; a chunk that is in memory is not encoded again. A
new chunk is put together from its words, which the worker remembers too: most
chunks are new, most of their words are not. Both memories are bounded by
``MEMO_BYTES``.

At every join of two chunks, the words on either side are encoded again
together. If that agrees with what the chunks gave, the join stands; otherwise
a window about the join doubles until its ends agree with the words outside
it, at the latest when it is the whole text. For a tokenizer that keeps white
space in its tokens no chunk could stand, so whole texts are encoded.

Nothing is shuffled: rows stay in their partitions, which a lost executor
merely repeats.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from cambium.llm.words import U64, Words, in_small_batches, mix, one_array, steps, words_of

#: Words that the rolling hash sees, and the mask that cuts: a chunk has 64 words on average.
WINDOW, MASK = 4, 63
MEMO_BYTES = 48 << 20


#: Words whose tokens' lengths add up to their own: ASCII without the brackets of special tokens, and Latin letters with accents.
_PLAIN = r"^[!-;=-Z\\-~\x{00C0}-\x{00FF}]+$"


class Chunks:
    """What a worker remembers of chunks: a young and an old generation, each of half the bytes."""

    def __init__(self, most: int):
        self.young: dict[bytes, tuple[int, str, str]] = {}
        self.old: dict[bytes, tuple[int, str, str]] = {}
        self.half, self.size = most // 2, 0

    def get(self, key: bytes) -> tuple[int, str, str] | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: bytes, value: tuple[int, str, str]) -> None:
        if self.size > self.half:
            self.young, self.old, self.size = {}, self.young, 0
        self.young[key] = value
        self.size += 350 + len(value[1]) + len(value[2])


class Ids:
    """Lists of ids, one behind the other."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat, self.counts = flat, counts
        self.first = np.concatenate([[0], np.cumsum(counts)])[:-1]

    def take(self, which: np.ndarray) -> Ids:
        counts = self.counts[which]
        at = np.repeat(self.first[which] - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
        return Ids(self.flat[at], counts)

    def grouped(self, sizes: np.ndarray) -> Ids:
        """The first ``sizes[0]`` lists as one, then the next."""
        return Ids(self.flat, np.diff(np.concatenate([[0], np.cumsum(self.counts)])[np.concatenate([[0], np.cumsum(sizes)])]))


class WordIds:
    """What a worker remembers of words: their places in one array of ids. Forgets all at once when full."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.size = Ids(np.zeros(0, np.int32), np.zeros(0, np.int64)), 0

    def add(self, words: list[str], ids: Ids) -> None:
        self.place.update(zip(words, range(len(self.ids.counts), len(self.ids.counts) + len(words)), strict=True))
        self.ids = Ids(np.concatenate([self.ids.flat, ids.flat]), np.concatenate([self.ids.counts, ids.counts]))
        self.size += 190 * len(words) + 4 * len(ids.flat)


class Codec:
    """Encodes and decodes columns of texts by one tokenizer file."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunks, self.words = Chunks(memo_bytes // 4), WordIds(memo_bytes - memo_bytes // 4)
        alone = [self.encode_all([x])[0][1] for x in ("ab", "c.d")]
        #: Whether white space only separates: it leaves no token and no trace.
        self.apart = all(self.encode_all([s])[0][1] == " ".join(alone) for s in ("ab c.d", " ab \t\n c.d "))
        spec = json.loads(self.tok.to_str())
        normal = spec["normalizer"] or {}
        #: Whether the tokenizer itself lower-cases, and whether decoding just joins the tokens by a space.
        self.lowers = any(x["type"] == "Lowercase" for x in normal.get("normalizers", [normal] if normal else []))
        self.spaced = spec["decoder"] is None
        size, end = self.tok.get_vocab_size(), spec["model"].get("end_of_word_suffix") or ""
        tokens = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.token_len = np.array([len(t.removesuffix(end) if end else t) for t in tokens], np.int64)
        self.id_text, self.token_text = pa.array([str(i) for i in range(size)], pa.large_string()), pa.array(tokens, pa.large_string())

    def encode_all(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids, decoded text) of whole strings, by the library."""
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return [(len(x), " ".join(map(str, x)), d) for x, d in zip(ids, self.tok.decode_batch(ids, skip_special_tokens=False), strict=True)]

    def encode_words(self, words: list[str]) -> Ids:
        """Ids of words without white space.

        Plain words go to the library as one string. Their ids are dealt out again by the tokens' lengths, which must
        meet every word's end; should they ever not, the words are encoded one by one, as all others are.
        """
        named = pa.array(words, pa.string())
        plain = pc.match_substring_regex(named, _PLAIN).to_numpy(zero_copy_only=False)
        got = self._dealt(named.filter(pa.array(plain))) if plain.any() else None
        rest = np.flatnonzero(~plain) if got else np.arange(len(words))
        each = [e.ids for e in self.tok.encode_batch_fast([words[i] for i in rest.tolist()], add_special_tokens=False)]
        other = Ids(np.array([x for ids in each for x in ids], np.int32), np.array([len(x) for x in each], np.int64))
        if not got:
            return other
        order = np.empty(len(words), np.int64)
        order[np.concatenate([np.flatnonzero(plain), rest])] = np.arange(len(words))
        return Ids(np.concatenate([got.flat, other.flat]), np.concatenate([got.counts, other.counts])).take(order)

    def _dealt(self, words: pa.Array) -> Ids | None:
        flat = np.array(self.tok.encode_batch_fast([" ".join(words.to_pylist())], add_special_tokens=False)[0].ids, np.int32)
        ends, want = np.cumsum(self.token_len[flat]), np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        if not len(flat) or ends[-1] != want[-1]:
            return None
        at = np.searchsorted(ends, want)
        return Ids(flat, np.diff(at, prepend=-1)) if (ends[at] == want).all() else None

    def pieces(self, unique: pa.Array) -> Ids:
        """Ids of distinct words, each from memory if it is there."""
        if self.words.size > self.words.most:
            self.words.clear()
        if self.lowers:
            plain = pc.match_substring_regex(unique, _PLAIN)
            unique = pc.if_else(plain, pc.ascii_lower(unique), unique)
        keys = unique.to_pylist()
        if missing := [k for k in dict.fromkeys(keys) if k not in self.words.place]:
            self.words.add(missing, self.encode_words(missing))
        place = self.words.place
        return self.words.ids.take(np.fromiter((place[k] for k in keys), np.int64, len(keys)))

    def written(self, ids: Ids) -> tuple[pa.Array, pa.Array]:
        """Lists of ids joined by a space, and decoded."""
        offsets = pa.array(np.append(ids.first, len(ids.flat)), pa.int32())
        flat, space = pa.array(ids.flat), pa.scalar(" ", pa.large_string())
        joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, x.take(flat)), space) for x in ((self.id_text, self.token_text) if self.spaced else (self.id_text,))]
        return joined[0], joined[1] if self.spaced else pa.array(self.tok.decode_batch(pa.ListArray.from_arrays(offsets, flat).to_pylist(), skip_special_tokens=False), pa.large_string())

    def column(self, text: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text its number of ids, its ids joined by a space, and its decoded text."""
        if not self.apart:
            got = self.encode_all(pc.fill_null(text, "").to_pylist())
            return np.array([g[0] for g in got], np.int64), pa.array([g[1] for g in got], pa.large_string()), pa.array([g[2] for g in got], pa.large_string())
        w = words_of(text)
        digest = hashed128(w.unique)
        starts, chunk_doc = cut(w, digest[:, 0])
        keys = chunk_keys(w, digest, starts)
        place = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        codes = np.fromiter((place[k] for k in keys), np.int64, len(keys))
        known = [self.chunks.get(k) for k in place]
        fresh = np.array([i for i, v in enumerate(known) if v is None], np.int64)
        if len(fresh):
            first = np.empty(len(place), np.int64)
            first[codes[::-1]] = np.arange(len(keys))[::-1]
            names = list(place)
            for i, v in zip(fresh.tolist(), self._encoded_chunks(w, starts, first[fresh]), strict=True):
                known[i] = v
                self.chunks.put(names[i], v)
        counts = np.array([v[0] for v in known], np.int64)
        per_doc = np.bincount(chunk_doc, minlength=len(text))
        n = np.bincount(chunk_doc, weights=counts[codes], minlength=len(text)).astype(np.int64)
        ids_out, decoded_out = (_joined(pa.array([v[k] for v in known], pa.large_string()), codes, per_doc) for k in (1, 2))
        if wrong := self._broken_joins(w, starts, chunk_doc):
            ids_list, decoded_list = ids_out.to_pylist(), decoded_out.to_pylist()
            for i, joins in wrong.items():
                n[i], ids_list[i], decoded_list[i] = self._repaired(w.unique.take(pa.array(w.ids[w.first[i] : w.first[i + 1]])), joins)
            ids_out, decoded_out = pa.array(ids_list, pa.large_string()), pa.array(decoded_list, pa.large_string())
        return n, ids_out, decoded_out

    def _encoded_chunks(self, w: Words, starts: np.ndarray, which: np.ndarray) -> list[tuple[int, str, str]]:
        """What the chunks with these numbers encode to, put together from their distinct words."""
        sizes = np.append(starts[1:], len(w.ids))[which] - starts[which]
        at = np.repeat(starts[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        used, words = np.unique(w.ids[at], return_inverse=True)
        ids = self.pieces(w.unique.take(pa.array(used))).take(words).grouped(sizes)
        return list(zip(ids.counts.tolist(), *(x.to_pylist() for x in self.written(ids)), strict=True))

    def _broken_joins(self, w: Words, starts: np.ndarray, chunk_doc: np.ndarray) -> dict[int, list[int]]:
        """By text, the joins (word numbers within the text) at which encoding both sides together differs from the parts."""
        right = np.flatnonzero(chunk_doc[1:] == chunk_doc[:-1]) + 1
        if not len(right):
            return {}
        a, b = w.ids[starts[right] - 1].astype(np.int64), w.ids[starts[right]].astype(np.int64)
        pairs, where = np.unique(a * len(w.unique) + b, return_inverse=True)
        sides = np.stack([pairs // len(w.unique), pairs % len(w.unique)], axis=1).ravel()
        used, side = np.unique(sides, return_inverse=True)
        words = w.unique.take(pa.array(used))
        apart = self.pieces(words).take(side).grouped(np.full(len(pairs), 2))
        names = words.take(pa.array(side)).to_pylist()
        both = [e.ids for e in self.tok.encode_batch_fast([f"{x} {y}" for x, y in zip(names[::2], names[1::2], strict=True)], add_special_tokens=False)]
        same = np.array([len(x) for x in both]) == apart.counts
        if same.all():
            differ = np.array([x for ids in both for x in ids], np.int64) != apart.flat
            bad = np.bincount(np.repeat(np.arange(len(pairs)), apart.counts), weights=differ, minlength=len(pairs)) > 0
        else:
            bad = np.array([x != apart.flat[i : i + n].tolist() for x, i, n in zip(both, apart.first.tolist(), apart.counts.tolist(), strict=True)])
        out: dict[int, list[int]] = {}
        for c in right[bad[where]].tolist():
            d = int(chunk_doc[c])
            out.setdefault(d, []).append(int(starts[c] - w.first[d]))
        return out

    def _agreed(self, words: pa.Array, a: int, b: int) -> list[int] | None:
        """Ids of the window, if it begins and ends as its outer words do by themselves; the text's own ends need not."""
        ids = self.tok.encode_batch_fast([" ".join(words[a:b].to_pylist())], add_special_tokens=False)[0].ids
        ends = self.pieces(words.take(pa.array([a, b - 1])))
        first, last = ends.flat[: ends.counts[0]].tolist(), ends.flat[ends.counts[0] :].tolist()
        return ids if (a == 0 or ids[: len(first)] == first) and (b == len(words) or ids[len(ids) - len(last) :] == last) else None

    def _repaired(self, words: pa.Array, joins: list[int]) -> tuple[int, str, str]:
        """One text again: a window about each broken join doubles until its ends agree with the words outside it."""
        windows: list[tuple[int, int, list[int]]] = []
        for j in joins:
            reach, got = 2, None
            while got is None:
                a, b = max(0, j - reach), min(len(words), j + reach)
                if windows and a <= windows[-1][1]:
                    a, b = windows[-1][0], max(b, windows[-1][1])
                    windows.pop()
                got, reach = self._agreed(words, a, b), reach * 2
            windows.append((a, b, got))
        ids: list[int] = []
        at = 0
        for a, b, got in [*windows, (len(words), len(words), [])]:
            ids += self.pieces(words[at:a]).flat.tolist() + got
            at = b
        return len(ids), " ".join(map(str, ids)), self.tok.decode(ids, skip_special_tokens=False)


def hashed128(unique: pa.Array) -> np.ndarray:
    """A 128-bit hash of each distinct word, as two columns."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in unique.cast(pa.binary()).to_pylist()]), U64).reshape(-1, 2)


def cut(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each chunk, and each chunk's text: cuts depend on the last few words only."""
    n = len(w.ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, roll = hashes[w.ids], np.zeros(n, U64)
    for k in range(WINDOW):
        roll[k:] += mix(h[: n - k] + U64(k))
    begins = np.zeros(n, bool)
    begins[1:] = (mix(roll)[:-1] & U64(MASK)) == 0
    begins[w.first[:-1][w.counts > 0]] = True
    starts = np.flatnonzero(begins)
    return starts, w.doc_of()[starts]


def chunk_keys(w: Words, digest: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """A 128-bit hash of each chunk's sequence of words."""
    if not len(starts):
        return []
    place = np.arange(len(w.ids)) - np.repeat(starts, np.diff(np.append(starts, len(w.ids))))
    salt = (place.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    both = np.stack([np.add.reduceat(mix(digest[w.ids, k] + salt), starts) for k in (0, 1)], axis=1)
    raw = both.tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _joined(values: pa.Array, take: np.ndarray, per: np.ndarray) -> pa.Array:
    """Join the taken strings by a space, the first ``per[0]`` of them, then the next; empty ones leave no space."""
    taken = values.take(pa.array(take))
    blank = pc.equal(taken, "").to_numpy(zero_copy_only=False)
    if blank.any():
        owner = np.repeat(np.arange(len(per)), per)[~blank]
        taken, per = taken.filter(pa.array(~blank)), np.bincount(owner, minlength=len(per))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), taken.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec for a file, with its memory."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and, of the ids and the decoded text, themselves or (``digests``) their sha-256.

    A null text is an empty text: no ids, nothing decoded. Texts of any length
    are encoded whole. Rows keep their number; equal rows give equal rows, and
    an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = codec(path)
        for b in steps(batches, "text"):
            n, ids, decoded = own.column(one_array(b, "text"))
            if digests:
                ids, decoded = (pa.array([hashlib.sha256(s.as_buffer()).hexdigest() for s in x.cast(pa.large_binary())]) for x in (ids, decoded))
            else:
                decoded = decoded.cast(pa.string())
                flat = pc.split_pattern(ids.filter(pa.array(n > 0)), " ").flatten().cast(pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([one_array(b, "doc_id"), pa.array(n), ids, decoded], names=["doc_id", "n_tokens", names[0], names[1]])

    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = ("string", "string") if digests else ("array<int>", "string")
    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, {names[0]} {types[0]}, {names[1]} {types[1]}")
