"""Collocations, importance resampling and SuperMinHash against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.llm import collocations, importance, superminhash
from cambium.llm.ngram_join import Level
from cambium.llm.words import mix

LANGS = "doc_id long, lang string, text string"
ODD = [(1, None, None), (2, "en", ""), (3, None, " \t\n\v\f\r "), (4, "en", "one"), (5, "en", "Two Words"), (5, "en", "Two Words"), (None, "en", "no id at all"), (None, None, None), (6, "x", "\x00\x1c  é́ ẞ 漢字 🙂  x"), (7, "en", "x" * 70_000), (8, "en", "a b " * 20_000)]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- collocations ---


def best_phrases(rows, least, longest, top):
    f, total, out = {}, Counter(), []
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\v\f\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] = f.get((lang, tuple(w[i : i + k])), 0) + 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = {}
    for (lang, w), a in candidates.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(a, inside.get((lang, w[i:j]), 0))
    for lang in total:
        mine = []
        for (x, w), a in candidates.items():
            if x == lang and inside.get((x, w), 0) < a:
                score, _, l, r = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
                mine.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 24, 2000])
def test_collocations_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    r = random.Random(5)
    words = [f"w{k}" for k in range(12)] + ["The", "É", "漢", "\x00", "a-b", "the"]
    rows = []
    for i in range(400):
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", "\n", ".", ""]) for _ in range(r.randrange(60)))
        rows.append((i, r.choice(["en", "en", "de", None, "und"]), text))
    rows += [(1000 + i, "en", "of the very same passage again") for i in range(40)] + [(2000 + i, "de", "w1 red green blue, red") for i in range(30)]
    got = collocations.collocations(spark.createDataFrame(rows, LANGS).repartition(5), least=8, longest=5, top=60)
    got = sorted(tuple(x) for x in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == best_phrases(rows, 8, 5, 60) and len({x[0] for x in got}) == 3 and {len(x[2].split(" ")) for x in got} >= {2, 4, 5}


def test_collocations_edge_cases(spark):
    docs = spark.createDataFrame(ODD, LANGS).withColumns({"key": F.lit("mine"), "n": F.lit(1), "words": F.lit("x")})
    got = sorted(tuple(x) for x in collocations.collocations(docs, least=2, top=50).collect())
    assert got == best_phrases(ODD, 2, 5, 50) and got
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("doc_id < 4")).count() == 0


def test_scores_beyond_64_bits(spark):
    """1000 * a * n and l * r beyond 2^63 are divided exactly."""
    big = 3_000_000_019
    got = spark.createDataFrame([(big, big - 2, big + 4)], "f long, n long, l long").selectExpr("(cast(1000 * f as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(7 as decimal(19,0))) as s").first().s
    assert int(got) == 1000 * big * (big - 2) // ((big + 4) * 7)


# --- importance resampling ---


def drawn(rows, target, n, buckets, least, percent):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for d, text in rows:
        w, f = features(text)
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    pool = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2]))
    for rank, r in enumerate(pool[: percent * len(pool) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("n", "hot"), [(1, 1 << 15), (1, 0), (2, 40), (3, 1 << 15)])
def test_draw_equals_brute_force(spark, monkeypatch, n, hot):
    monkeypatch.setattr(importance, "HOT", hot)
    monkeypatch.setattr(importance, "GATHERED", 50)
    r = random.Random(n)
    words = [f"w{k}" for k in range(60)] + ["The", "É", "漢字", "a-b", "9", "don't"]
    text = lambda k: "".join(r.choice(words[: r.randrange(1, len(words))]) + r.choice([" ", "\t", ", ", "\n"]) for _ in range(k))
    rows = [(i, text(r.randrange(50))) for i in range(300)] + [(7, "w1 w2 " * 15), (7, "w1 w2 " * 15), (None, "w3 " * 30), (None, None), (901, ""), (902, "x" * 70_000)]
    target = [text(25) for _ in range(30)] + [None]
    got = importance.resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(x,) for x in target], "text string"), n=n, buckets=97)
    assert sorted((tuple(x) for x in got.collect()), key=str) == drawn(rows, target, n, 97, 20, 10)


def test_draw_edge_cases(spark):
    docs = spark.createDataFrame(ODD, LANGS).withColumns({"feature": F.lit("mine"), "seq": F.lit(1), "rank": F.lit("x"), "bucket": F.lit(0)})
    some = spark.createDataFrame([("one two",)], "text string")
    rows = [(d, t) for d, _, t in ODD]
    got = importance.resampled(docs, some, least_words=1, percent=50)
    assert sorted((tuple(x) for x in got.collect()), key=str) == drawn(rows, ["one two"], 1, 10_000, 1, 50)
    assert importance.resampled(docs.limit(0), some).count() == 0
    got = importance.resampled(docs, some.limit(0), least_words=1, percent=100)
    assert sorted((tuple(x) for x in got.collect()), key=str) == drawn(rows, [], 1, 10_000, 1, 100)


# --- SuperMinHash ---


def one_signature(tokens, places):
    """The published loop, an element at a time over its permutation, with the same random numbers."""
    out = [None] * places
    for t in tokens:
        order = list(range(places))
        for rank in range(places):
            x = int(mix(np.array([(int(t) + (rank + 1) * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0])
            k = rank + ((x & 0xFFFFFFFF) * (places - rank) >> 32)
            order[rank], order[k] = order[k], order[rank]
            value = rank << 32 | x >> 32
            if out[order[rank]] is None or value < out[order[rank]]:
                out[order[rank]] = value
    return out


def test_signatures_equal_the_plain_loop():
    r = np.random.default_rng(1)
    sets = [r.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 3, 7, 15, 40, 200)]
    for places in (16, 60):
        sig = superminhash.signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets), places)
        for i, s in enumerate(sets):
            assert sig[i].tolist() == one_signature(s, places)


def test_signatures_estimate_with_less_variance_than_independent_hashes():
    r, places, errors = np.random.default_rng(2), 64, []
    for _ in range(400):
        both, a, b = (r.integers(0, 1 << 63, n).astype(np.uint64) for n in (16, 8, 8))
        x, y = np.concatenate([both, a]), np.concatenate([both, b])
        sig = superminhash.signatures(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2, places)
        errors.append(float((sig[0] == sig[1]).mean()) - 0.5)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.75 * 0.25 / places


def test_linked_sets_share_a_band():
    r, level = np.random.default_rng(3), Level(2, 8, 10)
    sets, linked = [], 0
    for _ in range(1200):
        a = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 60))).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > r.random() * 0.2], r.integers(0, 1 << 63, int(r.integers(0, 4))).astype(np.uint64)]))
        sets += [a, b] if len(b) else []
    keys = superminhash.band_keys(sets)
    for i in range(0, len(sets), 2):
        a, b = sets[i], sets[i + 1]
        if level.den * len(np.intersect1d(a, b)) >= level.num * len(np.union1d(a, b)):
            linked += 1
            assert len(np.intersect1d(keys[i], keys[i + 1]))
    assert linked > 300


def test_near_duplicates_edge_cases(spark):
    docs = spark.createDataFrame(ODD, LANGS).withColumns({"key": F.lit("mine"), "node": F.lit(1), "print": F.lit(2), "component_id": F.lit("x")})
    got = superminhash.near_duplicates(docs).collect()
    assert len(got) == len(ODD) and all(r.kept for r in got if not r.n_shingles)
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id == 5] == [(1, 5, True)] * 2
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id in (4, 7, 8)} == {4: 1, 7: 1, 8: 2}
    assert superminhash.near_duplicates(docs.limit(0)).count() == 0
