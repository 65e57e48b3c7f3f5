"""Exact de-duplication, source mixing and shard placement against plain Python."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cambium.llm import exact_dedup, filters, maglev, mixing

DOCS = "doc_id long, text string, source string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups(spark):
    rows = [(1, "Abc É", "a"), (2, "aBC É", "a"), (3, "abc é", "b"), (4, None, None), (5, "", "b"), (None, "", "b"), (6, "x" * 100_000, "c"), (7, "X" * 100_000, "c"), (7, "X" * 100_000, "c"), (None, "only", "d"), (8, "abc é ", "d")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS)).collect()
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(lower(t), []).append(i)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in ids.items()}
    for r in got:
        group = by_sha[r.text_sha256]
        assert r.group_size == len(group) and r.keep_id == max((i for i in group if i is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(by_sha) and set(kept.values()) == {1}


def test_exact_dedup_of_an_empty_table_and_clashing_columns(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a", "s"), (2, "A", "t"), (3, "b", "u")], DOCS).withColumns({"digest": F.lit(1), "run": F.lit(2), "_keep": F.lit(3)})
    got = exact_dedup.without_copies(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [2, 3]


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (None, "q", "s"), (None, "Q", "s"), (5, None, "s")], DOCS)
    assert sorted((r.doc_id is None, r.doc_id) for r in exact_dedup.without_copies(df).collect()) == [(False, 1), (False, 5), (True, None)]


def test_filter_has_no_false_negatives(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    bitmap, bits = filters.bitmap_of(df.where("k % 7 = 0"), F.col("k"), 715)
    got = {r.k for r in filters.may_contain(df, F.col("k"), bitmap, bits).collect()}
    want = set(range(0, 5000, 7))
    assert want <= got and len(got) < 2 * len(want)


def fill(sizes, weights, budget, most):
    """Water-filling by rounds."""
    targets, clamped = {}, set()
    total = budget * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in clamped]
        rest = total - sum(most * sizes[s] for s in clamped)
        share = {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
        new = {s for s in free if share[s] > most * sizes[s]}
        if not new:
            targets = share | {s: most * sizes[s] for s in clamped}
            return targets
        clamped |= new


def test_mix_meets_targets(spark):
    rows = [(k, "w " * (1 + k * 7 % 23), ["a", "b", "é", None, "z"][k % 5 if k % 3 else 0]) for k in range(400)] + [(900, None, "a"), (901, "", "b"), (902, "w " * 3000, "z"), (902, "w " * 3000, "z")]
    df = spark.createDataFrame(rows, DOCS).select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    got, again = (sorted(map(tuple, mixing.mix(df).collect()), key=str) for _ in range(2))
    assert got == again
    sizes = Counter()
    for _, s, size, *_ in got:
        sizes[s] += size
    order = [*sorted((s for s in sizes if s is not None), key=lambda s: s.encode()), None]
    want = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    taken = Counter()
    for _, s, size, source_size, target, t in got:
        assert target == pytest.approx(want[s]) and source_size == sizes[s] and 0 <= t <= 2 * size
        taken[s] += t
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mixed_documents_have_the_taken_words(spark):
    rows = [(k, " ".join(f"w{k}" for _ in range(5 + k % 9)), "ab"[k % 2] if k < 30 else "c") for k in range(60)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n_chars": F.char_length("text").cast("long"), "size": F.lit(1), "taken": F.lit(2)})
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id] += len(r.text.split())
    plan = mixing.mix(df.select(F.struct("doc_id", F.xxhash64("doc_id", "text").alias("t")).alias("doc_id"), "source", mixing.n_words(F.col("text")).alias("size")))
    want = {r.i: r.taken for r in plan.select(F.col("doc_id.doc_id").alias("i"), "taken").collect() if r.taken}
    assert dict(got) == want


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0
    one = mixing.mix(spark.createDataFrame([(1, "a", 0)], "doc_id long, source string, size long")).first()
    assert one.taken == 0


def test_table_is_full_balanced_and_stable():
    names = maglev.shard_names(16)
    t = maglev.fill_table(names, 1009)
    n = Counter(t)
    assert len(t) == 1009 and max(n.values()) - min(n.values()) <= 1
    fewer = maglev.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(t, fewer) if a != 15)
    assert moved < 0.25 * 1009
    with pytest.raises(ValueError):
        maglev.fill_table(names, 1000)


def test_placement(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "doc_id long").withColumns({"slot": F.lit("mine"), "shard": F.lit("mine")})
    got = maglev.place(df).collect()
    table = maglev.fill_table(maglev.shard_names())
    for r in got:
        key = f"{maglev.SEED}|{'null' if r.doc_id is None else r.doc_id}"
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % maglev.SLOTS
        assert (r.slot, r.shard) == (slot, table[slot])
    assert maglev.place(df.limit(0)).count() == 0


def test_texts_that_share_a_digest_are_told_apart(spark):
    rows = [(1, "A b", "s"), (2, "a B", "s"), (3, "xx", "s"), (4, "yyy", "s"), (5, "yyy", "s"), (5, "yyy", "s"), (None, "q q", "s"), (None, None, "s"), (7, "", "s")]
    df = spark.createDataFrame(rows, DOCS)
    by_length = lambda t: F.unhex(F.lpad(F.hex(F.length(t)), 8, "0"))
    plain = lambda **how: sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df, **how).collect()), key=str)
    assert plain(digest=by_length) == plain()
    assert sorted(map(tuple, exact_dedup.without_copies(df, digest=by_length).collect()), key=str) == sorted(map(tuple, exact_dedup.without_copies(df).collect()), key=str)


def test_runs_are_looked_up_by_digest(spark):
    df = spark.createDataFrame([(k, f"text {k % 30}", "s") for k in range(90)], DOCS)
    index = exact_dedup.Index(df, "doc_id", "text", exact_dedup.sha256)
    got = exact_dedup.lookup(index.entries, [hashlib.sha256(b"text 7").digest(), hashlib.sha256(b"none").digest()])
    assert sorted(r.id for r in got.collect()) == [7, 37, 67]


def test_rows_alike_share_every_word_of_their_target(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "s")] * 3 + [(2, "x y", "t"), (3, None, "t"), (None, "n", None), (None, "n", None)], DOCS)
    got = mixing.mixed_documents(df.withColumn("_taken", F.lit(1)))
    plan = mixing.mix(df.select("doc_id", "source", F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("size")).where("doc_id <> 3 or doc_id is null"))
    want = {r.source: r.taken for r in plan.groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    words = Counter()
    for r in got.collect():
        words[r.source] += len(r.text.split())
    assert got.columns == [*df.columns, "_taken"] and {k: v for k, v in want.items() if v} == dict(words)
    assert mixing.mixed_documents(df.limit(0)).count() == 0 and exact_dedup.without_copies(df.limit(0)).count() == 0
