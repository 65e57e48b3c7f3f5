"""Importance resampling towards a target corpus, with a dictionary of distinct features.

A feature is a run of one or more words. All its occurrences are counted as a
string first, combined in each task; the distinct strings make a dictionary,
in which each is hashed to its bucket once. Buckets add up the dictionary's
counts, of the corpus and of the target; a bucket's gain compares the two.

The gains go back to the documents through the dictionary. The most
frequent strings, at most ``HOT`` of at most ``HOT_BYTES`` bytes, which make up most of the
occurrences, are sent to all tasks, at most 8.4 MB of them; the other strings
of each document are joined with the dictionary, with their counts. No string
that is joined has more rows than the least frequent of those sent, but for
long ones, and Spark splits such partitions.

The draw keeps the highest scores: ranks come from a sort by range and the
sizes of the ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.llm.words import in_small_batches, letters_only, one_array, steps, words_of
from cambium.operators.evidence import numbered
from cambium.scratch import temporary, written

#: Strings that are sent to all tasks, and the most bytes of each.
HOT, HOT_BYTES = 1 << 15, 256
#: Distinct strings that a task gathers before it hands on their counts.
GATHERED = 1 << 18


def runs(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """All runs of 1 to n words: index into the distinct strings, and text, of each; the distinct strings; words of each text."""
    w = words_of(letters_only(texts, digits=True))
    doc, strings, parts = w.doc_of(), [w.unique], [(w.ids.astype(np.int64), w.doc_of())]
    place = np.arange(len(w.ids)) - w.first[:-1][doc]
    left, names, base = w.ids.astype(np.int64), w.unique, len(w.unique)
    for k in range(2, n + 1):
        at = np.flatnonzero(place + k <= w.counts[doc])
        pair, index = np.unique(left[at] * max(1, len(w.unique)) + w.ids[at + k - 1], return_inverse=True)
        names = pc.binary_join_element_wise(names.take(pa.array(pair // max(1, len(w.unique)))), w.unique.take(pa.array(pair % max(1, len(w.unique)))), " ")
        left = np.zeros(len(left), np.int64)
        left[at] = index
        parts.append((index + base, doc[at]))
        strings.append(names)
        base += len(names)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), pa.concat_arrays(strings), w.counts


def _counted(n: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct strings of many texts with their counts, handed on whenever there are ``most``."""

    def out(seen: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in steps(batches, "text"):
            index, _, names, _ = runs(one_array(b, "text"), n)
            for name, count in zip(names.to_pylist(), np.bincount(index, minlength=len(names)).tolist(), strict=True):
                seen[name] = seen.get(name, 0) + count
            if len(seen) >= most:
                yield out(seen)
                seen = {}
        if seen:
            yield out(seen)

    return run


def _weighed(n: int, hot: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each text its words, features, the gains of those that are ``hot``, and the others with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            index, doc, names, words = runs(one_array(b, "text"), n)
            gains = [hot.get(x) for x in names.to_pylist()]
            known = np.array([g is not None for g in gains], bool)
            gain = np.array([g or 0 for g in gains], np.int64)
            weight = np.zeros(b.num_rows, np.int64)
            np.add.at(weight, doc, gain[index])
            cold = ~known[index]
            pair, count = np.unique(doc[cold] * max(1, len(names)) + index[cold], return_counts=True)
            ends = np.searchsorted(pair, np.arange(b.num_rows + 1) * max(1, len(names)))
            entries = pa.StructArray.from_arrays([names.take(pa.array(pair % max(1, len(names)))), pa.array(count.astype(np.int64))], names=["feature", "n"])
            rest = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)
            features = np.bincount(doc, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([one_array(b, "doc_id"), pa.array(words.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(weight), rest], names=["doc_id", "n_words", "n_features", "weight", "rest"])

    return run


def dictionary(docs: DataFrame, target: DataFrame, n: int, buckets: int) -> DataFrame:
    """Each distinct feature of both tables once: (feature, s, t, bucket), its counts in either. Features are UTF-8 strings, buckets by their crc32."""
    sides = []
    for texts, (s, t) in ((docs, ("n", "0")), (target, ("0", "n"))):
        counts = in_small_batches(texts.select("text")).mapInArrow(_counted(n, GATHERED), "feature string, n long")
        sides.append(counts.selectExpr("feature", f"cast({s} as long) as s", f"cast({t} as long) as t"))
    both = sides[0].unionByName(sides[1]).groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return both.withColumn("bucket", (F.crc32("feature") % buckets).cast("int"))


def bucket_gains(features: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that have a feature."""
    per = features.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    s, t = (float(x or 0) for x in features.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + 1).cast("double") * F.lit(s + buckets) / ((F.col("s") + 1).cast("double") * F.lit(t + buckets))
    return per.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _most_frequent(features: DataFrame) -> DataFrame:
    """At most ``HOT`` strings of at most ``HOT_BYTES`` bytes, all those above a count; counts fall into eight classes for each power of two."""
    short = features.where(F.octet_length("feature") <= HOT_BYTES).withColumn("_class", F.floor(8 * F.log2(F.col("s") + 1)).cast("int"))
    least, sent = 1 << 30, 0
    for c, n in sorted(short.groupBy("_class").count().collect(), reverse=True):
        if sent + n > HOT:
            break
        least, sent = c, sent + n
    return short.where(F.col("_class") >= least)


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank in the draw (null if not drawn), all long but the id as it is.

    Features are all runs of 1 to ``n`` words of a whole text, words runs of
    letters, digits and non-ASCII characters, A-Z in lower case. A null text
    has none, nor has an empty one: weight 0. ``target`` has a text column too. The weight adds up
    floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) over them,
    the score adds floor(-1000 * ln(-ln(u))), u from the first 32 bits of
    sha256 of ``seed:doc_id`` (a null id counts as ``null``). Of the rows with at least ``least_words`` words
    the floor(percent * rows / 100) highest scores are drawn; ties go to the
    smaller id, null last, and of rows alike in that to the greater weight, then to either. Repeated rows
    are rows of their own. Empty tables give no rows, or gains over an empty corpus or target.
    """
    with temporary(docs.sparkSession) as stay:
        features = written(dictionary(docs, target, n, buckets), "features")
        gains = F.broadcast(written(bucket_gains(features, buckets), "gains"))  # at most ``buckets`` rows
        hot = {f: g for f, g in _most_frequent(features).join(gains, "bucket").select("feature", "gain").collect()}
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = in_small_batches(docs.select("doc_id", "text")).mapInArrow(_weighed(n, hot), f"doc_id {kind}, n_words long, n_features long, weight long, rest array<struct<feature: string, n: long>>")
        rows = written(rows.withColumn("seq", F.monotonically_increasing_id()), "weighed")
        rest = rows.select("seq", F.explode("rest").alias("r")).select("seq", "r.feature", "r.n").join(features.select("feature", "bucket"), "feature").join(gains, "bucket")
        rest = rest.groupBy("seq").agg(F.sum(F.col("n") * F.col("gain")).alias("_more"))
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
        out = rows.drop("rest").join(rest, "seq", "left").withColumn("weight", F.col("weight") + F.coalesce("_more", F.lit(0)))
        out = written(out.select("seq", "doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "scored")
        pool = out.where(F.col("n_words") >= least_words)
        drawn = percent * pool.count() // 100
        ranked = numbered(pool, [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("seq")], "rank")
        ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
        out = ranked.unionByName(out.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
        out = written(out.select("doc_id", "n_features", "weight", "score", "rank"), "resampled")
        stay.append(out)
    return out
