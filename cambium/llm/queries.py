"""The queries over whole tables that apply these operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm import bpe, collocations, ctw, exact_dedup, html_extract, importance, licenses, maglev, mixing, ngram_join, spotsigs, superminhash
from cambium.llm import quality as quality_model
from cambium.llm.columns import n_words
from cambium.sources.tables import table


def op1_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"), ngram_join.Level(3, 9, 10), links=False).select("doc_id", "n_shingles", "component_id")


def op4_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.place(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.neighbours(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), ngram_join.Level(2, 8, 10))


_DRAW = "('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT"

OP2_SQL = rf"""
WITH drawn AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         {_DRAW.format(seed=mixing.SEED)} AS u
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk
  FROM drawn GROUP BY source),
weighed AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
         sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights
  FROM weighed),
marked AS (
  SELECT *, (budget - caps) * weight >= cap * weights AS clamped FROM levels),
level AS (
  SELECT caps AS c0, weights AS w0 FROM marked WHERE NOT clamped ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE (budget - c0) * weight / w0 END AS target
  FROM marked LEFT JOIN level ON true),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
run AS (
  SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, round(n.target)::BIGINT - n.whole * n.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM drawn d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole * size + greatest(0, least(size, need - before)))::BIGINT AS taken
FROM run"""

_SLOTS, _SHARDS = maglev.SLOTS, maglev.SHARDS
OP4_SQL = f"""
WITH RECURSIVE prefs AS (
  SELECT s AS shard, (('0x' || substr(md5('offset|shard-' || s), 1, 15))::BIGINT % {_SLOTS}) AS o,
         (('0x' || substr(md5('skip|shard-' || s), 1, 15))::BIGINT % {_SLOTS - 1} + 1) AS k
  FROM range({_SHARDS}) t(s)),
orders AS (SELECT list(o ORDER BY shard) AS os, list(k ORDER BY shard) AS ks FROM prefs),
fill(turn, free, step, slot, shard) AS (
  SELECT 0, list_transform(range({_SLOTS}), lambda x: true), list_transform(range({_SHARDS}), lambda x: 0::BIGINT), -1::BIGINT, -1
  UNION ALL
  SELECT turn + 1, list_concat(list_concat(free[1:claimed], [false]), free[claimed + 2:{_SLOTS}]),
         list_concat(list_concat(step[1:s], [pos + 1]), step[s + 2:{_SHARDS}]), claimed, s
  FROM (
    SELECT turn, free, step, s, pos, (os[s + 1] + pos * ks[s + 1]) % {_SLOTS} AS claimed
    FROM (
      SELECT turn, free, step, turn % {_SHARDS} AS s, os, ks,
             list_filter(range(step[turn % {_SHARDS} + 1], {_SLOTS}), lambda j: free[(os[turn % {_SHARDS} + 1] + j * ks[turn % {_SHARDS} + 1]) % {_SLOTS} + 1])[1] AS pos
      FROM fill, orders WHERE turn < {_SLOTS})))
SELECT doc_id, d.slot::INTEGER AS slot, f.shard::INTEGER AS shard
FROM (SELECT doc_id, {_DRAW.format(seed=maglev.SEED)} % {_SLOTS} AS slot FROM documents) d JOIN fill f ON f.slot = d.slot"""

OP10_SQL = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS r FROM normal)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       r = 1 AS kept, sha256(t) AS text_sha256
FROM numbered"""

OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 90 * (p.n + q.n - common)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM words w JOIN reach r ON r.doc_id = w.doc_id LEFT JOIN sizes z ON z.doc_id = w.doc_id GROUP BY w.doc_id"""

OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, w.doc_id = min(other) AS kept
FROM words w JOIN reach r ON r.doc_id = w.doc_id LEFT JOIN sizes z ON z.doc_id = w.doc_id GROUP BY w.doc_id"""


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
spans AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM listed, range(1, 6) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM spans GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates WHERE k > 2))
  WHERE j - i + 1 < k GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, cut, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:c.k], ' ')
  JOIN totals t ON t.lang = c.lang
  LEFT JOIN inner_ z ON z.lang = c.lang AND z.phrase = c.phrase
  WHERE 100 * coalesce(longer, 0) < 100 * c.a),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS pick FROM cuts),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
  FROM best WHERE pick = 1)
SELECT * FROM ranked WHERE rank <= 2000"""

OP12_SQL = r"""
WITH RECURSIVE steps(b, k, v) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
features AS (SELECT f, count_if(side = 'd') AS s, count_if(side = 'b') AS t FROM words GROUP BY f),
hashed AS (
  SELECT f, s, features.t AS t,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode(f))), 2), lambda i: ('0x' || substr(hex(encode(f)), i, 2))::BIGINT)),
             lambda acc, x: xor(acc // 256, crc.t[xor(acc % 256, x) + 1])), 4294967295) % 10000 AS bucket
  FROM features, crc),
sums AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed),
gains AS (
  SELECT bucket, floor(1000 * ln((sum(h.t) + 1)::DOUBLE * (any_value(sums.s) + 10000) / ((sum(h.s) + 1)::DOUBLE * (any_value(sums.t) + 10000))))::BIGINT AS gain
  FROM hashed h, sums GROUP BY bucket),
weights AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM words JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_tree_scores": op1_context_tree_scores,
    "op2_mix_sources": op2_mix_sources,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_shard_placement": op4_shard_placement,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_license_scan": op6_license_scan,
    "op7_main_text": op7_main_text,
    "op8_quality": op8_quality,
    "op9_spot_fingerprints": op9_spot_fingerprints,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_collocations": op11_collocations,
    "op12_importance_draw": op12_importance_draw,
    "op13_superminhash": op13_superminhash,
}
ORACLES: dict[str, str] = {
    "op2_mix_sources": OP2_SQL, "op3_ngram_jaccard_join": OP3_SQL, "op4_shard_placement": OP4_SQL, "op10_exact_dedup": OP10_SQL,
    "op11_collocations": OP11_SQL, "op12_importance_draw": OP12_SQL, "op13_superminhash": OP13_SQL,
}
