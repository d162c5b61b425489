"""The queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .decontamination import find_contamination
from .quality import quality_verdicts
from .interactions import audit_filters
from .jaccard import near_duplicates
from .language import fit_documents, identify
from .mixing import ROUNDS, mix, taken_words
from .negatives import hard_negatives
from .pii import find_pii
from .sentencepieces import encode
from .sharding import assign_shards
from .suffixdedup import remove_repeats
from .tokencount import count_tokens
from .warc import round_trip


def _tokenizer(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10).drop("spans")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), shards=24)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return identify(documents, fit_documents(documents))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=5, percent=80)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), length=200)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low_percent=30, high_percent=90)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op5_suffix_dedup": op5_suffix_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op8_sentencepiece": op8_sentencepiece,
    "op7_warc": op7_warc,
    "op6_token_counts": op6_token_counts,
    "op2_language_id": op2_language_id,
    "op1_pii": op1_pii,
    "op4_quality_rules": op4_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_mixing": op12_mixing,
    "op13_filter_audit": op13_filter_audit,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(inside: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{inside}')"


_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words('[^ \\x09-\\x0D]+')} AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
  n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
  e AS (SELECT doc_id, unnest(s) AS e FROM s),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM e a JOIN e b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2),
  half AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
  links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS doc_id, any_value(n) AS n_shingles, min(b) AS component_id FROM reach JOIN n ON n.doc_id = a GROUP BY 1"""
_LEAKS = f"""WITH d AS (SELECT doc_id, {_words('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM documents),
  i AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_words('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM benchmark) WHERE len(w) > 0),
  iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS p FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
  dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
  m AS (SELECT doc_id, k, dw.n AS n, item_id FROM dw JOIN iw ON dw.p = iw.p AND dw.n = iw.n),
  h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM m) GROUP BY 1),
  t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
_ARCHIVED = """SELECT page_id, strlen(x)::BIGINT AS payload_bytes, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to, NULL::VARCHAR AS error,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, ((i // 4) * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER & 31)::INTEGER + 1, 1)), '') AS payload_digest
FROM (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)"""


_AUDIT = """WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
  m AS (SELECT doc_id AS of_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
  f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d LEFT JOIN m ON doc_id = of_id),
  g AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
  x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  r AS (SELECT part, good, toxic, fails, n, filter_order, CASE WHEN fails = '' THEN 9 ELSE list_min(list_transform(string_split(fails, ''), lambda c: instr(filter_order, c))) END AS first FROM g, o),
  s AS (SELECT *, substr(filter_order, step, 1) AS letter FROM (SELECT *, unnest(range(1, 6))::INTEGER AS step FROM r)),
  c AS (SELECT part, filter_order, step, any_value(letter) AS letter, coalesce(sum(n) FILTER (WHERE first > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE first = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE contains(fails, letter) AND first < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (WHERE first = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE first = step AND toxic), 0)::BIGINT AS toxic_lost FROM s GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM c"""

_NEGATIVES = """WITH e AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.k, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score FROM e a, e c WHERE a.vec_id % 100 = 0 AND a.k <> c.k),
  p AS (SELECT k, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS place FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.k, place ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.k = s.k AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""


def _mixing() -> str:
    bits = lambda *parts: f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def permuted(x: str, n: str, key: str, *names: str) -> str:
        other = f"((({key} % {n} - a) % {n} + {n}) % {n})"
        return f"list_reduce(range(0, {ROUNDS}), lambda a, r: CASE WHEN md5(concat_ws('|', 'coin', {', '.join(names)}, r, greatest(a, {other}))) >= '8' THEN {other} ELSE a END, {x})"

    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, sha256(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+'))::BIGINT AS size FROM documents),
  s AS (SELECT *, 3 * source_size AS cap, 3 * source_size * (10 // weight) AS stops FROM (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source))),
  l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY stops, rank {before}), 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY stops, rank {before}), 0) AS share FROM s),
  lv AS (SELECT rest AS lr, share AS ls FROM l WHERE cap * share >= rest * weight ORDER BY stops, rank LIMIT 1),
  t AS (SELECT *, (source_size + 127) // 128 AS blocks, CASE WHEN source_size > 0 THEN round(target * ((source_size + 127) // 128) / source_size)::BIGINT ELSE 0 END AS wanted FROM (SELECT source, rank, source_size, least(cap::DOUBLE, coalesce((lr * weight)::DOUBLE / ls::DOUBLE, cap::DOUBLE)) AS target FROM l LEFT JOIN lv ON true)),
  q AS (SELECT *, coalesce(sum(wanted) OVER (ORDER BY rank {before}), 0)::BIGINT AS first FROM t),
  u AS (SELECT id // 1024 AS shard, {bits("'draw'", '1', 'id')} % total AS u FROM (SELECT unnest(range(0, total)) AS id, total FROM (SELECT coalesce(sum(wanted), 0)::BIGINT AS total FROM q))),
  c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rank ORDER BY shard {before}), 0)::BIGINT AS before FROM (SELECT shard, rank, count(*) AS n FROM u JOIN q ON u >= first AND u < first + wanted GROUP BY ALL)),
  w AS (SELECT rank, blocks, wanted, coalesce(drawn, 0)::BIGINT AS drawn, greatest(0, coalesce(drawn, 0) - wanted)::BIGINT AS surplus FROM q LEFT JOIN (SELECT rank, sum(n) AS drawn FROM c GROUP BY 1) USING (rank) WHERE wanted > 0),
  kept AS (SELECT shard, rank, n, before - before * surplus // drawn AS low, before + n - (before + n) * surplus // drawn AS high FROM c JOIN w USING (rank)),
  seats AS (SELECT shard, unnest(range(pos::BIGINT, (pos + free)::BIGINT)) AS seat FROM (SELECT shard, free, coalesce(sum(free) OVER (ORDER BY shard {before}), 0) AS pos FROM (SELECT shard, sum(n - high + low) AS free FROM kept GROUP BY 1))),
  short AS (SELECT rank, drawn, lack, coalesce(sum(lack) OVER (ORDER BY rank {before}), 0)::BIGINT AS pos, (sum(lack) OVER ())::BIGINT AS every FROM (SELECT *, wanted - drawn AS lack FROM w WHERE wanted > drawn)),
  needs AS (SELECT rank, drawn + i AS index, {permuted('pos + i', 'every', bits("'seat'", '1', 'r'), "'seat'", '1')} AS seat FROM (SELECT *, unnest(range(0, lack)) AS i FROM short)),
  slots AS (SELECT rank, unnest(range(low, high)) AS index FROM kept UNION ALL SELECT rank, index FROM seats JOIN needs USING (seat)),
  x AS (SELECT rank, block, count(*) AS times FROM (SELECT rank, {permuted('index % blocks', 'blocks', bits("'key'", '1', 'rank', 'index // blocks', 'r'), '1', 'rank', 'index // blocks')} AS block FROM slots JOIN w USING (rank)) GROUP BY ALL),
  p AS (SELECT d.*, rank, source_size, target, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY md5(coalesce(doc_id::VARCHAR, '') || '|' || digest), doc_id, k {before}), 0)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  b AS (SELECT k, rank, block, least((block + 1) * 128, start + size) - greatest(block * 128, start) AS n_words FROM (SELECT k, rank, start, size, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM p WHERE size > 0)),
  g AS (SELECT k, sum(n_words * times) AS taken FROM b JOIN x USING (rank, block) GROUP BY 1)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN g USING (k)"""


def _quality() -> str:
    value = lambda b: f"CASE WHEN {b} = {quality._ZERO} THEN 0.0::DOUBLE ELSE pow({quality.GAMMA}::DOUBLE, {b} - 0.5::DOUBLE) END"
    least = "CASE metric " + " ".join(f"WHEN '{m}' THEN {wide}::DOUBLE" for m, (wide, _) in quality.METRICS.items()) + " END"

    def fences(keys: str) -> str:
        own = f"PARTITION BY {keys} metric"
        at = lambda q: f"min(bin) FILTER (WHERE upto >= greatest(1, ceil({q}::DOUBLE * total)))"
        return f"""SELECT {keys} metric, n, {value('q50')} - 6.0::DOUBLE * greatest({value('q50')} - {value('q05')}, {least}) AS low, {value('q50')} + 6.0::DOUBLE * greatest({value('q95')} - {value('q50')}, {least}) AS high
    FROM (SELECT {keys} metric, any_value(total) AS n, {at(0.05)} AS q05, {at(0.5)} AS q50, {at(0.95)} AS q95 FROM (SELECT *, sum(n) OVER ({own} ORDER BY bin) AS upto, sum(n) OVER ({own}) AS total FROM (SELECT {keys} metric, bin, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL)"""

    share = lambda t: f"({t}.n::DOUBLE / ({t}.n + 100.0::DOUBLE))"
    shrunk = lambda side: f"{share('g')} * g.{side} + (1.0::DOUBLE - {share('g')}) * ({share('l')} * l.{side} + (1.0::DOUBLE - {share('l')}) * a.{side}) AS {side}"
    both = " OR ".join(f"metric = '{m}'" for m, (_, low) in quality.METRICS.items() if low)
    return f"""WITH d AS (SELECT doc_id, lang, source, row_number() OVER () AS k, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines FROM documents),
  win AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS p FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
  rep AS (SELECT k, count(DISTINCT x) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS x FROM (SELECT k, i, count(*) OVER (PARTITION BY k, p) AS often FROM win) WHERE often > 1) GROUP BY 1),
  c AS (SELECT d.k, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (k)),
  f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
  m AS (SELECT k, lang, source, base_failed, unnest([{', '.join(f"'{m}'" for m in quality.METRICS)}]) AS metric, unnest([n_symbols::DOUBLE / nullif(word_chars, 0), n_dup_lines::DOUBLE / nullif(n_lines, 0), n_repeat_words::DOUBLE / nullif(n_words, 0), word_chars::DOUBLE / nullif(n_words, 0)]) AS x FROM f),
  sketch AS (SELECT lang, source, metric, CASE WHEN x > 0 THEN ceil(ln(x) * {quality._PER_BIN!r}::DOUBLE)::INTEGER ELSE {quality._ZERO} END AS bin, count(*) AS n FROM m WHERE NOT base_failed AND x IS NOT NULL GROUP BY ALL),
  g AS ({fences('lang, source,')}), l AS ({fences('lang,')}), a AS ({fences('')}),
  t AS (SELECT g.lang, g.source, g.metric, {shrunk('low')}, {shrunk('high')} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.metric = l.metric JOIN a ON g.metric = a.metric),
  odd AS (SELECT DISTINCT k FROM m JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source AND m.metric = t.metric WHERE x > high OR (({both.replace('metric', 'm.metric')}) AND x < low))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND odd.k IS NULL AS kept FROM f LEFT JOIN odd USING (k)"""


#: The other operators learn, sketch, hash or tokenise in ways that DuckDB has no function for; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_quality_rules": _quality(), "op3_ngram_jaccard": _JACCARD, "op7_warc": _ARCHIVED, "op9_decontamination": _LEAKS, "op11_hard_negatives": _NEGATIVES, "op12_mixing": _mixing(), "op13_filter_audit": _AUDIT}
