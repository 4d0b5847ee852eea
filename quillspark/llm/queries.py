"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .line_dedup import line_dedup
from .lm_score import lm_score
from .mixing import mix
from .ngram_join import ngram_join
from .pii import find_pii
from .quality_crf import quality_crf
from .quality_rules import quality_rules
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts

#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 4096


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents")).drop("source")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents")).drop("rejected_by")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_read(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_read(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(_read(spark, sf_dir, "documents"), model).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_mixing, op3_suffix_dedup, op4_line_dedup, op5_quality_rules, op6_ngram_join, op7_lm_score, op8_decontaminate, op9_quality_crf, op10_token_counts)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op2_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
 f AS (SELECT *, row_number() OVER o AS place, coalesce(sum(3 * source_size) OVER b, 0) AS filled,
   sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest, sum(source_size) OVER () AS total FROM w
   WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST),
    b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT *, (total - filled)::DOUBLE / rest AS level FROM f),
 m AS (SELECT min({{'place': place, 'level': level}}) FILTER (WHERE level * weight < 3 * source_size) AS first FROM l),
 t AS (SELECT source, source_size, CASE WHEN place >= first.place THEN first.level * weight ELSE (3 * source_size)::DOUBLE END AS target FROM l, m),
 u AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, floor(target + 1e-6)::BIGINT AS words FROM t),
 v AS (SELECT *, (words + 1023) // 1024 AS need, sum(words) OVER (ORDER BY sid) AS upto, sum(words) OVER () AS total, count(*) OVER () AS n FROM u),
 c AS (SELECT sid, need, floor((upto - words)::DOUBLE / total::DOUBLE * 2147483648)::BIGINT AS lo, floor(upto::DOUBLE / total::DOUBLE * 2147483648)::BIGINT AS hi FROM v WHERE words > 0),
 k AS (SELECT range AS slot, range % 2147483648 * 1327217885 % 2147483648 AS point FROM range((SELECT coalesce(max((total::BIGINT + 1023) // 1024), 0) FROM v))),
 h AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM k JOIN c ON lo <= point AND point < hi),
 p AS (SELECT row_number() OVER () AS rid, d.doc_id, d.size, v.source_size, v.target, v.words, v.sid, v.n,
   sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS begins
   FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
 e AS (SELECT *, unnest([0, 1, 2]) AS turn FROM p),
 g AS (SELECT rid, doc_id, size, source_size, target, sid, n, turn, turn * source_size + begins AS a, least(turn * source_size + begins + size, words) AS z FROM e),
 r AS (SELECT *, unnest(CASE WHEN a < z THEN range((a // 1024)::BIGINT, ((z - 1) // 1024 + 1)::BIGINT) ELSE [-1] END) AS rank FROM g),
 y AS (SELECT r.*, CASE WHEN rank >= 0 THEN coalesce(h.slot, (SELECT count(*) FROM k) + rank * n + sid) END AS slot,
   CASE WHEN rank >= 0 THEN least(z, (rank + 1) * 1024) - greatest(a, rank * 1024) ELSE 0 END AS words FROM r LEFT JOIN h USING (sid, rank))
SELECT doc_id, size, source_size, target, sum(words)::BIGINT AS taken, min(slot)::BIGINT AS first_slot, count(slot) AS n_draws
 FROM y GROUP BY rid, doc_id, size, source_size, target""",
    "op5_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
 w AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d),
 t AS (SELECT *, lead(a) OVER v AS b, lead(a, 2) OVER v AS c FROM w WINDOW v AS (PARTITION BY rid ORDER BY i)),
 g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM t WHERE c IS NOT NULL),
 r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE k > 1) GROUP BY rid),
 m AS (SELECT doc_id, text, ws, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
   len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
   FROM d LEFT JOIN r USING (rid)),
 q AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
 OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR n_symbols > 0.1 * word_chars OR 10 * n_symbols > 3 * n_words
 OR 3 * n_dup_lines > len(string_split(text, chr(10)))
 OR 2 * len(regexp_extract_all(text, '\p{{Lu}}')) > len(regexp_extract_all(text, '\p{{L}}'))
 OR 5 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) < 3 * n_words
 OR 2 * len(list_filter(ws, lambda x: regexp_matches(x, '(!!|\.\.\.)$'))) > n_words
 OR 10 * n_repeat_words > 4 * n_words) AS kept FROM q""",
}
