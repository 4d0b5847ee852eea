"""The registered queries of the search engine, over the driver's tables, and the SQL that some are held against.

The document index has text (analysed) with lang and source as string filters and n_chars as a number; part and
lineitem serve as metadata tables with several values a record.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import SearchError
from .functions.analysis import STOP_WORDS
from .operators.aggregate import FLAT, aggregate, check, flat, stats_frame
from .operators.filters import compile_filter
from .operators.search import Searcher
from .operators.trace import trace_frame
from .sources.index import Options, Tables, TextIndex, TextReader, as_records, build, validate_options
from .streaming.ingest import publish_batch

DOCUMENTS = validate_options([{"name": "text"}], [{"name": "lang", "type": "string"}, {"name": "source", "type": "string"}, {"name": "n_chars", "type": "number"}], surface_terms=True)
PARTS = validate_options([{"name": "name"}], [{"name": "brand", "type": "string"}, {"name": "price", "type": "number"}, {"name": "size", "type": "number"}, {"name": "quantity", "type": "number"}, {"name": "flag", "type": "string"}])

WIDE = validate_options(["text", {"name": "source", "weight": 3}], synonyms=[{"source": "ofonrereer", "replacements": ["thndly"]}])

LABELLED = validate_options(["text"], [{"name": "lang", "type": "string"}, {"name": "quality", "type": "number"}, {"name": "toxic", "type": "number"}])

_built: dict[tuple[str, str, str], Tables] = {}


def document_records(spark: SparkSession, sf_dir: str, options: Options = DOCUMENTS) -> DataFrame:
    return as_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), options, id_col="doc_id")


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(F.collect_list("l_quantity").alias("quantity"), F.collect_set("l_returnflag").alias("flag"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    return as_records(parts, PARTS, id_col="p_partkey", fields={"name": "p_name"}, filters={"brand": "p_brand", "price": "p_retailprice", "size": "p_size"})


def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, which some don't have."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    return as_records(docs, LABELLED, id_col="doc_id")


def _index(spark: SparkSession, sf_dir: str, name: str, make: Callable, options: Options) -> Searcher:
    """The table's index, built once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = build(make(spark, sf_dir), options)
    return Searcher(_built[key])


def documents(spark: SparkSession, sf_dir: str) -> Searcher:
    return _index(spark, sf_dir, "documents", document_records, DOCUMENTS)


def parts(spark: SparkSession, sf_dir: str) -> Searcher:
    return _index(spark, sf_dir, "parts", part_records, PARTS)


def wide(spark: SparkSession, sf_dir: str) -> Searcher:
    return _index(spark, sf_dir, "wide", lambda s, d: document_records(s, d, WIDE), WIDE)


def _scores(df: DataFrame) -> DataFrame:
    return df.select("id", F.round(F.col("score").cast("double"), 4).alias("score"))


def _search(req: dict, index: Callable[[SparkSession, str], Searcher] = documents) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _scores(index(spark, sf_dir).matches(req))


def _filter(expr: dict, records: Callable[[SparkSession, str], DataFrame] = part_records, options: Options = PARTS) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: records(spark, sf_dir).where(compile_filter(expr, options.kinds)).select("id")


def _code(run: Callable[[SparkSession, str], object]) -> Callable[[SparkSession, str], DataFrame]:
    """The code of the error that a request ends in, or 'ok'."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        try:
            run(spark, sf_dir)
            code = "ok"
        except SearchError as e:
            code = e.code
        return spark.createDataFrame([(code,)], "code string")

    return query


# A tokeniser in SQL for ASCII words: folded runs of letters and digits, stop words out, under 40 bytes. Words that are
# asked for come with the words of this corpus that have their stem.
_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_TOKENS = rf"""
runs AS (SELECT doc_id::VARCHAR AS id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
raw AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM runs),
tok AS (SELECT id, w, p FROM raw WHERE w NOT IN ({_STOP}) AND strlen(w) < 40),
sur AS (SELECT id, w FROM raw WHERE strlen(w) < 40),
n AS (SELECT (SELECT count(*) FROM documents) AS n)"""


def _rank(tf: str = "tf", df: str = "df") -> str:
    return f"ln(1 + (n - {df} + 0.5) / ({df} + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len / avg))"


def _lengths(table: str) -> str:
    return f"len AS (SELECT id, count(*) AS len, sum(count(*)) OVER () / (SELECT n FROM n) AS avg FROM {table} GROUP BY id)"


def _bm25(terms: dict[str, list[str]], having: str = "", select: str = "id, round(s::DOUBLE, 4) AS score", tail: str = "", weight: str = "") -> str:
    """SQL for the sum of BM25 over terms, each given by the surface forms whose stem it is."""
    cases = " ".join(f"WHEN w IN ({', '.join(repr(x) for x in forms)}) THEN {k}" for k, forms in enumerate(terms.values()))
    return f"""WITH {_TOKENS}, {_lengths("tok")},
hit AS (SELECT id, k, count(*) AS tf FROM (SELECT id, CASE {cases} END AS k FROM tok) WHERE k IS NOT NULL GROUP BY id, k),
df AS (SELECT k, count(*) AS df FROM hit GROUP BY k),
r AS (SELECT id, ({weight}sum({_rank()}))::FLOAT AS s FROM hit JOIN df USING (k) JOIN len USING (id), n GROUP BY id {having})
SELECT {select} FROM r {tail}"""


def _near_sql(table: str, near: str, exact: str) -> str:
    """SQL for an inexact match: the exact words' best BM25 with its bonus, or the flat score of words that are near."""
    return f"""WITH {_TOKENS}, {_lengths(table)},
hit AS (SELECT id, w, count(*) AS tf FROM {table} WHERE {exact} GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM hit GROUP BY w),
e AS (SELECT id, max({_rank()}) + 1.25 AS s FROM hit JOIN df USING (w) JOIN len USING (id), n GROUP BY id),
words AS (SELECT DISTINCT w FROM {table} WHERE {near}),
f AS (SELECT DISTINCT id, 0.25 AS s FROM {table} JOIN words USING (w))
SELECT id, round(max(s)::FLOAT::DOUBLE, 4) AS score FROM (FROM e UNION ALL FROM f) GROUP BY id"""


_PART = """WITH v AS (SELECT l_partkey, list(l_quantity) AS quantity, list(DISTINCT l_returnflag) AS flag FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey::VARCHAR AS id, p_brand AS brand, p_retailprice AS price, p_size AS size, coalesce(quantity, []) AS quantity, coalesce(flag, []) AS flag FROM part LEFT JOIN v ON p_partkey = l_partkey)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, run: Callable, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# Analysis: a query word meets all words of its stem; a synonym is indexed beside its source.
_LICENSE = {"licens": ["license", "licensed", "licenses", "licensing"]}
_add("a7_stem", _search({"text": "licenses"}), _bm25(_LICENSE))
_add("a8_synonyms", _search({"text": "thndly", "fields": ["text"]}, wide), f"""WITH {_TOKENS},
stacked AS (SELECT id, w FROM tok UNION ALL SELECT id, 'thndly' FROM tok WHERE w = 'ofonrereer'), {_lengths("stacked")},
hit AS (SELECT id, count(*) AS tf FROM stacked WHERE w = 'thndly' GROUP BY id), d AS (SELECT count(*) AS df FROM hit)
SELECT id, round(({_rank()})::FLOAT::DOUBLE, 4) AS score FROM hit JOIN len USING (id), d, n""")
_add("m8_fields", _search({"text": "src1", "fields": ["source"]}, wide), """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE source = 'src1') AS df, count(source) AS total FROM documents)
SELECT doc_id::VARCHAR AS id, round((3 * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / total)))::FLOAT::DOUBLE, 4) AS score FROM documents, n WHERE source = 'src1'""")

# Match modes; the words are of the corpus.
_TWO = {"ofonrereer": ["ofonrereer"], "thndly": ["thndly"]}
_BOTH = "HAVING count(DISTINCT k) = 2"
_add("m1_any", _search({"text": "ofonrereer thndly", "mode": "any"}), _bm25(_TWO))
_add("m2_all", _search({"text": "ofonrereer thndly", "mode": "all"}), _bm25(_TWO, _BOTH))
_add("m3_phrase", _search({"text": "ofonrereer thndly", "mode": "phrase"}), f"""WITH {_TOKENS}, {_lengths("tok")},
df AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT w, count(DISTINCT id) AS df FROM tok WHERE w IN ('ofonrereer', 'thndly') GROUP BY w), n),
hit AS (SELECT a.id, count(*) AS tf FROM tok a JOIN tok b ON a.id = b.id AND b.p = a.p + 1 WHERE a.w = 'ofonrereer' AND b.w = 'thndly' GROUP BY a.id)
SELECT id, round((idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg)))::FLOAT::DOUBLE, 4) AS score FROM hit JOIN len USING (id), df""")
_add("m4_prefix", _search({"text": "licens", "mode": "prefix"}), f"""WITH {_TOKENS}, {_lengths("sur")},
hit AS (SELECT id, w, count(*) AS tf FROM sur WHERE w LIKE 'licens%' GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM hit GROUP BY w)
SELECT id, round(max({_rank()})::FLOAT::DOUBLE, 4) AS score FROM hit JOIN df USING (w) JOIN len USING (id), n GROUP BY id""")
_add("m4_prefix_too_broad", _code(lambda spark, d: documents(spark, d).matches({"text": "th", "mode": "prefix"})), "SELECT 'E_PREFIX_TOO_BROAD' AS code")
_add("m4_prefix_expansions", _code(lambda spark, d: documents(spark, d).matches({"text": "ofonre", "mode": "prefix"})), f"WITH {_TOKENS} SELECT CASE WHEN count(DISTINCT w) > 50 THEN 'E_PREFIX_TOO_BROAD' ELSE 'ok' END AS code FROM sur WHERE w LIKE 'ofonre%'")
_add("m5_fuzzy", _search({"text": "haatst", "mode": "fuzzy"}), _near_sql("tok", "length(w) BETWEEN 5 AND 7 AND damerau_levenshtein(w, 'haatst') <= 1", "w = 'haatst'"))
_add("m6_fuzzy_prefix", _search({"text": "ofonrere", "mode": "fuzzy-prefix"}), _near_sql("sur", "length(w) >= 7 AND (damerau_levenshtein(left(w, 7), 'ofonrere') <= 1 OR damerau_levenshtein(left(w, 8), 'ofonrere') <= 1 OR damerau_levenshtein(left(w, 9), 'ofonrere') <= 1)", "w LIKE 'ofonrere%'"))
_add("m7_fuzzy_distance", _search({"text": "ungpfau", "mode": "fuzzy", "fuzzyDistance": 2, "fuzzyTranspositions": False}), _near_sql("tok", "length(w) BETWEEN 5 AND 9 AND levenshtein(w, 'ungpfau') <= 2", "w = 'ungpfau'"))
_add("b1_and", _search({"query": {"operator": "and", "clauses": [{"text": "ofonrereer"}, {"text": "thndly"}]}}), _bm25(_TWO, _BOTH))
_add("b2_or", _search({"query": {"operator": "or", "clauses": [{"text": "ofonrereer"}, {"text": "thndly"}]}}), _bm25(_TWO))
_add("b3_not", _search({"query": {"operator": "not", "clause": {"text": "ofonrereer thndly"}}}), f"SELECT doc_id::VARCHAR AS id, 0.0::DOUBLE AS score FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT id FROM ({_bm25(_TWO)}))")
_add("b4_boost", _search({"query": {"operator": "boost", "boost": 2, "clause": {"text": "ofonrereer thndly"}}}), _bm25(_TWO, weight="2 * "))
_add("b5_optional", _search({"query": {"operator": "optional", "required": {"text": "ofonrereer"}, "optional": [{"text": "thndly"}]}}), _bm25(_TWO, "HAVING bool_or(k = 0)"))
_add("b6_candidates", _search({"text": "ofonrereer thndly", "candidateIds": [str(k) for k in range(100, 400)]}), f"SELECT * FROM ({_bm25(_TWO)}) WHERE id::BIGINT BETWEEN 100 AND 399")
_add("b7_filter", _search({"text": "ofonrereer thndly", "filter": {"operator": "and", "clauses": [{"field": "lang", "comparator": "equals", "value": "en"}, {"field": "n_chars", "comparator": "ge", "value": 2000}]}}), f"SELECT x.* FROM ({_bm25(_TWO)}) x JOIN documents d ON x.id = d.doc_id::VARCHAR WHERE lang = 'en' AND n_chars >= 2000")


def _ranked(req: dict) -> Callable[[SparkSession, str], DataFrame]:
    """A window in order; the rank is by the order in which its rows come."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = documents(spark, sf_dir).ranked(req).collect()  # a window has 10,000 rows at most
        first = req.get("offset", 0)
        return spark.createDataFrame([(first + k, r["id"], round(r["score"], 4)) for k, r in enumerate(rows)], "rank int, id string, score double")

    return query


_PLACE = "(row_number() OVER (ORDER BY s DESC, id) - 1)::INTEGER AS rank, id, round(s::DOUBLE, 4) AS score"
_add("t1_top_k", _ranked({"text": "ofonrereer thndly", "limit": 50}), _bm25(_TWO, select=_PLACE, tail="ORDER BY rank LIMIT 50"))
_add("t2_window", _ranked({"text": "ofonrereer thndly", "offset": 5, "limit": 10}), _bm25(_TWO, select=_PLACE, tail="ORDER BY rank LIMIT 10 OFFSET 5"))
_add("t3_prefix_window", _code(lambda spark, d: documents(spark, d).ranked({"text": "licens", "mode": "prefix", "limit": 101})), "SELECT 'E_INVALID_ARGUMENT' AS code")
_add("t4_total", lambda spark, d: documents(spark, d).matches({"text": "ofonrereer thndly"}).agg(F.count("*").alias("total")), f"SELECT count(*) AS total FROM ({_bm25(_TWO)})")


def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = documents(spark, sf_dir).search({"text": "ofonrereer thndly", "offset": 5, "limit": 10})
    return spark.createDataFrame([(got["total"], got["totalRelation"], len(got["hits"]))], "total long, relation string, hits int")


_add("t4_lower_bound", _bounded, f"SELECT least(count(*), 15) AS total, CASE WHEN count(*) > 15 THEN 'lower-bound' ELSE 'exact' END AS relation, greatest(least(count(*) - 5, 10), 0)::INTEGER AS hits FROM ({_bm25(_TWO)})")
_add("t5_sort", _ranked({"text": "ofonrereer thndly", "sort": [{"field": "lang", "direction": "desc", "missing": "last"}, {"field": "n_chars", "direction": "asc", "missing": "first"}], "limit": 25}), f"SELECT (row_number() OVER w - 1)::INTEGER AS rank, x.id, score FROM ({_bm25(_TWO)}) x JOIN documents d ON x.id = d.doc_id::VARCHAR WINDOW w AS (ORDER BY lang DESC NULLS LAST, n_chars NULLS FIRST, x.id) ORDER BY rank LIMIT 25")


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyset traversal, a hundred hits a page, until no continuation is left."""
    s, req, rows, k = documents(spark, sf_dir), {"text": "ofonrereer thndly", "limit": 100}, [], 0
    while True:
        got = s.search_page(req)
        rows += [(k, h["id"]) for h in got["hits"]]
        if "continuation" not in got:
            return spark.createDataFrame(rows, "page int, id string")
        req, k = req | {"continuation": got["continuation"]}, k + 1


_add("t6_pages", _page, _bm25(_TWO, select="((row_number() OVER (ORDER BY s DESC, id) - 1) // 100)::INTEGER AS page, id"))


def _forged(spark: SparkSession, sf_dir: str) -> None:
    """A continuation is of one request alone."""
    s = documents(spark, sf_dir)
    token = s.search_page({"text": "ofonrereer thndly", "limit": 1})["continuation"]
    s.search_page({"text": "ofonrereer", "limit": 1, "continuation": token})


_add("t7_continuation", _code(_forged), "SELECT 'E_INVALID_ARGUMENT' AS code")

# Filters over records of several values.
for _name, _expr, _sql in (
    ("f1_equals", {"field": "brand", "comparator": "equals", "value": "Brand#11"}, "brand = 'Brand#11'"),
    ("f2_in", {"field": "brand", "comparator": "in", "value": ["Brand#11", "Brand#23", "Brand#45"]}, "brand IN ('Brand#11', 'Brand#23', 'Brand#45')"),
    ("f3_lt", {"field": "price", "comparator": "lt", "value": 950}, "price < 950"),
    ("f4_le", {"field": "size", "comparator": "le", "value": 10}, "size <= 10"),
    ("f5_gt", {"field": "quantity", "comparator": "gt", "value": 49}, "list_max(quantity) > 49"),
    ("f6_ge", {"field": "size", "comparator": "ge", "value": 40}, "size >= 40"),
    ("f7_between", {"field": "quantity", "comparator": "between", "value": [10, 11]}, "len(list_filter(quantity, lambda q: q BETWEEN 10 AND 11)) > 0"),
    ("f10_and", {"operator": "and", "clauses": [{"field": "size", "comparator": "ge", "value": 10}, {"field": "flag", "comparator": "equals", "value": "A"}]}, "size >= 10 AND list_contains(flag, 'A')"),
    ("f11_or", {"operator": "or", "clauses": [{"field": "size", "comparator": "le", "value": 3}, {"field": "price", "comparator": "gt", "value": 1800}]}, "size <= 3 OR price > 1800"),
):
    _add(_name, _filter(_expr), f"{_PART} SELECT id FROM p WHERE {_sql}")
for _name, _expr, _sql in (
    ("f8_exists", {"field": "quality", "comparator": "exists"}, "quality IS NOT NULL"),
    ("f9_missing", {"field": "quality", "comparator": "missing"}, "quality IS NULL"),
    ("f12_not", {"operator": "not", "clause": {"field": "quality", "comparator": "equals", "value": 1}}, "quality IS DISTINCT FROM 1"),
):
    _add(_name, _filter(_expr, labelled_records, LABELLED), f"SELECT doc_id::VARCHAR AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE {_sql}")

# Facets, as users ask for them, with each bucket a row.
def _facets(requests: list[dict], records: Callable[[SparkSession, str], DataFrame] = part_records) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        check(requests, PARTS.kinds if records is part_records else DOCUMENTS.kinds)
        rows = flat(aggregate(records(spark, sf_dir), requests))  # an answer has 1,024 buckets at most
        return spark.createDataFrame([("/".join(r[0]), *r[1:]) for r in rows], FLAT.replace("path array<string>", "path string"))

    return query


def _bucket(path: str, name: str, key: str, count: str = "count(*)", stats: str = "NULL::DOUBLE AS sum, NULL::DOUBLE AS min, NULL::DOUBLE AS max", other: str = "NULL::BIGINT") -> str:
    return f"SELECT {path} AS path, '{name}' AS name, {key} AS key, {count} AS count, {stats}, {other} AS other"


_RANGES = [{"to": 10}, {"from": 10, "to": 30}, {"from": 30}]
_BAND = "CASE WHEN q < 10 THEN '*-10' WHEN q < 30 THEN '10-30' ELSE '30-*' END"
_STATS = "coalesce(sum(q), 0) AS sum, min(q) AS min, max(q) AS max"
_add("g1_terms", _facets([{"name": "brands", "type": "terms", "field": "brand", "size": 7}]), f"""{_PART}, c AS (SELECT brand AS key, count(*) AS n FROM p GROUP BY 1),
t AS (SELECT * FROM c ORDER BY n DESC, key LIMIT 7)
{_bucket("''", "brands", "key", "n", other="(SELECT sum(n) FROM c) - (SELECT sum(n) FROM t)")} FROM t""")
_add("g2_stats", lambda spark, d: stats_frame(part_records(spark, d), "quantity"), f"{_PART} SELECT count(q) AS count, coalesce(sum(q), 0) AS sum, min(q) AS min, max(q) AS max, avg(q) AS avg FROM (SELECT unnest(quantity) AS q FROM p)")
_add("g3_histogram", _facets([{"name": "h", "type": "histogram", "field": "quantity", "interval": 10}]), f"{_PART} {_bucket(repr(''), 'h', 'key::INTEGER::VARCHAR')} FROM (SELECT id, unnest(list_distinct(list_transform(quantity, lambda q: floor(q / 10.0) * 10.0))) AS key FROM p) GROUP BY key")
_add("g4_range", _facets([{"name": "r", "type": "range", "field": "quantity", "ranges": [{"from": 0, "to": 10}, {"from": 10, "to": 30}]}]), f"""{_PART}, b(key, k) AS (VALUES ('*-0', 0), ('0-10', 1), ('10-30', 2), ('30-*', 3)),
c AS (SELECT k, count(*) AS n FROM (SELECT id, unnest(list_distinct(list_transform(quantity, lambda q: CASE WHEN q < 0 THEN 0 WHEN q < 10 THEN 1 WHEN q < 30 THEN 2 ELSE 3 END))) AS k FROM p) GROUP BY k)
{_bucket(repr(''), 'r', 'key', 'coalesce(n, 0)')} FROM b LEFT JOIN c USING (k)""")
_add("g5_nested", _facets([{"name": "brands", "type": "terms", "field": "brand", "size": 5, "aggregations": [
    {"name": "flags", "type": "terms", "field": "flag", "size": 2, "aggregations": [{"name": "amounts", "type": "stats", "field": "quantity"}]},
    {"name": "bands", "type": "range", "field": "quantity", "ranges": _RANGES}]}]), f"""{_PART}, c AS (SELECT brand, count(*) AS n FROM p GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, brand LIMIT 5),
s AS (SELECT p.* FROM p JOIN t USING (brand)),
f AS (SELECT brand, flag, count(*) AS n FROM (SELECT brand, unnest(flag) AS flag FROM s) GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY brand) - sum(n) OVER (PARTITION BY brand ORDER BY n DESC, flag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS rest, row_number() OVER (PARTITION BY brand ORDER BY n DESC, flag) AS place FROM f),
k AS (SELECT brand, flag, n, min(rest) FILTER (WHERE place = 1) OVER (PARTITION BY brand) AS rest FROM u QUALIFY place <= 2),
b(key) AS (VALUES ('*-10'), ('10-30'), ('30-*')),
r AS (SELECT brand, key, count(*) AS n FROM (SELECT brand, unnest(list_distinct(list_transform(quantity, lambda q: {_BAND}))) AS key FROM s) GROUP BY ALL)
{_bucket("''", "brands", "brand", "n", other="(SELECT sum(n) FROM c) - (SELECT sum(n) FROM t)")} FROM t
UNION ALL {_bucket("brand", "flags", "flag", "n", other="rest")} FROM k
UNION ALL {_bucket("brand || '/' || flag", "amounts", "NULL", "count(q)", _STATS)} FROM (SELECT s.brand, k.flag, unnest(quantity) AS q FROM s JOIN k ON s.brand = k.brand AND list_contains(s.flag, k.flag)) GROUP BY brand, flag
UNION ALL {_bucket("brand", "bands", "key", "coalesce(n, 0)")} FROM (SELECT brand, key FROM t, b) LEFT JOIN r USING (brand, key)""")
_add("g6_count", lambda spark, d: part_records(spark, d).where(compile_filter({"field": "flag", "comparator": "exists"}, PARTS.kinds)).agg(F.count("*").alias("n")), f"{_PART} SELECT count(*) AS n FROM p WHERE len(flag) > 0")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, hits and facets of one search."""
    got = documents(spark, sf_dir).search({"text": "ofonrereer thndly", "limit": 3, "aggregations": [{"name": "langs", "type": "terms", "field": "lang", "size": 2}, {"name": "chars", "type": "stats", "field": "n_chars"}]})
    rows = [("", "total", got["totalRelation"], got["total"], None, None, None, None), *(("/".join(r[0]), *r[1:]) for r in flat(got["aggregations"]))]
    return spark.createDataFrame(rows, FLAT.replace("path array<string>", "path string"))


_add("g7_fused", _fused, f"""WITH m AS (SELECT d.* FROM ({_bm25(_TWO)}) x JOIN documents d ON x.id = d.doc_id::VARCHAR),
c AS (SELECT lang, count(*) AS n FROM m WHERE lang IS NOT NULL GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, lang LIMIT 2)
{_bucket("''", "total", "'exact'")} FROM m
UNION ALL {_bucket("''", "langs", "lang", "n", other="(SELECT sum(n) FROM c) - (SELECT sum(n) FROM t)")} FROM t
UNION ALL {_bucket("''", "chars", "NULL", "count(n_chars)", "coalesce(sum(n_chars), 0)::DOUBLE AS sum, min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max")} FROM m""")

# Dictionary, tracing, mutations.
_add("s4_dictionary_range", lambda spark, d: documents(spark, d).t.terms.where("surface and startswith(term, 'thed')").select("term", "df"), f"WITH {_TOKENS} SELECT w AS term, count(DISTINCT id) AS df FROM raw WHERE w LIKE 'thed%' AND strlen(w) < 40 GROUP BY w")
# Spans start at UTF-16 units; the corpus has none beyond the first 65,536 code points.
_add("h1_trace", lambda spark, d: _spans(spark, d, {"text": "ofonrereer thndly"}), f"WITH {_TOKENS} SELECT id, count(*)::INTEGER AS n, max(strlen(w))::INTEGER AS longest FROM tok WHERE w IN ('ofonrereer', 'thndly') GROUP BY id")
_add("h2_trace_phrase", lambda spark, d: _spans(spark, d, {"text": "ofonrereer thndly", "mode": "phrase"}, longest=False), f"WITH {_TOKENS} SELECT a.id, count(*)::INTEGER AS n FROM tok a JOIN tok b ON a.id = b.id AND b.p = a.p + 1 WHERE a.w = 'ofonrereer' AND b.w = 'thndly' GROUP BY a.id")
_add("h2_trace_prefix", lambda spark, d: _spans(spark, d, {"text": "licens", "mode": "prefix"}), f"WITH {_TOKENS} SELECT id, count(*)::INTEGER AS n, max(strlen(w))::INTEGER AS longest FROM sur WHERE w LIKE 'licens%' GROUP BY id")
_add("h3_trace_boolean", lambda spark, d: _spans(spark, d, {"query": {"operator": "and", "clauses": [{"text": "thndly"}, {"operator": "not", "clause": {"text": "ofonrereer"}}]}}), f"WITH {_TOKENS} SELECT id, count(*)::INTEGER AS n, max(strlen(w))::INTEGER AS longest FROM tok WHERE w = 'thndly' AND id NOT IN (SELECT id FROM tok WHERE w = 'ofonrereer') GROUP BY id")


def _spans(spark: SparkSession, sf_dir: str, req: dict, longest: bool = True) -> DataFrame:
    """How many spans each matching document has, and units of the longest one."""
    got = trace_frame(req, document_records(spark, sf_dir), DOCUMENTS).select("id", F.size("spans").alias("n"), F.array_max(F.transform("spans", lambda x: x["end"] - x["start"])).alias("longest"))
    return got if longest else got.drop("longest")


def _changes(docs: DataFrame) -> DataFrame:
    """A batch that has every id: those divisible by 3 are deleted, the others put anew, the even ones with a new word."""
    text = F.when(F.col("id") % 2 == 0, F.concat("text", F.lit(" newcomer"))).otherwise(F.col("text"))
    return docs.withColumns({"op": F.when(F.col("id") % 3 == 0, "delete").otherwise("upsert"), "seq": F.lit(1), "text": text})


def _scratch(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir, which all executors share; a temporary one serves local sessions alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quillspark-index-{uuid.uuid4().hex}"


def _published(spark: SparkSession, sf_dir: str) -> TextIndex:
    """A stored index of the whole table, after two batches: all documents, and changes of all of them."""
    index = TextIndex.open(spark, _scratch(spark), DOCUMENTS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "id")
    publish_batch(index, docs.withColumns({"op": F.lit("upsert"), "seq": F.lit(0)}), 0)
    publish_batch(index, _changes(docs), 1)
    return index


def _mutate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest two batches of the whole table into a stored index, the second with updates and deletes; ids with the new word."""
    return Searcher(_published(spark, sf_dir).tables).matches({"text": "newcomer"}).select("id")


_add("s7_publish", _mutate, "SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).t.terms.where("surface").select("term").distinct()
    from .operators.match import _near

    return words.where(_near("thedre", 1, True, False))


_add("x5_edit_distance", _edits, f"WITH {_TOKENS} SELECT DISTINCT w AS term FROM raw WHERE strlen(w) < 40 AND length(w) BETWEEN 5 AND 7 AND damerau_levenshtein(w, 'thedre') <= 1")

_add("s2_reader", lambda spark, d: _scores(Searcher(TextReader.open(spark, _published(spark, d).path, DOCUMENTS).tables).matches({"text": "ofonrereer newcomer", "mode": "all"})), f"""WITH {_TOKENS},
live AS (SELECT id, w FROM tok WHERE id::BIGINT % 3 <> 0 UNION ALL SELECT doc_id::VARCHAR, 'newcomer' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0 AND text IS NOT NULL),
m AS (SELECT count(*) AS n FROM documents WHERE doc_id % 3 <> 0),
len AS (SELECT id, count(*) AS len, sum(count(*)) OVER () / (SELECT n FROM m) AS avg FROM live GROUP BY id),
hit AS (SELECT id, w, count(*) AS tf FROM live WHERE w IN ('ofonrereer', 'newcomer') GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM hit GROUP BY w)
SELECT id, round(sum({_rank()})::FLOAT::DOUBLE, 4) AS score FROM hit JOIN df USING (w) JOIN len USING (id), m GROUP BY id HAVING count(*) = 2""")
