"""Quality rules: a short-circuit cascade whose order comes from measured cost and rejection."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import WORD

_SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """*fails* is an SQL expression over a row's text and word_list that is true for a bad text."""

    name: str
    fails: str


#: Thresholds in the spirit of published web-text filters.
RULES = (
    Rule("mean_word_length", "size(word_list) > 0 and (word_chars > 20 * size(word_list) or word_chars < 2 * size(word_list))"),
    Rule("symbols", "n_symbols > 0.1 * word_chars"),
    Rule("symbol_words", "10 * n_symbols > 3 * size(word_list)"),
    Rule("duplicate_lines", "3 * n_dup_lines > size(split(text, '\\n'))"),
    Rule("shouting", "2 * regexp_count(text, '\\\\p{Lu}') > regexp_count(text, '\\\\p{L}')"),
    Rule("no_letters", "5 * size(filter(word_list, w -> w rlike '\\\\p{L}')) < 3 * size(word_list)"),
    Rule("marked_words", "2 * size(filter(word_list, w -> w rlike '(!!|\\\\.\\\\.\\\\.)$')) > size(word_list)"),
    Rule("repeated_words", "10 * n_repeat_words > 4 * size(word_list)"),
)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text and _row (the whole row as it was) of *docs*, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and word_list for more rules.

    All in SQL functions within the row: nothing moves. A null text counts as empty. For n_repeat_words the
    windows of a text that repeats any are sorted by hash and place, so that equal ones are neighbours; each of
    those covers three words. The 64-bit hashes meet those of one text alone.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    out = out.withColumn("word_list", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    out = out.withColumn("n_words", F.size("word_list").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("word_list", "")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count("text", F.lit(_SYMBOLS)).cast("long"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    out = out.withColumn("_lines", lines)
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    n = F.size("word_list")
    out = out.withColumn("_hash", F.when(n >= 3, F.expr("transform(sequence(0, size(word_list) - 3), i -> xxhash64(word_list[i], word_list[i + 1], word_list[i + 2]))")))
    # Most texts repeat no window; only the others sort theirs.
    out = out.withColumn("_win", F.when(F.size(F.array_distinct("_hash")) < F.size("_hash"), F.array_sort(F.arrays_zip(F.col("_hash").alias("h"), F.sequence(F.lit(0), F.size("_hash") - 1).alias("i")))))
    out = out.withColumn("_at", F.filter(F.transform("_win", lambda x, i: F.when(((i > 0) & (F.get("_win", i - 1)["h"] == x["h"])) | (F.get("_win", i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull()))
    cover = F.size(F.array_distinct(F.flatten(F.transform("_at", lambda p: F.array(p, p + 1, p + 2)))))
    return out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_at").isNotNull(), cover), F.lit(0)).cast("long")).drop("_hash", "_win", "_at")


def plan_cascade(measured: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 400) -> list[Rule]:
    """*rules* ordered by rejection per cost, both estimated on the first *sample* rows that Spark reads.

    The sample decides the order of evaluation alone, never a verdict: a cascade rejects the same texts in any
    order. Cost is the time of the rule over the sample, rejection the share of texts it turns down; a rule
    that rejects nothing there comes last, the cheap ones first.
    """
    some = measured.select("text", "word_list", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").limit(sample).cache()
    try:
        total = max(some.count(), 1)
        rated = []
        for r in rules:
            began = time.perf_counter()
            bad = some.agg(F.sum(F.expr(f"cast(({r.fails}) as int)"))).first()[0] or 0
            cost = time.perf_counter() - began
            rated.append((-(bad / total) / cost, cost, r.name, r))
    finally:
        some.unpersist()
    return [x[-1] for x in sorted(rated, key=lambda x: x[:3])]


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 400) -> DataFrame:
    """measures() with base_failed, rejected_by (null: kept): see quality_rules."""
    base = measures(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.when(failed, F.lit("base"))
    for r in plan_cascade(base, rules, sample):
        verdict = verdict.when(F.expr(f"coalesce({r.fails}, false)"), F.lit(r.name))
    return base.withColumn("base_failed", failed).withColumn("rejected_by", verdict)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 400) -> DataFrame:
    """Per row of *docs*: doc_id, the base measures, base_failed, kept, and the rule that rejected it.

    base_failed holds for under 50 words, or if over half the words are in repeated windows. The others go
    through *rules* in the order of plan_cascade; a text leaves at its first failing rule, which CASE sees to:
    later branches of a row aren't evaluated. Null and empty texts fail; repeated rows get equal rows; other
    columns are ignored; an empty table gives an empty result.
    """
    out = judged(docs, rules, sample)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 400) -> DataFrame:
    """The rows of *docs* that quality_rules keeps, as they were."""
    # A condition is pushed below the columns that it reads by writing them out in it, all nested measures again and
    # again; one that holds an id of the row stays above them. Ids are never negative.
    rejected = F.col("rejected_by").isNotNull() | (F.monotonically_increasing_id() < 0)
    return judged(docs, rules, sample).select("_row", rejected.alias("_rejected")).where("not _rejected").select("_row.*")
