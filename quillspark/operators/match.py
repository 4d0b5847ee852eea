"""Match modes and their Boolean composition, compiled to a DataFrame (id, score)."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SearchError, invalid
from ..functions.analysis import TOKEN_BYTES, analyze, edits, fuzzy_eligible, query_terms, surface
from ..plans.request import CLAUSES, EXPANSIONS, FUZZY_TERMS, FUZZY_UNITS, PHRASE_POSITIONS, TERMS, leaves
from ..ship import ship
from ..sources.index import Tables

#: BM25's constants, and what an inexact match scores for each unit of weight.
K1, B, INEXACT = 1.2, 0.75, 0.25


def _near(term: str, distance: int, swaps: bool, prefix: bool) -> Column:
    """Whether a term column is within *distance* of *term*, lengths first."""
    n = F.length("term")
    size = n >= len(term) - distance if prefix else n.between(len(term) - distance, len(term) + distance)
    if not swaps and not prefix:
        return size & (F.levenshtein("term", F.lit(term), distance) >= 0)

    @F.pandas_udf("boolean")
    def close(words: pd.Series) -> pd.Series:
        return words.map(lambda w: edits(term, w, swaps, prefix) <= distance).astype(bool)

    # A swap is two edits there, so nothing near is lost, and few words are left for Python.
    most = 2 * distance if swaps else distance
    heads = [F.substring("term", 1, k) for k in range(max(1, len(term) - distance), len(term) + distance + 1)] if prefix else [F.col("term")]
    maybe = reduce(lambda a, b: a | b, (F.levenshtein(h, F.lit(term), most) >= 0 for h in heads))
    return size & maybe & close("term")


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p + by)


class Matcher:
    """Compiles checked request trees over an index's tables."""

    def __init__(self, t: Tables):
        self.t, self.at = t, {n: k for k, n in enumerate(t.options.names)}
        ship(t.spark)

    def _fields(self, node: dict) -> list[int]:
        return [self.at[f] for f in node["fields"]]

    def _empty(self) -> DataFrame:
        return self.t.spark.createDataFrame([], "id string, score double")

    def _scored(self, terms: list[str], fields: list[int], raw: bool) -> DataFrame:
        """Postings of the terms with k (place in *terms*), their score and their weight.

        The dictionary tells how many documents have a term; a row for each term and field comes to the driver.
        """
        asked = self.t.terms.where((F.col("surface") == raw) & F.col("field").isin(fields) & F.col("term").isin(terms))
        rows = [(terms.index(r["term"]), r["field"], r["term"], *self._rank(r["df"], r["field"], raw)) for r in asked.collect()]
        known = F.broadcast(self.t.spark.createDataFrame(rows, "k int, field int, term string, idf double, avg double, w double"))
        posts = self.t.postings.where((F.col("surface") == raw) & F.col("field").isin(fields) & F.col("term").isin(terms))
        return posts.join(known, ["field", "term"]).withColumn("score", F.col("w") * self._bm25(F.col("tf"), F.col("idf")))

    def _rank(self, df: int, field: int, raw: bool) -> tuple[float, float, float]:
        n = self.t.n_docs
        return math.log(1 + (n - df + 0.5) / (df + 0.5)), max(self.t.totals.get((raw, field), 0) / max(n, 1), 1e-9), float(self.t.options.fields[field][1])

    @staticmethod
    def _bm25(tf: Column, idf: Column) -> Column:
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))

    def leaf(self, node: dict) -> DataFrame:
        mode, fields, stop = node["mode"], self._fields(node), self.t.options.stop_words
        if mode in ("prefix", "fuzzy-prefix"):
            return self._prefix(node, fields)
        if mode == "fuzzy":
            return self._fuzzy(node, fields)
        if mode == "phrase":
            return self._phrase([(t.term, t.position) for t in analyze(node["text"], stop)], fields)
        terms = query_terms(node["text"], stop)
        return self._any(terms, fields) if mode == "any" else self._all(terms, fields)

    def _limit(self, terms: list) -> None:
        if len(terms) > TERMS:
            raise SearchError("E_RESOURCE_LIMIT", f"a query may have {TERMS} terms")

    def _any(self, terms: list[str], fields: list[int]) -> DataFrame:
        self._limit(terms)
        return self._scored(terms, fields, False).groupBy("id").agg(F.sum("score").alias("score")) if terms else self._empty()

    def _all(self, terms: list[str], fields: list[int]) -> DataFrame:
        self._limit(terms)
        if not terms:
            return self._empty()
        # A bit for each term: the partial results of a map-side aggregate stay small.
        seen = self._scored(terms, fields, False).groupBy("id").agg(F.sum("score").alias("score"), F.bit_or(F.expr("shiftleft(1L, k)")).alias("bits"))
        full = (1 << len(terms)) - 1
        return seen.where(F.col("bits") == (full if full < 2**63 else full - 2**64)).select("id", "score")

    def _phrase(self, placed: list[tuple[str, int]], fields: list[int]) -> DataFrame:
        if not self.t.options.positions:
            raise invalid("phrases need an index with positions")
        self._limit(placed)
        terms = list(dict.fromkeys(t for t, _ in placed))
        if len(placed) < 2:
            return self._any(terms, fields)
        per = self._scored(terms, fields, False).groupBy("id", "field").agg(F.map_from_entries(F.collect_list(F.struct("k", "positions"))).alias("at"), F.sum("idf").alias("idf"), F.max("len").alias("len"), F.max("avg").alias("avg"), F.max("w").alias("w"))
        first = placed[0][1]
        shifted = [_moved(F.col("at")[terms.index(t)], first - p) for t, p in placed]
        per = per.where(F.size("at") == len(terms)).withColumn("tf", F.size(reduce(F.array_intersect, shifted)))
        score = F.col("w") * self._bm25(F.col("tf"), F.col("idf"))
        return per.where("tf > 0").groupBy("id").agg(F.sum(score).alias("score"))

    def _need_surface(self) -> None:
        if not self.t.options.surface_terms:
            raise invalid("prefix modes need an index with surface terms")

    def _prefix(self, node: dict, fields: list[int]) -> DataFrame:
        self._need_surface()
        text, fuzzy = node["text"], node["mode"] == "fuzzy-prefix"
        whole = surface(text, True)
        if not whole or text[-1:].isspace():
            return self._all(query_terms(text, self.t.options.stop_words), fields)
        last = whole[-1]
        if len(last.term) < (4 if fuzzy else 3):
            raise SearchError("E_PREFIX_TOO_BROAD", "a prefix has 3 characters, a fuzzy one 4")
        if len(last.term.encode()) >= TOKEN_BYTES:
            raise invalid("the prefix is too long")
        done = list(dict.fromkeys(t.term for t in analyze(text, self.t.options.stop_words) if t.position < last.position))
        words = self.t.terms.where(F.col("surface") & F.col("field").isin(fields))
        found = [r[0] for r in words.where(F.col("term").startswith(last.term)).select("term").distinct().orderBy("term").limit(EXPANSIONS + 1).collect()]
        if len(found) > EXPANSIONS:
            raise SearchError("E_PREFIX_TOO_BROAD", f"over {EXPANSIONS} words begin with the prefix")
        best = self._scored(found, fields, True).groupBy("id").agg(F.max("score").alias("score")) if found else self._empty()
        if fuzzy:
            best = self._inexact(best, last.term, node, fields, True)
        if not done:
            return best
        return self._both([self._all(done, fields), best])

    def _inexact(self, exact: DataFrame, term: str, node: dict, fields: list[int], raw: bool) -> DataFrame:
        """The better of an exact score with its bonus and the flat score of an inexact match."""
        weights = {k: w for k, (_, w) in enumerate(self.t.options.fields) if k in fields}
        exact = exact.select("id", (F.col("score") + 1 + INEXACT * max(weights.values())).alias("score"))
        if node["distance"] == 0 or not fuzzy_eligible(term):
            return exact
        words = self.t.terms.where((F.col("surface") == raw) & F.col("field").isin(fields)).where(_near(term, node["distance"], node["swaps"], raw)).select("field", "term")
        w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
        posts = self.t.postings.where((F.col("surface") == raw) & F.col("field").isin(fields))
        near = posts.join(words, ["field", "term"]).select("id", (INEXACT * w[F.col("field")]).alias("score"))
        return exact.unionByName(near).groupBy("id").agg(F.max("score").alias("score"))

    def _fuzzy(self, node: dict, fields: list[int]) -> DataFrame:
        pairs = []
        for s in dict.fromkeys(t.term for t in surface(node["text"])):
            again = analyze(s, self.t.options.stop_words)
            if len(again) == 1:
                pairs.append((s, again[0].term))
        self._limit(pairs)
        if sum(fuzzy_eligible(s) for s, _ in pairs) > FUZZY_TERMS:
            raise SearchError("E_RESOURCE_LIMIT", f"at most {FUZZY_TERMS} fuzzy terms")
        parts = []
        for s, term in dict((t, (s, t)) for s, t in reversed(pairs)).values():
            exact = self._any([term], fields)
            parts.append(self._inexact(exact, term, node, fields, False) if fuzzy_eligible(s) else exact)
        if not parts:
            return self._empty()
        return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("score").alias("score"))

    @staticmethod
    def _both(parts: list[DataFrame]) -> DataFrame:
        """All of the parts: ids are once in each, so a count tells."""
        every = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
        return every.where(F.col("n") == len(parts)).select("id", "score")

    def tree(self, node: dict) -> DataFrame:
        """(id, score) of a checked tree: each id once."""
        op = node["op"]
        if op == "leaf":
            return self.leaf(node)
        parts = [self.tree(c) for c in node["of"]]
        if op == "and":
            return self._both(parts)
        if op == "or":
            return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("score").alias("score"))
        if op == "not":
            return self.t.docs.select("id").join(parts[0], "id", "left_anti").withColumn("score", F.lit(0.0))
        if op == "boost":
            return parts[0] if node["boost"] == 1 else parts[0].withColumn("score", F.col("score") * node["boost"])
        need = self.tree(node["required"]).withColumn("need", F.lit(1))
        every = reduce(DataFrame.unionByName, [need, *(p.withColumn("need", F.lit(0)) for p in parts)])
        return every.groupBy("id").agg(F.sum("score").alias("score"), F.max("need").alias("need")).where("need = 1").select("id", "score")

    def clauses(self, node: dict) -> int:
        if node["op"] == "leaf":
            return max(1, len(query_terms(node["text"], self.t.options.stop_words)) * len(node["fields"]))
        return sum(map(self.clauses, [*node["of"], *([node["required"]] if "required" in node else [])])) + len(node["of"])

    def work(self, tree: dict) -> None:
        """Refuse trees whose phrases or fuzzy words are more than a query may have, all clauses together."""
        positions = units = 0
        for node in leaves(tree):
            if node["mode"] == "phrase":
                positions += len(analyze(node["text"], self.t.options.stop_words)) * len(node["fields"])
            elif "fuzzy" in node["mode"]:
                # An edit distance of two costs four times as much.
                words = sum(fuzzy_eligible(t.term) for t in surface(node["text"])) if node["mode"] == "fuzzy" else 1
                units += words * len(node["fields"]) * (0, 1, 4)[node["distance"]]
        if positions > PHRASE_POSITIONS:
            raise invalid(f"phrases may have {PHRASE_POSITIONS} positions, counted once a field")
        if units > FUZZY_UNITS:
            raise invalid(f"fuzzy words may cost {FUZZY_UNITS} units")

    def matches(self, req: dict) -> DataFrame:
        """(id, score) of a checked request: query, candidates and filter."""
        from .filters import compile_filter

        self.work(req["tree"])

        if self.clauses(req["tree"]) > CLAUSES:
            raise SearchError("E_RESOURCE_LIMIT", f"a query may have {CLAUSES} clauses")
        out = self.tree(req["tree"])
        if req["ids"] is not None:
            out = out.where(F.col("id").isin(req["ids"]) if req["ids"] else F.lit(False))
        if req["filter"] is not None:
            out = out.join(self.t.docs.where(compile_filter(req["filter"], self.t.options.kinds)).select("id"), "id", "left_semi")
        return out.select("id", F.col("score").cast("float").alias("score"))
