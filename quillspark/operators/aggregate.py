"""Facets over a match set: terms, stats, histogram, range and count, nested under buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SearchError, invalid

#: How deep aggregations nest, buckets of an answer, bytes of a name.
DEPTH, BUCKETS, NAME_BYTES = 32, 1024, 128


def check(requests: list[dict], kinds: dict[str, str], depth: int = 1) -> None:
    if depth > DEPTH:
        raise invalid(f"aggregations may be nested {DEPTH} deep")
    names = [r["name"] for r in requests]
    if len(set(names)) < len(names) or any(not 1 <= len(n.encode()) <= NAME_BYTES for n in names):
        raise invalid("aggregation names must be distinct and of 1 to 128 bytes")
    for r in requests:
        want = "string" if r["type"] == "terms" else "number"
        if kinds.get(r["field"]) != want:
            raise invalid(f"{r['type']} needs a {want} field, not {r['field']!r}")
        if r["type"] == "stats" and r.get("aggregations"):
            raise invalid("stats has no buckets")
        if r["type"] == "terms" and not 1 <= r["size"] <= BUCKETS:
            raise invalid("a terms size is 1 to 1,024")
        if r["type"] == "histogram" and not (math.isfinite(r["interval"]) and r["interval"] > 0):
            raise invalid("an interval is above 0")
        if r["type"] == "range":
            bounds(r["ranges"])
        check(r.get("aggregations") or [], kinds, depth + 1)


def bounds(ranges: list[dict]) -> list[tuple[float | None, float | None]]:
    """The asked ranges, which must join, with the outer buckets that they leave open."""
    out = [(r.get("from"), r.get("to")) for r in ranges]
    inner_open = any(a is None for a, _ in out[1:]) or any(b is None for _, b in out[:-1])
    if not out or inner_open or any(a is not None and b is not None and a >= b for a, b in out) or any(x[1] != y[0] for x, y in zip(out, out[1:], strict=False)):
        raise invalid("ranges must be ascending and join each other")
    if out[0][0] is not None:
        out.insert(0, (None, out[0][0]))
    if out[-1][1] is not None:
        out.append((out[-1][1], None))
    return out


def range_key(a: float | None, b: float | None) -> str:
    show = lambda v: "*" if v is None else f"{v:g}"
    return f"{show(a)}-{show(b)}"


def buckets_of(r: dict) -> Column:
    """The distinct bucket keys of a row: a document counts once for each."""
    col = F.coalesce(F.col(f"f_{r['field']}"), F.array())
    if r["type"] == "terms":
        return F.array_distinct(col)
    if r["type"] == "histogram":
        step = float(r["interval"])
        return F.array_distinct(F.transform(col, lambda v: F.floor(v / step).cast("double") * step))
    cases = bounds(r["ranges"])

    def place(v: Column) -> Column:
        at = F.lit(len(cases) - 1)
        for k in range(len(cases) - 2, -1, -1):
            at = F.when(v < cases[k][1], k).otherwise(at)
        return at

    return F.array_distinct(F.transform(col, place))


def bucket_frame(matches: DataFrame, r: dict) -> DataFrame:
    """(key, count) of all buckets of one request, over rows with the metadata columns."""
    return matches.select(F.explode(buckets_of(r)).alias("key")).groupBy("key").agg(F.count("*").alias("count"))


def _stats() -> list[Column]:
    return [F.count("v").alias("count"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("avg")]


def stats_frame(matches: DataFrame, field: str) -> DataFrame:
    return matches.select(F.explode(f"f_{field}").alias("v")).agg(*_stats())


def aggregate(matches: DataFrame, requests: list[dict]) -> list[dict]:
    """Results in request order. Exact: a terms list has no error, and the rest is counted in full.

    One plan for each request of the tree, whatever the number of buckets: rows carry the number of the bucket that they
    are in, and group by it. Only buckets that are answered come to the driver, at most BUCKETS of them in all.
    """
    return _level(matches.withColumn("_in", F.lit(0)), requests, 1, [BUCKETS])[0]


def _answered(counts: DataFrame, r: dict, left: int) -> tuple[list, dict[int, int]]:
    """(rows _in, _key, count in answer order, all counts by _in): for terms the largest ones of each bucket."""
    if r["type"] != "terms":
        return counts.orderBy("_in", "_key").limit(left + 1).collect(), {}
    every = {x[0]: x[1] for x in counts.groupBy("_in").agg(F.sum("count")).collect()}  # a row for each answered bucket
    # The limit by rank is applied within tasks first, so that no task sees all words of a bucket.
    place = F.row_number().over(Window.partitionBy("_in").orderBy(F.desc("count"), "_key"))
    top = counts.withColumn("_place", place).where(F.col("_place") <= r["size"])
    return top.orderBy("_in", "_place").limit(left + 1).collect(), every


def _level(rows: DataFrame, requests: list[dict], n: int, left: list[int]) -> list[list[dict]]:
    """The results of *requests* in each of the *n* buckets that _in numbers."""
    out: list[list[dict]] = [[] for _ in range(n)]
    for r in requests:
        if r["type"] == "stats":
            got = {x["_in"]: x.asDict() for x in rows.select("_in", F.explode(f"f_{r['field']}").alias("v")).groupBy("_in").agg(*_stats()).collect()}
            for k in range(n):
                found = got.get(k, {"count": 0, "sum": 0.0, "min": None, "max": None, "avg": None})
                if any(isinstance(v, float) and not math.isfinite(v) for v in found.values()):
                    raise SearchError("E_RESOURCE_LIMIT", "a sum is beyond the numbers there are")
                out[k].append({"name": r["name"], "type": "stats", **{c: found[c] for c in ("count", "sum", "min", "max", "avg")}})
            continue
        keyed = rows.withColumn("_key", F.explode(buckets_of(r)))
        got, every = _answered(keyed.groupBy("_in", "_key").agg(F.count("*").alias("count")), r, left[0])
        if r["type"] == "range":
            found = {(x["_in"], x["_key"]): x["count"] for x in got}
            ends = [{e: v for e, v in (("from", a), ("to", b)) if v is not None} for a, b in bounds(r["ranges"])]
            listed = [(k, j, {"key": range_key(a, b), **ends[j], "count": found.get((k, j), 0)}) for k in range(n) for j, (a, b) in enumerate(bounds(r["ranges"]))]
        else:
            listed = [(x["_in"], x["_key"], {"key": x["_key"], "count": x["count"]}) for x in got]
        left[0] -= len(listed)
        if left[0] < 0:
            raise invalid(f"more than {BUCKETS} buckets")
        results = [{"name": r["name"], "type": r["type"], "buckets": []} for _ in range(n)]
        for k, _, bucket in listed:
            results[k]["buckets"].append(bucket)
        if r["type"] == "terms":
            for k, res in enumerate(results):
                res |= {"sumOtherDocCount": every.get(k, 0) - sum(b["count"] for b in res["buckets"]), "docCountErrorUpperBound": 0}
        if r.get("aggregations"):
            kind = keyed.schema["_key"].dataType.simpleString()
            numbers = rows.sparkSession.createDataFrame([(k, key, j) for j, (k, key, _) in enumerate(listed)], f"_in int, _key {kind}, _inner int")
            # BUCKETS rows at most.
            inside = keyed.join(F.broadcast(numbers), ["_in", "_key"]).drop("_in", "_key").withColumnRenamed("_inner", "_in")
            for (_, _, bucket), inner in zip(listed, _level(inside, r["aggregations"], len(listed), left), strict=True):
                bucket["aggregations"] = inner
        for k in range(n):
            out[k].append(results[k])
    return out


def flat(results: list[dict], path: tuple[str, ...] = ()) -> list[tuple]:
    """(path, name, key, count, sum, min, max, other) of all buckets and statistics, outer ones first."""
    out: list[tuple] = []
    for r in results:
        if r["type"] == "stats":
            out.append((list(path), r["name"], None, r["count"], r["sum"], r["min"], r["max"], None))
            continue
        for b in r["buckets"]:
            key = b["key"] if isinstance(b["key"], str) else f"{b['key']:g}"
            out.append((list(path), r["name"], key, b["count"], None, None, None, r.get("sumOtherDocCount")))
            out += flat(b.get("aggregations") or [], (*path, key))
    return out


FLAT = "path array<string>, name string, key string, count long, sum double, min double, max double, other long"
