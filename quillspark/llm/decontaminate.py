"""Benchmark decontamination by greedy string tiling of documents against benchmark items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import NO_ID, Rolling, arrow_map, chunks, stash

#: Words of the least match that a tile may be, and the part of an item's words that tiles must cover.
SEED, COVERAGE = 5, 0.5
#: Words of benchmark items that a pass over the documents holds; more items take more passes.
SLICE = 2_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def _free(used: np.ndarray, n: int) -> np.ndarray:
    """Where *n* unmarked places in a row begin."""
    total = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(total[n:] == total[:-n])


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of each tile: the longest matches of unmarked ids first.

    Running Karp-Rabin: windows of the present length are looked up by their rolling value and compared id by
    id; the longest length that still matches is found by halving, as a match has shorter ones within it, and all its matches
    are marked before shorter ones are looked for, until none of *least* is left. Among equal lengths the earlier in item,
    then in doc, wins. An item's tiles have few different lengths (under the root of twice its own), and a length
    costs a few readings of both, so a text that repeats one word costs no more than another.
    """
    used_d, used_i = np.zeros(len(doc), np.int64), np.zeros(len(item), np.int64)
    out: list[tuple[int, int, int]] = []
    roll_d, roll_i = Rolling(doc), Rolling(item)

    def met(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Unmarked places in item and doc whose windows have a value that both have."""
        if min(len(doc), len(item)) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        d, i = _free(used_d, n), _free(used_i, n)
        hd, hi = roll_d(n)[d], roll_i(n)[i]
        return i[np.isin(hi, hd)], d[np.isin(hd, hi)]

    most = min(len(doc), len(item))
    while True:
        lo, hi = least - 1, most  # a match of lo is known, none of more than hi
        while lo < hi:
            n = (lo + hi + 1) // 2
            if len(met(n)[0]):
                lo = n
            else:
                hi = n - 1
        if lo < least:
            return out
        n = most = lo
        places, found = met(n)
        starts: dict[int, list[int]] = {}
        for d, h in zip(found.tolist(), roll_d(n)[found].tolist(), strict=True):
            starts.setdefault(h, []).append(d)
        next_of = dict.fromkeys(starts, 0)
        marked = False
        for i, h in zip(places.tolist(), roll_i(n)[places].tolist(), strict=True):
            if used_i[i : i + n].any():
                continue
            at = starts[h]
            k = next_of[h]
            # What is marked stays marked, so the places before k are never free again.
            while k < len(at) and used_d[at[k] : at[k] + n].any():
                k += 1
            next_of[h] = k
            if k < len(at) and (doc[at[k] : at[k] + n] == item[i : i + n]).all():
                used_d[at[k] : at[k] + n] = 1
                used_i[i : i + n] = 1
                out.append((at[k], i, n))
                marked = True
        if not marked:  # values met that ids don't; shorter ones are still to be looked for
            most = n - 1


class _Slice:
    """Some benchmark items: their word ids, and a sorted table of seeds with the items that have them."""

    def __init__(self, items: list[tuple[int, list[bytes]]], seed: int):
        self.ids: dict[bytes, int] = {}
        self.seed = seed
        self.items = [(k, np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in ws], np.int64)) for k, ws in items]
        rows = [(Rolling(ids)(seed), n) for n, (_, ids) in enumerate(self.items) if len(ids) >= seed]
        seeds = np.concatenate([r for r, _ in rows]) if rows else np.zeros(0, np.uint64)
        owner = np.concatenate([np.full(len(r), n) for r, n in rows]) if rows else np.zeros(0, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], owner[order]
        self.short = [n for n, (_, ids) in enumerate(self.items) if 0 < len(ids) < seed]

    def match(self, text: str) -> list[tuple[int, float, int]]:
        """(item id, coverage, tiles) of each item that shares a seed with the text."""
        ids = np.fromiter((self.ids.get(w, 0) for w in words(text)), np.int64)
        roll = Rolling(ids)
        rolled = roll(self.seed)
        known = np.convolve(ids == 0, np.ones(self.seed, np.int64), "valid") == 0 if len(ids) >= self.seed else np.zeros(0, bool)
        hits = rolled[known]
        near: set[int] = set()
        if len(hits) and len(self.seeds):
            a, b = np.searchsorted(self.seeds, hits, "left"), np.searchsorted(self.seeds, hits, "right")
            for x, y in set(zip(a[a < b].tolist(), b[a < b].tolist(), strict=True)):
                near.update(self.owner[x:y].tolist())
        # An item shorter than a seed is matched whole.
        near.update(n for n in self.short if len(ids) >= len(self.items[n][1]) and (roll(len(self.items[n][1])) == Rolling(self.items[n][1])(len(self.items[n][1]))[0]).any())
        out = []
        for n in sorted(near):
            item, ws = self.items[n]
            got = tiles(ids, ws, min(self.seed, len(ws)))
            if got:
                out.append((item, sum(k for _, _, k in got) / len(ws), len(got)))
        return out


_LEAKS = "array<struct<item_id:bigint,coverage:double,tiles:int>>"


def _pass(part: _Slice, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with _leaks, the items of the slice that they hold."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())]))
    for b in chunks(batches):
        got = [[{"item_id": i, "coverage": c, "tiles": n} for i, c, n in part.match(t) if c >= least] if t else [] for t in b.column(b.schema.get_field_index("text")).to_pylist()]
        yield b.append_column("_leaks", pa.array(got, kind))


def _slices(benchmark: DataFrame, seed: int) -> Iterator[_Slice]:
    """The items in slices of a bounded number of words, one after another to the driver."""
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        ws = words(r[1])
        if rows and size + len(ws) > SLICE:
            yield _Slice(rows, seed)
            rows, size = [], 0
        rows.append((r[0], ws))
        size += len(ws)
    yield _Slice(rows, seed)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """*docs* with one more column, _leaks: the items whose words its tiles cover to *coverage* or more.

    A benchmark of one slice is matched in the plan that is returned, without a shuffle. With more of them each is a pass that
    ends before the next is broadcast; the passes write what they find, and that joins the documents.
    """
    slices = _slices(benchmark, seed)
    part, after = next(slices), next(slices, None)
    sc = docs.sparkSession.sparkContext
    fields = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    if after is None:
        shared = sc.broadcast(part)
        return arrow_map(docs, lambda it: _pass(shared.value, coverage, it), f"{fields(docs)}, _leaks {_LEAKS}")
    key = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.select(key[0].alias("_id"), key[1].alias("_th"), F.col("text"))
    found = None
    while part is not None:
        shared = sc.broadcast(part)
        got = arrow_map(rows, lambda it, shared=shared: _pass(shared.value, coverage, it), f"{fields(rows)}, _leaks {_LEAKS}")
        # Rows that repeat id and text find the same.
        got = stash(got.where(F.size("_leaks") > 0).select("_id", "_th", "_leaks").dropDuplicates(["_id", "_th"]), "leaks")
        shared.destroy()
        found = got if found is None else found.unionByName(got)
        part, after = after, next(slices, None)
    every = found.groupBy("_id", "_th").agg(F.flatten(F.collect_list("_leaks")).alias("_leaks"))
    named = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), key[0].alias("_id"), key[1].alias("_th"))
    return named.join(every, ["_id", "_th"], "left").select("_row.*", F.coalesce("_leaks", F.array().cast(_LEAKS)).alias("_leaks"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """Per row of *docs*: doc_id, contaminated, n_items, and the best item_id, its coverage and its tiles.

    Words are compared in lower case. A document meets only the items that share *seed* words in a row with
    it, wherever they stand, so that passages in another order are still caught. Items come to the
    documents in slices of at most SLICE words (an item at least), one after the other, so what is held and broadcast has
    a bound however large the benchmark grows. Very long texts cost their length, whatever they repeat. Null and empty texts and items match nothing; repeated items
    count each; the best item is the one of most coverage, then least item_id. Null ids give rows of their own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    best = F.get(F.array_sort(F.transform("_leaks", lambda x: F.struct((-x["coverage"]).alias("less"), x["item_id"].alias("item_id"), x["tiles"].alias("tiles")))), F.lit(0))
    out = leaks(rows, benchmark, coverage, seed).withColumn("_best", best)
    return out.select("doc_id", (F.size("_leaks") > 0).alias("contaminated"), F.size("_leaks").cast("long").alias("n_items"), F.col("_best.item_id").alias("item_id"), (-F.col("_best.less")).alias("coverage"), F.col("_best.tiles").cast("long").alias("n_tiles"))
