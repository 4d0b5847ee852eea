"""Suffix-array dedup: a logarithmic family of sparse suffix arrays, merge-scanned for long matches.

A full suffix array of the corpus has an entry for each byte. Here suffixes are sampled so that no match of
WINDOW bytes is missed: the least hash of all K-byte strings within a window of WINDOW bytes depends on the window
alone, so equal windows have the same least hash. Windows in a row with one least hash are a run; the
runs are the suffixes of the arrays, in the order of that hash and of what follows. About one byte in 80 begins a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ._base import LANE, Entries, Packs, arrow_map, chunks, drop, first_lanes, groups, keyed, meet, mix64, stash

#: Bytes of a match, bytes of the sampled strings, and batches that a whole table is dealt to.
WINDOW, K, BATCHES = 200, 32, 4
#: Bytes that the rests of a key have in one row at about most; keys with more are dealt to several rows.
TOGETHER = 1 << 15
#: Runs of a text that are sent at once.
ROWS = 100_000

_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.random.default_rng(9_973).integers(0, 2**63, 256, np.uint64)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place, by doubling; the highest value where they don't fit."""
    h, n, m = _MIX[data], 1, int(_M)
    while n < K:
        h = h[: len(h) - n] * np.uint64(m) + h[n:]
        m = m * m % 2**64
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def runs(data: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least hash, first window, last window) of each run: windows in a row whose least hash, the leftmost of equal ones, is at one place.

    Where that place is within a window depends on its bytes alone, so equal windows are at the same distance of theirs, and no two
    windows of a run are equal. A run has as many windows as a window has K-byte strings at most, whatever the text repeats.
    """
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none.astype(np.uint64), none, none
    h = _grams(np.frombuffer(data, np.uint8))
    width = window - K + 1
    at, n = np.arange(len(h), dtype=np.int32), 1

    def lower(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(h[x] <= h[y], x, y)

    while 2 * n <= width:
        at = lower(at[: len(at) - n], at[n:])
        n *= 2
    if width > n:
        at = lower(at[: len(at) - (width - n)], at[width - n :])
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate([[0], cut])
    return h[at[first]], first, np.concatenate([cut, [len(at)]]) - 1


def _digest(data: bytes) -> int:
    """64 bits, always held together with a key of 64 other bits."""
    return xxh3_64_intdigest(data) - 2**63


def _suffixes(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of all texts: their document, least hash, first and last window, and a digest of their bytes."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    for b in chunks(batches):
        for i, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data = text.encode()
            key, first, last = runs(data, window)
            for k in range(0, len(key), ROWS):
                a, z = first[k : k + ROWS], last[k : k + ROWS]
                rest = [_digest(data[x : y + window]) for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                cols = ([i] * len(a), [th] * len(a), (key[k : k + ROWS] ^ np.uint64(1 << 63)).view(np.int64), a.astype(np.int32), z.astype(np.int32), rest)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["_id", "_th", "key", "a", "z", "rest"])


class SuffixFamily:
    """The index: levels of sorted runs, each twice the batches of the one before, in the shared folder.

    A batch's table holds (key, rest): the run's least hash and a digest of its bytes, and how often it
    occurs. It is merge-scanned against each level: entries that meet in key are neighbours in the
    joint order and may hold long matches. Then levels of equal size merge, so b batches leave at most log2(b) + 1.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.old: list[DataFrame] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Index *batch*; returns key of what it shares within itself or with the levels, for as long as close() isn't called."""
        new = stash(batch.groupBy("key", "rest").agg(F.count("*").alias("n")).sortWithinPartitions("key", "rest"), "suffix-level")
        own = new.groupBy("key").agg(F.sum("n").alias("n"))
        met = own.where("n > 1").select("key")
        for _, level in self.levels:
            met = met.unionByName(own.select("key").join(level.select("key"), "key", "left_semi"))
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, old = self.levels.pop()
            both = new.unionByName(old).groupBy("key", "rest").agg(F.sum("n").alias("n"))
            merged = stash(both.sortWithinPartitions("key", "rest"), "suffix-level")
            self.old += [old, new]
            new, rank = merged, rank + 1
        self.levels.append((rank, new))
        return met

    def close(self) -> None:
        drop(*self.old, *(level for _, level in self.levels))


def _pieces(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contested entries."""
    for b in chunks(batches):
        at, keys, rests, whole, data = [], [], [], [], []
        for text, picks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = text.encode()
            for p in picks:
                at.append(p["deals"])
                keys.append(p["key"])
                rests.append(p["rest"])
                whole.append(p["whole"])
                data.append(text[p["a"] : p["z"] + window])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.int64()), pa.array(rests, pa.int64()), pa.array(whole, pa.bool_()), pa.array(data, pa.binary())], names=["deals", "key", "rest", "whole", "data"])


def islands(places: list[int]) -> list[dict]:
    """Runs of places in a row, from ascending places."""
    out: list[dict] = []
    for k in places:
        if out and out[-1]["hi"] == k - 1:
            out[-1]["hi"] = k
        else:
            out.append({"lo": k, "hi": k})
    return out


_ISLANDS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


_HELD = f"key long, rest long, islands array<struct<lo:int,hi:int>>, {Packs.SCHEMA}"


def _together(window: int, lanes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of a key's entries in one deal held against each other, byte by byte: islands of those that match.

    Where there are other deals, a digest of each different window goes packed to a lane, to be held against theirs.
    """
    kinds = (pa.int64(), pa.int64(), _ISLANDS)
    names = ["key", "rest", "islands", "lane", "m", "data"]
    packs = Packs(lanes)

    def sent(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.nulls(b.num_rows, t) for t in kinds), *b.columns], names=names)

    for b in batches:
        for key, deals, entries in zip(*(c.to_pylist() for c in b.columns), strict=True):
            cols: list[list] = [[], [], []]
            seen: dict[bytes, tuple | None] = {}
            cut = [[e["data"][k : k + window] for k in range(len(e["data"]) - window + 1)] for e in entries]
            for e, windows in zip(entries, cut, strict=True):
                for k, w in enumerate(windows):
                    seen[w] = None if w in seen or e["whole"] else (e["rest"], k)
            for e, windows in zip(entries, cut, strict=True):
                if not e["whole"] and (hit := [k for k, w in enumerate(windows) if seen[w] is None]):
                    for c, x in zip(cols, (key, e["rest"], islands(hit)), strict=True):
                        c.append(x)
            if cols[0]:
                n = len(cols[0])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            if deals > 1:
                own = entries[0]["rest"]
                places = [p or (own, _MATCHED) for p in seen.values()]
                digests = mix64(np.array([xxh3_64_intdigest(w) for w in seen], np.uint64) ^ mix64(np.array([key], np.int64).view(np.uint64)))
                yield from map(sent, packs.add(digests, np.array([r for r, _ in places], np.int64), np.array([k for _, k in places], np.uint32)))
    yield sent(packs.send())


#: Stands for the place of a window that has matched already.
_MATCHED = 2**32 - 1


def _across(entries: Entries, crowd: bool) -> pa.RecordBatch:
    """rest and ks: windows of entries that are found in another deal too."""
    key, rest, k = entries
    starts, of = groups(key)
    many = np.diff(starts, append=len(key))[of] > 1
    some = np.flatnonzero((many | crowd) & (k != np.uint32(_MATCHED)))
    some = some[np.argsort(rest[some], kind="stable")]
    firsts, _ = groups(rest[some])
    ks = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(some)).astype(np.int32)), pa.array(k[some].astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(rest[some][firsts]), ks], names=["rest", "ks"])


def _cut(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        at = {n: b.schema.get_field_index(n) for n in ("text", "marks")}
        size, removed, spans, kept = [], [], [], []
        for text, marks in zip(b.column(at["text"]).to_pylist(), b.column(at["marks"]).to_pylist(), strict=True):
            data = text.encode()
            out, done, gone, n = [], 0, 0, 0
            end = -1
            for a, z in sorted((m["lo"], m["hi"] + window) for m in marks or ()):
                if a > end:
                    n += 1
                    out.append(data[done:a])
                    end = z
                elif z > end:
                    end = z
                done = end
            out.append(data[done:])
            left = b"".join(out)
            gone = len(data) - len(left)
            size.append(len(data))
            removed.append(gone)
            spans.append(n)
            kept.append(left)
        new = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k not in at.values()), *new], names=[*(x for x in b.schema.names if x not in at), "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """Per row of *docs*: doc_id, n_bytes, n_removed, n_spans and kept, the bytes left without repeated *window*-byte strings.

    Every occurrence of a string that starts at two places or more goes, in whatever documents; matches never
    cross documents. The table is dealt to *batches* by a hash of its keys, and each batch is added to a SuffixFamily.
    Entries equal in (key, rest) are marked whole. Where a key has several rests the windows
    of one occurrence of each rest are compared, and what matches holds for all its occurrences. The rests of a key are
    dealt to rows of about TOGETHER bytes; windows are compared within a row first, and by digest across rows.
    Null texts count as empty; texts under *window* bytes are kept; rows that repeat id and text are two places. Very long texts, also such
    as repeat one byte or a short period, cost time and rows by their length alone.
    """
    rows = keyed(docs)
    arrays = arrow_map(rows.select("_id", "_th", "text"), lambda it: _suffixes(window, it), "_id long, _th long, key long, a int, z int, rest long")
    arrays = stash(arrays.withColumn("batch", F.pmod(F.xxhash64("_id", "_th"), F.lit(batches)).cast("int")), "suffixes")
    family, met = SuffixFamily(), None
    for k in range(batches):
        got = family.add(arrays.where(F.col("batch") == k))
        met = got if met is None else met.unionByName(got)
    met = stash(met.distinct(), "suffix-met")
    family.close()
    # From here on only runs whose key is found twice are looked at.
    repeated = stash(arrays.drop("batch").join(met, "key", "left_semi"), "suffix-repeated")
    drop(arrays)
    entries = stash(repeated.groupBy("key", "rest").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_th", "a", "z")).alias("at")), "suffix-entries")
    several = entries.groupBy("key").agg(F.count("*").alias("rests"), F.sum(F.col("at.z") - F.col("at.a") + window).alias("bytes")).where("rests > 1")
    deals = F.ceil(F.col("bytes") / TOGETHER).cast("int").alias("deals")
    contested = entries.join(several, "key").select("key", "rest", "at", (F.col("n") > 1).alias("whole"), deals)
    picks = contested.select("at.*", "key", "rest", "whole", "deals").groupBy("_id", "_th").agg(F.collect_list(F.struct("a", "z", "key", "rest", "whole", "deals")).alias("picks"))
    texts = rows.select("_id", "_th", "text").join(picks, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select("text", "picks")
    pieces = arrow_map(texts, lambda it: _pieces(window, it), "deals int, key long, rest long, whole boolean, data binary")
    dealt = pieces.groupBy("key", "deals", F.pmod(F.xxhash64("rest"), F.col("deals")).alias("deal")).agg(F.collect_list(F.struct("rest", "whole", "data")).alias("entries"))
    kind = "array<struct<lo:int,hi:int>>"
    crowded = several.where(F.col("bytes") > TOGETHER).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    lanes = int(crowded) // LANE + 1
    held = stash(arrow_map(dealt.select("key", "deals", "entries"), lambda it: _together(window, first_lanes(lanes), it), _HELD), "suffix-held")
    across = meet(held.where("lane is not null").select("lane", "m", "data"), lanes, _across, "rest long, ks array<int>")
    hit = across.groupBy("rest").agg(F.array_sort(F.flatten(F.collect_list("ks"))).alias("ks")).join(contested.where("deals > 1").select("key", "rest"), "rest")
    # Windows of an entry that match, as islands of places in a row.
    beside = lambda k, i, step: F.coalesce(F.get("ks", i + step) == k + step, F.lit(False))
    starts = F.filter("ks", lambda k, i: ~beside(k, i, -1))
    ends = F.filter("ks", lambda k, i: ~beside(k, i, 1))
    parts = held.where("islands is not null").select("key", "rest", "islands").unionByName(hit.select("key", "rest", F.arrays_zip(starts.alias("lo"), ends.alias("hi")).alias("islands")))
    whole = entries.where("n > 1").select("key", "rest", F.lit(None).cast(kind).alias("islands"))
    flags = whole.unionByName(parts)
    marks = repeated.join(flags, ["key", "rest"]).select("_id", "_th", F.explode(F.when(F.col("islands").isNull(), F.array(F.struct(F.col("a").alias("lo"), F.col("z").alias("hi")))).otherwise(F.transform("islands", lambda x: F.struct((F.col("a") + x["lo"]).alias("lo"), (F.col("a") + x["hi"]).alias("hi"))))).alias("m"))
    marks = stash(marks.groupBy("_id", "_th").agg(F.collect_set("m").alias("marks")), "suffix-marks")
    joined = rows.join(marks, ["_id", "_th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "marks")
    return arrow_map(joined, lambda it: _cut(window, it), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
