"""Line dedup: exact copies and near lines, whose edits are bounded by their length.

Lines of eight words or more are near within one word edit for every 20 words, shorter ones of eight characters or
more within one character edit for every 20 characters, and at least one. One edit is found by a deletion-neighbourhood
join, more by runs that such lines must share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ._base import LANE, NO_ID, Entries, Packs, Rolling, arrow_map, chunks, drop, first_lanes, groups, keyed, meet, mix64, stash, words_of

#: Words that the longer of two lines must have for them to be compared by words; shorter ones are compared by
#: characters if the shorter one has LEAST_CHARS. One edit is allowed for each EACH words or characters of the longer, and at least one.
LEAST_WORDS, LEAST_CHARS, EACH = 8, 8, 20
#: Longer lines may differ by k >= 2 edits. Then they share a run of RUN tokens, as k edits leave n - k of them in
#: k + 1 runs, and n >= EACH * k. Of each window of RUN - GRAM + 1 grams the one with the least hash is a key.
RUN, GRAMS = 13, {"w": 6, "c": 12}
#: Lines of a key that are all held against each other as pairs of rows. Those of larger groups meet the earliest; what that leaves open is held
#: against all lines of the group, BLOCK lines or so, and BLOCK_BYTES, by as many, by bags of tokens of BINS counts first, then by their texts.
SMALL, BLOCK, BLOCK_BYTES, BINS = 16, 2048, 1 << 22, 32
#: Bytes of contested lines whose variants are made at once.
PICKED = 1 << 19
#: A line is hot if more than one occurrence in so many is of it, so there are fewer hot lines than that.
HOT = 1000
#: Which variants a line needs: itself (for lines of one word more), without a word at its place (for lines of as
#: many words), without a word at any place (for lines of one word less). FAR: its text alone, for more edits.
WHOLE, SAME, LESS, FAR = 1, 2, 4, 8
_SALT = {"w": np.uint64(0x51ED270B91A3C7F5), "c": np.uint64(0x2545F4914F6CDD1D)}


class View:
    """Some lines as rows of tokens, words ('w') or characters ('c'), in one sequence of hashes; all keys come from its running sums."""

    def __init__(self, kind: str, ids: np.ndarray, roll: Rolling, start: np.ndarray, sizes: np.ndarray):
        self.ids = ids
        self.kind, self.roll, self.start, self.n, self.end = kind, roll, start, sizes, start + sizes

    def _key(self, value: np.ndarray, size: np.ndarray, side: int) -> np.ndarray:
        return mix64(value ^ mix64(_SALT[self.kind] + (size.astype(np.uint64) << np.uint64(2)) + np.uint64(side)))

    def half_keys(self) -> np.ndarray:
        """Four keys of each line, of which two lines within one edit share one.

        With m tokens in the shorter line, the equal tokens before and after the edit are m - 1 at least, so the
        first (m - 1) // 2 are equal or the last (m - 1) - (m - 1) // 2 are. A line takes both m that it may meet:
        its own number of tokens, the first two keys, and one less, the last two.
        """
        out = []
        for m in (self.n, self.n - 1):
            a = (m - 1) // 2
            out += [self._key(self.roll.raw(self.start, self.start + a), m, 1), self._key(self.roll.raw(self.end - (m - 1 - a), self.end), m, 2)]
        return np.stack(out, 1)

    def variants(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, hash, place) of the variants that *kinds* names: the line itself at place -1, and without each token, at that token's place and at -2.

        Lines equal at a place differ by a replaced token there; a line at -1 equal to another at -2 lacks one of its tokens.
        """
        whole = np.flatnonzero(kinds & WHOLE)
        cut = np.flatnonzero(kinds & (SAME | LESS))
        line = np.repeat(cut, self.n[cut])
        place = np.arange(len(line)) - np.repeat(np.cumsum(self.n[cut]) - self.n[cut], self.n[cut])
        short = self._key(self.roll.without_one(self.start[line], self.end[line], self.start[line] + place), self.n[line] - 1, 0)
        same, less = (kinds[line] & SAME) > 0, (kinds[line] & LESS) > 0
        full = self._key(self.roll.raw(self.start[whole], self.end[whole]), self.n[whole], 0)
        lines = np.concatenate([whole, line[same], line[less]])
        return lines, np.concatenate([full, short[same], short[less]]), np.concatenate([np.full(len(whole), -1), place[same], np.full(int(less.sum()), -2)]).astype(np.int32)

    def run_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) in the order of the text: lines within two or more edits share a key; none for lines too short for that."""
        line, key = self.windows()
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])]) if len(key) else np.zeros(0, bool)
        return line[new], key[new]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) of each run of RUN tokens of those lines."""
        q = GRAMS[self.kind]
        w = RUN - q + 1
        h = mix64(self.roll(q) ^ _SALT[self.kind])
        if len(h) < w:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        low, n = h, 1
        while 2 * n <= w:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        if w > n:
            low = np.minimum(low[: len(low) - (w - n)], low[w - n :])
        long = np.flatnonzero(self.n >= 2 * EACH - 2)
        count = self.n[long] - RUN + 1
        line = np.repeat(long, count)
        at = np.repeat(self.start[long] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return line, low[at]

    def bags(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, counts of its tokens in BINS bins, 255 at most) of those lines: an edit changes two counts by one at most."""
        long = np.flatnonzero(self.n >= 2 * EACH - 2)
        out = np.zeros((len(long), BINS), np.uint8)
        for k, (a, b) in enumerate(zip(self.start[long].tolist(), self.end[long].tolist(), strict=True)):
            out[k] = np.minimum(np.bincount((mix64(self.ids[a:b]) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255)
        return long, out


class Lines:
    """The lines with words of some texts: the text of each and its number there, and its words as a range of a sequence."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        begin, end, ids = words_of(self.data)
        breaks = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 10)
        # Lines are fewer than words: where each line's words begin, and how many there are.
        first = np.concatenate([[0], np.searchsorted(begin, breaks)])
        number = np.flatnonzero(np.diff(first, append=len(begin)))
        self.start = first[number]
        self.n = np.diff(self.start, append=len(begin))
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.text = np.searchsorted(offsets, begin[self.start], "right") - 1
        self.no = number - np.searchsorted(breaks, offsets)[self.text]
        self.begin, self.end = begin[self.start], end[self.start + self.n - 1] if len(begin) else begin
        self.ids, self.roll = ids, Rolling(ids)

    def mark(self, roll: Rolling | None = None) -> np.ndarray:
        """The 64 bits that name a line among near lines."""
        return mix64((roll or self.roll).raw(self.start, self.start + self.n) ^ mix64(self.n.astype(np.uint64))).view(np.int64)

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each line's words."""
        return self.mark(), self.mark(Rolling(mix64(self.ids ^ _SALT["c"])))

    def words(self, k: int) -> bytes:
        """Line *k* with single spaces."""
        return b" ".join(self.data[self.begin[k] : self.end[k]].split())

    def views(self) -> list[tuple[View, np.ndarray]]:
        """What edits of lines are of, words, characters or both, with the numbers of the lines; others are compared exactly."""
        out = []
        wordy = np.flatnonzero(self.n >= LEAST_WORDS - 1)
        if len(wordy):
            out.append((View("w", self.ids, self.roll, self.start[wordy], self.n[wordy]), wordy))
        short = [(k, self.words(k).decode()) for k in np.flatnonzero((self.n < LEAST_WORDS) & (self.end - self.begin >= LEAST_CHARS)).tolist()]
        short = [(k, x) for k, x in short if len(x) >= LEAST_CHARS]
        if short:
            chars = np.frombuffer("".join(x for _, x in short).encode("utf-32-le"), np.uint32).astype(np.uint64)
            n = np.array([len(x) for _, x in short], np.int64)
            out.append((View("c", chars, Rolling(mix64(chars ^ _SALT["c"])), np.cumsum(n) - n, n), np.array([k for k, _ in short])))
        return out


def bound(n: int) -> int:
    """Edits that are allowed if the longer line has *n* tokens."""
    return max(1, n // EACH)


def within(a: list, b: list, k: int) -> bool:
    """Whether *k* insertions, deletions and replacements at most make *a* into *b*: furthest points by diagonal."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    far: dict[int, int] = {}
    for e in range(k + 1):
        new = {}
        for d in range(-e, e + 1):
            i = 0 if e == 0 else max(far.get(d, -2) + 1, far.get(d - 1, -2) + 1, far.get(d + 1, -2))
            i = min(i, n, m + d)
            if i < 0 or i < d:
                continue
            while i < n and i - d < m and a[i] == b[i - d]:
                i += 1
            if i == n and i - d == m:
                return True
            new[d] = i
        far = new
    return False


def near(x: bytes, y: bytes) -> bool:
    """Whether two lines are within the edits that their length allows."""
    a, b = x.split(), y.split()
    if max(len(a), len(b)) >= LEAST_WORDS:
        return within(a, b, bound(max(len(a), len(b))))
    c, d = b" ".join(a).decode(), b" ".join(b).decode()
    return min(len(c), len(d)) >= LEAST_CHARS and within(c, d, bound(max(len(c), len(d))))


def within_one(a: list, b: list) -> bool:
    """Whether one insertion, deletion or replacement at most makes *a* into *b*."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and mark of each line with words."""
    for b in chunks(batches):
        lines = Lines(b.column(2).cast(pa.binary()).to_pylist())
        row = pa.array(lines.text)
        yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(lines.no.astype(np.int32)), *map(pa.array, lines.marks())], names=["_id", "_th", "no", "lid", "rest"])


#: Tags of keys in their lowest two bits; the number of a line's tokens is above them.
_OWN, _LOWER, _RUN = 0, 1, 2


def _keys(lanes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The half keys and run keys of all lines, with the lines' marks, to their lanes."""
    packs = Packs(lanes)
    for b in chunks(batches, most=1 << 20):
        lines = Lines(b.column(0).cast(pa.binary()).to_pylist())
        lid = lines.mark()
        for v, at in lines.views():
            halves = v.half_keys()
            n = v.n.astype(np.uint32) << np.uint32(2)
            for side in range(4):
                yield from packs.add(halves[:, side], lid[at], n | np.uint32(_OWN if side < 2 else _LOWER))
            line, key = v.run_keys()
            yield from packs.add(key, lid[at[line]], n[line] | np.uint32(_RUN))
    yield packs.send()


_MET = "k long, lid long, n int, kinds int"


def _met(entries: Entries, crowd: bool) -> pa.RecordBatch:
    """Lines that share a key with another: with a half of it, the variants that the other's number of tokens calls for; with a run, FAR."""
    key, lid, tag = entries
    starts, of = groups(key)
    which = tag & np.uint32(3)
    own, low, run = (np.add.reduceat(which == t, starts, dtype=np.int64)[of] + (2 if crowd else 0) for t in (_OWN, _LOWER, _RUN))
    kinds = np.select([which == _OWN, which == _LOWER], [(own > 1) * SAME + (low > 0) * WHOLE, (own > 0) * LESS], (run > 1) * FAR).astype(np.int32)
    some = np.flatnonzero(kinds)
    return pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(lid[some]), pa.array((tag[some] >> np.uint32(2)).astype(np.int32)), pa.array(kinds[some])], names=["k", "lid", "n", "kinds"])


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(texts, kinds, ranks) of the lines that are picked, about PICKED bytes of them at a time; the other lines are not even split into words."""
    for b in batches:
        no, kinds, rank = (c.to_numpy() for c in b.column(1).flatten().flatten())
        held: list[bytes] = []
        begin = size = at = 0
        for text, n in zip(b.column(0).cast(pa.binary()), b.column(1).value_lengths().to_pylist(), strict=True):
            lines = text.as_py().split(b"\n")
            for k in no[at : at + n].tolist():
                held.append(lines[k])
                size += len(lines[k])
            at += n
            if size > PICKED:
                yield held, kinds[begin:at], rank[begin:at]
                held, begin, size = [], at, 0
        if held:
            yield held, kinds[begin:at], rank[begin:at]


def _variants(lanes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the lines that are picked, and the variants that they need, to their lanes; lines go by their ranks."""
    packs = Packs(lanes)

    def sent(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.binary())], names=["lane", "m", "data", "lid", "line"])

    for texts, kinds, lid in _picked(batches):
        # Each of them has words, so it is one line.
        lines, n = Lines(texts), len(texts)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(lid), pa.array([lines.words(k) for k in range(n)], pa.binary())], names=["lane", "m", "data", "lid", "line"])
        for view, numbers in lines.views():
            line, key, token = view.variants(kinds[numbers])
            side = np.maximum(token, -1)
            key = mix64(key ^ mix64(side.astype(np.int64).view(np.uint64)))
            yield from map(sent, packs.add(key, lid[numbers[line]], (token == -2).astype(np.uint32) | (side < 0).astype(np.uint32) << np.uint32(1)))
    yield sent(packs.send())


_VARIANT = "k long, lid long, lacks boolean, ends boolean"


def _variants_met(entries: Entries, crowd: bool) -> pa.RecordBatch:
    """Lines that meet in a variant: at a place of a token, or one with all its tokens and one that lacks one."""
    key, lid, tag = entries
    starts, of = groups(key)
    lacks, ends = (tag & np.uint32(1)) > 0, (tag & np.uint32(2)) > 0
    full, less = (np.add.reduceat(t, starts, dtype=np.int64)[of] + (2 if crowd else 0) for t in (~lacks, lacks))
    some = np.flatnonzero(np.where(ends, (full > 0) & (less > 0), full > 1))
    return pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(lid[some]), pa.array(lacks[some]), pa.array(ends[some])], names=["k", "lid", "lacks", "ends"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = pa.array([near(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(ok)], names=["lid"])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = {}
    for b in chunks(batches):
        at = {n: b.schema.get_field_index(n) for n in ("text", "gone")}
        texts, n = [], []
        for text, gone in zip(b.column(at["text"]).to_pylist(), b.column(at["gone"]).to_pylist(), strict=True):
            lines = text.split("\n")
            n.append(sum(bool(x.strip(" \t\n\v\f\r")) for x in lines))
            if gone:
                out = set(gone)
                text = "\n".join(x for k, x in enumerate(lines) if k not in out)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k not in at.values()), pa.array(n, pa.int64()), pa.array(texts, pa.string())], names=[*(x for x in b.schema.names if x not in at), "n_lines", "text"])


def _one_edit(met: DataFrame) -> DataFrame:
    """Pairs (lid, o): lines that meet in a variant, each with the earliest there.

    Those that meet in a variant and place are all within one edit of each other, so each is held against the earliest there
    alone; no pairs of a group are made.
    """
    rows = stash(met, "line-met")
    lacks = F.col("lacks")
    # One column serves lines that lack a token; the other one whole lines at the end, and all lines at a token's place.
    best = rows.groupBy("k").agg(F.min(F.when(~lacks, F.col("lid"))).alias("full"), F.min(F.when(lacks, F.col("lid"))).alias("lacking"))
    other = F.when(F.col("ends") & ~lacks, F.col("lacking")).otherwise(F.col("full"))
    return rows.join(best, "k").select("lid", other.alias("o")).where("o < lid")


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows (k, lid, n), each once, with the number of rows of its key (c) and the earliest line of them (o, with m tokens): dealt and sorted once for
    all that is asked of groups, instead of an aggregate and a join for each question.

    Only keys of crowds have rows that repeat. These count more than once in c, which says which groups are large and which keys rarer.
    """
    by = Window.partitionBy("k").orderBy("lid")
    group = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.select("k", "lid", "n", F.count("*").over(group).alias("c"), F.first("lid").over(group).alias("o"), F.first("n").over(group).alias("m"), F.lag("lid").over(by).alias("before"))
    return out.where("before is null or before <> lid").drop("before")


def _more_edits(rows: DataFrame) -> DataFrame:
    """Pairs (lid, o) of lines that share a key of runs, of rows from _grouped(): each with the earliest of the key, and in small groups with all earlier ones."""
    fits = f"abs(n - m) <= greatest(n, m) div {EACH}"
    small = rows.where(f"c between 3 and {SMALL}").groupBy("k").agg(F.collect_list(F.struct("lid", "n")).alias("group"))
    every = small.select("group", F.explode("group").alias("a")).select("a", F.explode("group").alias("b")).select("a.lid", "a.n", F.col("b.lid").alias("o"), F.col("b.n").alias("m"))
    return rows.select("lid", "n", "o", "m").unionByName(every).where(f"o < lid and {fits}").select("lid", "o")


def touched(starts: np.ndarray) -> int:
    """The least edits that touch all runs of RUN tokens that begin at *starts*, in order."""
    n = at = 0
    while at < len(starts):
        at = int(np.searchsorted(starts, starts[at] + RUN))
        n += 1
    return n


def open_keys(windows: np.ndarray, large: dict[int, int]) -> list[int]:
    """The keys of *large* (with the lines of each) by which a line must meet all of their lines, the rarest ones; often none.

    *windows* are the keys of the line's runs in order. A line near it has all runs that no edit touches. So if the allowed edits can't touch
    all runs of some keys, lines near it have one of these keys; keys of small groups, where all lines meet, come first.
    """
    by = sorted(large, key=lambda k: (large[k], k))
    level = {k: i + 1 for i, k in enumerate(by)}
    at = np.array([level.get(k, 0) for k in windows.tolist()])
    # The other line may be the longer one, by as much as its own length allows.
    edits = max(1, (len(windows) + RUN - 1) // (EACH - 1))
    low, high = 0, len(by)
    while low < high:
        mid = (low + high) // 2
        if touched(np.flatnonzero(at <= mid)) > edits:
            high = mid
        else:
            low = mid + 1
    return by[:low]


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys by which lines (lid, line, large) are open."""
    for b in chunks(batches, "line"):
        lid, large, lines = b.column(0).to_pylist(), b.column(2).to_pylist(), Lines(b.column(1).to_pylist())
        out: list[tuple[int, int]] = []
        for v, at in lines.views():
            line, key = v.windows()
            cuts = np.flatnonzero(np.diff(line, prepend=-1)).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(line)], strict=True):
                row = int(lines.text[at[line[i]]])
                out += [(lid[row], k) for k in open_keys(key[i:j].view(np.int64), {x["k"]: x["c"] for x in large[row]})]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["lid", "k"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "line"):
        lines = Lines(b.column(1).to_pylist())
        for v, at in lines.views():
            line, bags = v.bags()
            lid, text = (c.take(pa.array(lines.text[at[line]])) for c in b.columns)
            yield pa.RecordBatch.from_arrays([lid, text, pa.compute.binary_length(text).cast(pa.int64()), pa.array([x.tobytes() for x in bags], pa.binary())], names=["lid", "line", "size", "bag"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lid of each of one block's open lines that is near an earlier line of another block.

    Lengths and bags leave few lines to compare; the likeliest come first and the first near one ends it, so no pairs are made.
    """
    for b in batches:
        for k in range(b.num_rows):
            sides = [dict(zip((f.name for f in c.type.value_type), c[k].values.flatten(), strict=True)) for c in b.columns]
            place = [x for x in sides[0] if x not in ("lid", "n", "line", "bag")]
            lid, n, *place = ([s[x].to_numpy() for s in sides] for x in ("lid", "n", *place))
            bag = [np.frombuffer(b"".join(s["bag"].to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for s in sides]
            mine, old = (s["line"] for s in sides)
            rank = np.empty(len(lid[0]) + len(lid[1]), np.int64)
            rank[np.lexsort([np.concatenate(x) for x in reversed(place)])] = np.arange(len(rank))
            first, others = rank[: len(lid[0])], rank[len(lid[0]) :]
            found = []
            for i in range(len(lid[0])):
                edits = np.maximum(n[0][i], n[1]) // EACH
                may = np.flatnonzero((others < first[i]) & (np.abs(n[1] - n[0][i]) <= edits) & (lid[1] != lid[0][i]))
                apart = np.abs(bag[1][may] - bag[0][i]).sum(1)
                by = np.argsort(apart, kind="stable")
                by = by[apart[by] <= 2 * edits[may[by]]]
                if len(by):
                    text = mine[i].as_py()
                    if any(near(text, old[j].as_py()) for j in may[by].tolist()):
                        found.append(lid[0][i])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["lid"])


def _rest(rows: DataFrame, found: DataFrame, lines: DataFrame) -> DataFrame | None:
    """lid of the lines that large groups leave open and that are near an earlier one: each line that isn't near the earliest, and whose
    keys of small groups don't settle it, is held against all earlier lines of some of its keys; None if there are none."""
    large = rows.where(f"c > {SMALL}").select("k", "lid", "n", "c")
    left = large.join(found, "lid", "left_anti").groupBy("lid").agg(F.collect_list(F.struct("k", "c")).alias("large"))
    asks = stash(arrow_map(lines.join(left, "lid").select("lid", "line", "large"), _open, "lid long, k long"), "line-open")
    if asks.isEmpty():
        return None
    having = stash(large.join(asks.select("k").distinct(), "k", "left_semi").join(asks.withColumn("asks", F.lit(True)), ["lid", "k"], "left"), "line-having")
    bags = arrow_map(lines.join(having.select("lid").distinct(), "lid", "left_semi").select("lid", "line"), _bags, "lid long, line binary, size long, bag binary")
    bags = stash(bags, "line-bags")
    many = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES))
    sizes = having.join(bags.select("lid", "size"), "lid").groupBy("k").agg(many.alias("many"))
    n = F.col("many")
    one = F.struct("lid", "n", F.col("lid").alias("rank"), "line", "bag")
    blocks = having.join(bags, "lid").join(sizes, "k").groupBy("k", F.pmod(F.xxhash64("lid"), n).alias("i"), n.alias("of")).agg(F.collect_list(F.when(F.col("asks"), one)).alias("open"), F.collect_list(one).alias("all"))
    blocks = stash(blocks, "line-blocks")
    drop(having, bags)
    asking = blocks.where("size(open) > 0").select("k", "open", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("i"))
    return arrow_map(asking.join(blocks.select("k", "i", "all"), ["k", "i"]).select("open", "all"), _close, "lid long")


def near_lines(docs: DataFrame, firsts: DataFrame, size: int) -> DataFrame:
    """lid of the distinct lines that have an earlier line near them. *firsts* has lid and first (place) of each; the texts have *size* bytes.

    Lines that share a half with another go on to the deletion neighbourhood of one edit; lines that share a run are
    held against the earliest that has it, and against all others that have it unless rarer runs settle it. The edit distance is verified on the texts. Keys go packed to lanes, and only those
    that lines share come back as rows.
    """
    # A line has about a key for every 25 bytes, and if it is contested some variants for each.
    lanes = size // (25 * LANE) + 1
    packs = arrow_map(docs.select("text"), lambda it: _keys(first_lanes(lanes), it), Packs.SCHEMA)
    met = stash(meet(packs, lanes, _met, _MET), "line-shared")
    contested = met.groupBy("lid").agg(F.bit_or("kinds").alias("kinds"))
    # From here on a line goes by its rank among the contested ones, in the order of their places: less is earlier.
    ranked = firsts.select("lid", "first").join(contested.hint("shuffle_hash"), "lid").orderBy("first._id", "first._th", "first.no").select(F.monotonically_increasing_id().alias("rank"), "lid", "first", "kinds")
    ranked = stash(ranked, "line-ranks")
    rank = F.col("rank").alias("lid")
    places = ranked.select("first.*", "kinds", "rank").groupBy("_id", "_th").agg(F.collect_list(F.struct("no", "kinds", "rank")).alias("picks"))
    texts = docs.select("_id", "_th", "text").join(places, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select("text", "picks")
    made = stash(arrow_map(texts, lambda it: _variants(first_lanes(4 * lanes), it), f"{Packs.SCHEMA}, lid long, line binary"), "line-variants")
    lines = made.where("lid is not null").select("lid", "line")
    variants = meet(made.where("lane is not null").select("lane", "m", "data"), 4 * lanes, _variants_met, _VARIANT)

    def verified(pairs: DataFrame, line: DataFrame) -> DataFrame:
        # Both sides read the lines by lid, so that they are dealt once.
        new = pairs.distinct().join(line, "lid").select(F.col("lid").alias("of"), F.col("line").alias("new"), "o")
        both = new.join(line, F.col("o") == F.col("lid")).select("of", "new", "line")
        return stash(arrow_map(both, _verify, "lid long").distinct(), "line-near")

    runs = stash(_grouped(met.where(f"kinds = {FAR}").select("k", "lid", "n").join(ranked.select("rank", "lid").hint("shuffle_hash"), "lid").select("k", rank, "n")), "line-runs")
    found = verified(_one_edit(variants).unionByName(_more_edits(runs)), lines)
    rest = _rest(runs, found, lines)
    if rest is not None:
        found = found.unionByName(rest)
    out = stash(found.distinct().withColumnRenamed("lid", "rank").join(ranked.select("rank", "lid"), "rank").select("lid").distinct(), "line-all-near")
    drop(made, met, ranked)
    return out


def line_dedup(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per row of *docs*: doc_id, the columns named by *keep*, n_lines, n_removed, n_near and the text without repeated lines.

    Lines are compared by their words; blank ones stay where they are. Of equal lines the earliest, by doc_id, text hash
    and line number, stays; a line also goes, wherever it stands, if an earlier line, kept or not, is near it (see near()). n_near of the removed lines went for that. Null texts count as
    empty, null ids come first; rows that repeat id and text are one document and get equal results.
    """
    rows = keyed(docs)
    # Hashing the lines again costs more than a table of them, which has some 18 bytes a line.
    bytes_ = Observation()
    read = rows.select("_id", "_th", "text").observe(bytes_, F.sum(F.octet_length("text")).alias("size"))
    seen = stash(arrow_map(read, _lines, "_id long, _th long, no int, lid long, rest long"), "line-places")
    place, mark = F.struct("_id", "_th", "no"), ["lid", "rest"]
    firsts = stash(seen.groupBy(*mark).agg(F.min(place).alias("first"), F.count("*").alias("n")), "line-firsts")
    near = near_lines(rows, firsts, bytes_.get["size"] or 0).withColumn("near", F.lit(True))
    # The smaller side of a join is hashed, a few rows for each partition, so that the larger one, or its texts, needn't be sorted.
    flags = firsts.join(near.hint("shuffle_hash"), "lid", "left").where("n > 1 or near").select(*mark, "first", "n", F.coalesce("near", F.lit(False)).alias("near"))
    flags = stash(flags, "line-flags")
    total = seen.count()
    drop(firsts)
    hot, rest = flags.where(F.col("n") * HOT > total), flags.where(F.col("n") * HOT <= total)
    few = F.broadcast(hot)  # fewer than HOT rows, whatever the input
    marked = seen.join(few, mark).unionByName(seen.join(few.select(*mark), mark, "left_anti").join(rest.hint("shuffle_hash"), mark))
    # Two sets are one pass; a distinct count would group all rows by number first.
    gone = marked.where(F.col("near") | (place != F.col("first"))).groupBy("_id", "_th").agg(F.collect_set("no").alias("gone"), F.size(F.collect_set(F.when(F.col("near"), F.col("no")))).alias("n_near"))
    carried = [F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep or [])]
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), F.col("doc_id").alias("_doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carried)
    out = named.join(gone.hint("shuffle_hash"), ["_id", "_th"], "left").select("_doc_id", *(f"keep_{k}" for k in range(len(carried))), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "gone", "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name not in ("gone", "text"))
    got = arrow_map(out, _rebuild, f"{fields}, n_lines long, text string")
    return got.select(F.col("_doc_id").alias("doc_id"), *(F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep or [])), "n_lines", "n_removed", "n_near", "text")
