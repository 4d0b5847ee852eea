"""N-gram Jaccard join: a MinHash LSH forest proposes, exact shingle sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import NO_ID, arrow_map, chunks, components, drop, keyed, mix64, stash

#: Words of a shingle, and the least similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Trees of the forest, labels of a path in each, and the recall of links to which matched prefixes are shortened.
TREES, DEPTH, RECALL = 40, 8, 0.99999
#: Steps in which the similarity of links is tallied.
STEPS = 100
#: Texts of a block; larger candidate groups are compared block by block.
BLOCK = 512

_M = np.uint64(0x9E3779B97F4A7C15)


def chance(similarity: np.ndarray | float, k: int, trees: int) -> np.ndarray:
    """That two texts of a similarity share a prefix of *k* labels in one of the trees: each label is equal with that chance."""
    return 1 - (1 - np.asarray(similarity, np.float64) ** k) ** trees


def floor_depth(similarity: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix that gives even links of the least similarity the recall; 1 if none does."""
    return next((k for k in range(deepest, 1, -1) if chance(similarity, k, trees) >= recall), 1)


def shortened(tally: np.ndarray, k: int, least: int, similarity: float, trees: int, recall: float) -> int:
    """The prefix to go on with after links were found by *k* labels: *k* itself if they are the wanted share of all.

    *tally* has the links by similarity, in steps from *similarity* to 1. A link found stands for 1 / chance of them. One link more of
    the least similarity is counted, as few links are no evidence; so without any the answer is *least*, where recall holds for all.
    """
    at = similarity + (1 - similarity) * np.arange(len(tally)) / max(len(tally) - 1, 1)
    there = tally / chance(at, k, trees)
    there[0] += 1
    return next((j for j in range(k, least, -1) if (there * chance(at, j, trees)).sum() >= recall * there.sum()), least)


class Shingler:
    """Sets of word n-grams as sorted 64-bit hashes; remembers word hashes up to a bound."""

    def __init__(self, n: int = SHINGLE):
        self.n, self.known = n, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().encode().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        out = np.zeros(max(len(ids) - self.n + 1, 1), np.uint64)
        for k in range(min(self.n, len(ids))):
            out = (out ^ ids[k : k + len(out)]) * _M
            out ^= out >> np.uint64(32)
        return np.unique(out)


def _signatures(levels: int, trees: int, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20_117)
    a = rng.integers(1, 2**63, (levels * trees, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, (levels * trees, 1), np.uint64)
    sets = Shingler(n)
    grid = np.empty((trees, levels + 1), ">u2")
    grid[:, 0] = np.arange(trees)
    for c in chunks(batches):
        digests, sizes, paths = [], [], []
        for t in c.column(3).to_pylist():
            s = sets(t)
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
            sizes.append(len(s))
            if len(s):
                low = np.full((levels * trees, 1), 2**64 - 1, np.uint64)
                for at in range(0, len(s), 1024):
                    low = np.minimum(low, (s[None, at : at + 1024] * a + b).min(1, keepdims=True))
                grid[:, 1:] = (mix64(low) >> np.uint64(48)).reshape(trees, levels)
                paths.append(grid.tobytes())
            else:
                paths.append(b"")
        yield pa.RecordBatch.from_arrays([*c.columns[:3], pa.array(digests), pa.array(sizes, pa.int32()), pa.array(paths, pa.binary())], names=["_id", "_th", "doc_id", "digest", "n", "paths"])


_NEXT = "digest string, other string, depth int, part int, last boolean, path binary"


def _neighbours(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths in order, each with the one before and the labels they share, if *least* or more; the first and last path as they are."""

    def send(digest: list, other: list, depth: list, last: list, path: list) -> pa.RecordBatch:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        cols = [pa.array(digest, pa.string()), pa.array(other, pa.string()), pa.array(depth, pa.int32()), pa.array([part] * len(digest), pa.int32()), pa.array(last, pa.bool_()), pa.array(path, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["digest", "other", "depth", "part", "last", "path"])

    before: tuple[str, bytes] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        digest, path = b.column(0).to_pylist(), b.column(1).to_pylist()
        if before is None:
            yield send(digest[:1], [None], [None], [False], path[:1])
        else:
            digest.insert(0, before[0])
            path.insert(0, before[1])
        labels = np.frombuffer(b"".join(path), np.uint16).reshape(len(path), -1)
        shared = np.cumprod(labels[1:] == labels[:-1], 1).sum(1) - 1
        some = np.flatnonzero(shared >= least).tolist()
        yield send([digest[k + 1] for k in some], [digest[k] for k in some], shared[some].tolist(), [None] * len(some), [None] * len(some))
        before = digest[-1], path[-1]
    if before:
        yield send([before[0]], [None], [None], [True], [before[1]])


def forest(texts: DataFrame, trees: int, levels: int, least: int) -> DataFrame:
    """(digest, other, depth): neighbours in the sorted paths of each tree, and the labels that they share, *least* or more.

    All tries are one table of paths, a tree's number and its labels, sorted over all partitions; a trie's node is a run of paths with a
    common prefix. Texts below a node of k labels are linked by neighbours that share k. Sorting is by path and text, so
    no path is too frequent for a partition. What ends one partition and begins the next is two rows of each.
    """
    width = 2 * (levels + 1)
    paths = texts.select("digest", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t"), "paths")
    paths = paths.select("digest", F.expr(f"substring(paths, t * {width} + 1, {width})").alias("path"))
    spread = paths.repartitionByRange("path", "digest").sortWithinPartitions("path", "digest")
    found = stash(arrow_map(spread, lambda it: _neighbours(least, it), _NEXT), "forest")
    ends = found.where("path is not null").withColumn("seam", F.lit(True))
    # Two rows of a partition.
    w = Window.partitionBy("seam").orderBy("part", "last")
    seams = ends.select("digest", "path", "last", F.lag("digest").over(w).alias("other"), F.lag("path").over(w).alias("before")).where("not last and other is not null")
    same = F.expr(f"aggregate(sequence(0, {levels}), 0, (n, k) -> if(n = k and substring(path, 1, 2 * k + 2) = substring(before, 1, 2 * k + 2), n + 1, n)) - 1")
    seams = seams.select("digest", "other", same.alias("depth")).where(F.col("depth") >= least)
    return found.where("path is null").select("digest", "other", "depth").unionByName(seams)


def _sets(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = Shingler(n)
    for b in chunks(batches):
        at = b.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != at), pa.array([sets(t).view(np.int64) for t in b.column(at).to_pylist()], pa.list_(pa.int64()))], names=[*(x for x in b.schema.names if x != "text"), "shingles"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left shares with each on the right, by strips of an incidence matrix."""
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = [len(s) for s in (*left, *right)]
    row = np.repeat(np.arange(len(sizes)), sizes)
    common = np.bincount(place, minlength=len(values))[place] > 1
    row, place = row[common], np.unique(place[common], return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(left), len(right)), np.float32)
    strip = 4096
    for lo in range(0, (int(place[-1]) + 1) if len(place) else 0, strip):
        a, b = np.searchsorted(place, (lo, lo + strip))
        grid = np.zeros((len(sizes), strip), np.float32)
        grid[row[a:b], place[a:b] - lo] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out


def _links(similarity: float, key: tuple, rows: list[tuple[str, int, np.ndarray]]) -> Iterator[tuple[str, int, str, list[int] | None]]:
    """(digest, links, least linked digest of the block pair's component) of the members of one pair of blocks.

    The first one has the tally of all links by similarity beside it.
    """
    _, i, j = key
    left = [r for r in rows if r[1] == i]
    right = left if i == j else [r for r in rows if r[1] == j]
    if not left or not right:
        return
    shared = overlaps([r[2] for r in left], [r[2] for r in right])
    na, nb = np.array([len(r[2]) for r in left], np.float64), np.array([len(r[2]) for r in right], np.float64)
    union = na[:, None] + nb[None, :] - shared
    near = shared >= similarity * union - 1e-9
    names = [r[0] for r in left]
    if i == j:
        np.fill_diagonal(near, False)
    step = (shared[near] / union[near] - similarity) / max(1 - similarity, 1e-9) * STEPS
    tally = np.bincount(np.clip(step, 0, STEPS).astype(np.int64), minlength=STEPS + 1) // (2 if i == j else 1)
    if i != j:
        names += [r[0] for r in right]
        near = np.block([[np.zeros((len(left), len(left)), bool), near], [near.T, np.zeros((len(right), len(right)), bool)]])
    order = np.argsort(np.array(names))
    near = near[np.ix_(order, order)]
    root = np.arange(len(names))
    while True:  # the least label that links lead to, until the labels stand
        new = np.minimum(root, np.where(near, root[None, :], len(names)).min(1, initial=len(names)))
        new = new[new]
        if (new == root).all():
            break
        root = new
    for n, k in enumerate(np.flatnonzero(near.any(1))):
        yield names[order[k]], int(near[k].sum()), names[order[root[k]]], None if n else tally.tolist()


def _blocks(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks one after another: the rows are sorted by them, and a pair has about 2 BLOCK texts at most."""

    def send(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.int64()))], names=["digest", "links", "other", "tally"])

    key, rows, out = None, [], []
    for b in batches:
        cols = [b.column(k).to_pylist() for k in range(5)]
        lists = b.column(5)
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for k, (label, i, j, digest, block) in enumerate(zip(*cols, strict=True)):
            if (label, i, j) != key:
                if rows:
                    out += _links(similarity, key, rows)
                key, rows = (label, i, j), []
            rows.append((digest, block, flat[ends[k] : ends[k + 1]].copy()))
        yield send(out)
        out = []
    if rows:
        yield send(list(_links(similarity, key, rows)))


def _verified(rows: DataFrame, texts: DataFrame, edges: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links of the texts that *edges* (a, b) hold together: all sets of such a group are compared exactly, in blocks once it is larger than one."""
    cand = stash(components(edges, "candidates"), "candidates")
    size = cand.groupBy("label").agg(F.count("*").alias("m"))
    members = cand.join(size, "label").select(F.col("node").alias("digest"), "label", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    members = members.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("nb")).cast("int"))
    named = members.join(texts.select("digest", "rep"), "digest").select("rep.*", "digest", "label", "nb", "block")
    found = rows.select("_id", "_th", "text").join(named, ["_id", "_th"]).dropDuplicates(["digest"])
    sets = arrow_map(found.select("digest", "label", "nb", "block", "text"), lambda it: _sets(shingle, it), "digest string, label string, nb int, block int, shingles array<long>")
    sets = stash(sets, "shingles")
    placed = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("label", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "digest", "block", "shingles")
    spread = placed.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    links = stash(arrow_map(spread, lambda it: _blocks(similarity, it), "digest string, links long, other string, tally array<long>"), "links")
    drop(cand, sets)
    return links


def _classes(docs: DataFrame, similarity: float, shingle: int, trees: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(each row's digest and number of shingles, each digest's class and counts)."""
    rows = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    sig = stash(arrow_map(rows, lambda it: _signatures(DEPTH, trees, shingle, it), "_id long, _th long, doc_id long, digest string, n int, paths binary"), "signatures")
    texts = stash(sig.where("n > 0").groupBy("digest").agg(F.min(F.struct("_id", "_th")).alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.any_value("paths").alias("paths")), "texts")
    least = floor_depth(similarity, trees, DEPTH, recall)
    near = forest(texts, trees, DEPTH, least)
    k = DEPTH
    while True:
        links = _verified(rows, texts, near.where(F.col("depth") >= k).select(F.col("digest").alias("a"), F.col("other").alias("b")), similarity, shingle)
        tally = np.zeros(STEPS + 1)
        for r in links.where("tally is not null").select(F.posexplode("tally").alias("step", "n")).groupBy("step").agg(F.sum("n")).collect():  # STEPS + 1 rows at most
            tally[r[0]] = r[1]
        then = shortened(tally, k, least, similarity, trees, recall)
        if then == k:
            break
        drop(links)
        k = then
    classes = components(links.select(F.col("digest").alias("a"), F.col("other").alias("b")), "classes").withColumnRenamed("node", "digest")
    counts = links.groupBy("digest").agg(F.sum("links").alias("n_links"))
    per = texts.drop("paths").join(classes, "digest", "left").join(counts, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    named = per.groupBy("label").agg(F.min("least").alias("class_id"), F.min("rep").alias("first"))
    return sig, stash(per.join(named, "label").select("digest", "class_id", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies"), "classes")


def ngram_join(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """Per row of *docs*: doc_id, class_id, n_links (other texts linked to its text) and n_copies (rows of its text).

    Two texts are linked if the Jaccard similarity of their sets of *shingle* lower-case words in a row is
    *similarity* or more; a class is what links connect, named by its least doc_id. Texts with equal sets are
    one text with copies. A text of fewer words has one shingle of them all; one without words is linked to
    nothing, and null texts are such. Null ids sort first; repeated rows are copies; a table without rows gives none.

    Each text has a path of MinHash labels in every tree, and the tries of paths are sorted. Texts that share a whole path are candidates
    first. The links that are found by exact sets tell, by their similarity, how many links are not found yet; while that
    is more than the recall allows, the prefixes that make candidates are shortened, at most to where links of the least similarity have that recall.
    What hangs together by shared prefixes is compared exactly, in blocks once it is larger than one.
    """
    sig, per = _classes(docs, similarity, shingle, trees, recall)
    out = sig.select("doc_id", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(per.drop("first"), "digest", "left")
    return out.select("doc_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """*docs* with one row of each class of ngram_join: that of the least doc_id. Rows without words all stay, once each."""
    sig, per = _classes(docs, similarity, shingle, trees, recall)
    stay = per.select("first.*").unionByName(sig.where("n = 0").select("_id", "_th")).distinct()
    key = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.select(key[0].alias("_id"), key[1].alias("_th"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    return rows.join(stay, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select("_row.*")
