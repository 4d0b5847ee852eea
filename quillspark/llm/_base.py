"""What the operators of this subpackage share: scratch tables, keys, Arrow batches, components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute is there only once imported
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Words are runs of anything but these six ASCII characters (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that an Arrow batch may have; texts can be long, so far less than Spark's default of 10,000.
BATCH_ROWS = 1000
#: Bytes from which a batch is sent, whatever its rows; one longer text is a batch of its own.
BATCH_BYTES = 1 << 24
#: Stands for a missing doc_id in keys.
NO_ID = -(2**63)

#: Entries that a task packs together, entries of a lane, parts that a pack is cut into at most, and entries of a key in a pack that
#: go to its lane at most.
PACK, LANE, SPREAD, CROWD = 1 << 20, 1 << 20, 1024, 64

#: On a local file system without Hadoop's native code each file that is made, and its checksum file, has a process forked from the executor to set its
#: mode, which for that moment counts the executor's memory twice; scratch tables go without checksum files. Other file systems don't read these.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_scratch: set[str] = set()

_M, _N = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_M), -1, 2**64))


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: below spark.checkpoint.dir, which all executors share.

    Where that is unset a temporary folder serves local sessions; a cluster must set it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quillspark-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _scratch.discard(path)


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write *df* as Parquet into the shared folder and read it back: a cut lineage that lost executors can't undo. *options* are the writer's."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean, spark)
    _scratch.add(path)
    df.write.options(**_PLAIN, **options).parquet(path)
    # What the written plan shuffled isn't read again; its files go once the driver sees that no plan holds them.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path  # type: ignore[attr-defined]
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, t._quill_path)


def _clean(spark: SparkSession) -> None:
    for path in list(_scratch):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already; nothing reads these files then
            return


def keyed(docs: DataFrame) -> DataFrame:
    """_id, _th, doc_id and text of *docs*: the key of a document is its doc_id with a hash of its text.

    Rows that repeat doc_id and text share a key and hence their fate; a null text counts as empty, a null
    doc_id as one more id. Other columns, whatever their names, are left behind.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_th"), F.col("doc_id"), text.alias("text"))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches that hold long texts in bounded memory."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # Some thousand long texts in a row would be more than a worker may hold.
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts have about *most* bytes; a longer text comes alone and whole."""
    for b in batches:
        at, size = 0, 0
        col = b.column(b.schema.get_field_index(text))
        for i, n in enumerate(pa.compute.binary_length(col).to_pylist()):
            if i > at and size + (n or 0) > most:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        if b.num_rows > at:
            yield b.slice(at)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of M and of its inverse from 0 to *n*; short rows share them."""
    most = 1 << 20
    if n > most:
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, m, np.uint64)]), dtype=np.uint64) for m in (_M, _INVERSE))
    if not _powers:
        _powers.extend(np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, m, np.uint64)]), dtype=np.uint64) for m in (_M, _INVERSE))
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Rolling:
    """Karp-Rabin values of all windows of any length of a row of ids, modulo 2^64: each from the sums of two prefixes."""

    def __init__(self, ids: np.ndarray):
        x = ids.astype(np.uint64) * _N
        x ^= x >> np.uint64(29)
        # sum of x[k] * M^(-k): a window's sum times M^start depends on the window alone.
        n = len(ids)
        self.up, down = powers(n)
        x *= down[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x, out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The values of the windows from *start* to *end* (not included), not yet mixed."""
        return (self.sums[end] - self.sums[start]) * self.up[start]

    def without_one(self, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The values of the same windows without what is at *place*."""
        return (self.sums[place] - self.sums[start] + (self.sums[end] - self.sums[place + 1]) * _M) * self.up[start]

    def __call__(self, n: int) -> np.ndarray:
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        out = (self.sums[n:] - self.sums[:-n]) * self.up[: len(self.sums) - n]
        return out ^ out >> np.uint64(31)


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: one to one on 64 bits."""
    h = (h ^ h >> np.uint64(30)) * _N
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


#: Bytes whose running sums are made at once, few enough for a core's cache.
_SEGMENT = 1 << 15
_BYTES = np.random.default_rng(71).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of UTF-8 text: runs of anything but the six ASCII spaces.

    Hashes are made from running sums, a segment of the text at a time, so memory has a bound beside the words themselves, and a word
    of any length costs its length.
    """
    up, down = powers(_SEGMENT)
    raw = np.frombuffer(data, np.uint8)
    edge = np.ones(len(raw) + 2, bool)
    np.logical_or(raw == 32, raw - np.uint8(9) < 5, out=edge[1:-1])
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = turns[0::2], turns[1::2]
    out = np.zeros(len(starts), np.uint64)
    for off in range(0, len(raw), _SEGMENT):
        part = raw[off : off + _SEGMENT]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * down[: len(part)], out=sums[1:])
        a, b = np.searchsorted(ends, off, "right"), np.searchsorted(starts, off + len(part), "left")
        if a == b:
            continue
        s, e = starts[a:b] - off, np.minimum(ends[a:b] - off, len(part))
        scale = up[np.maximum(s, 0)]
        if s[0] < 0:  # the word goes on from the segment before
            scale[0] = np.uint64(pow(int(_INVERSE), int(-s[0]), 2**64))
        out[a:b] += (sums[e] - sums[np.maximum(s, 0)]) * scale
    return starts, ends, mix64(out)


def shut(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte by byte of their numbers side by side, compressed."""
    # A transposed view's own bytes are gathered one by one, so it is copied first.
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def opened(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(pa.decompress(data, n * sum(widths), codec="zstd"), np.uint8)
    out, at = [], 0
    for k, w in zip(kinds, widths, strict=True):
        column = np.empty((n, w), np.uint8)
        for j in range(w):
            column[:, j] = planes[at + j * n : at + (j + 1) * n]
        out.append(column.view(k).ravel())
        at += n * w
    return out


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys (uint64), what has them (int64), tags (uint32)


def ordered(entries: Iterable[Entries]) -> Entries:
    """The entries by key, then by what has it, each once."""
    key, lid, tag = (np.concatenate(c) for c in zip(*entries, strict=True))
    by = np.argsort(key)
    key, lid, tag = key[by], lid[by], tag[by]
    # What else orders entries matters among equal keys alone.
    same = key[1:] == key[:-1]
    some = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(key) else by
    by = some[np.lexsort((tag[some], lid[some], key[some]))]
    lid[some], tag[some] = lid[by], tag[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (lid[1:] != lid[:-1]) | (tag[1:] != tag[:-1])
    return key[new], lid[new], tag[new]


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where groups of equal keys in a row begin, the group of each)."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


class Packs:
    """Entries on their way to the lanes that their keys name, packed together: a lane meets all entries of a key.

    A key that has more than CROWD entries in one pack sends these on by themselves, but for the first ones, which show the lane that
    others have it. They go to lanes below zero, where they need meet no others; so no lane holds a key without bound.
    """

    SCHEMA = "lane long, m int, data binary"

    def __init__(self, lanes: int):
        self.lanes, self.held, self.n, self.loose = lanes, [], 0, 1

    def add(self, *entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(entries)
        self.n += len(entries[0])
        if self.n >= PACK:
            yield self.send()

    def send(self) -> pa.RecordBatch:
        rows: list[tuple] = []
        if self.n:
            key, lid, tag = ordered(self.held)
            starts, of = groups(key)
            crowd = np.arange(len(key)) - starts[of] >= CROWD
            keep = ~crowd
            cuts = [(-self.loose - (TaskContext.get().partitionId() << 32 if TaskContext.get() else 0), key[crowd], lid[crowd], tag[crowd])] if crowd.any() else []
            self.loose += bool(cuts)
            key, lid, tag = key[keep], lid[keep], tag[keep]
            lane = ((key >> np.uint64(32)) * np.uint64(self.lanes) >> np.uint64(32)).astype(np.int64)
            at = [0, *(np.flatnonzero(np.diff(lane)) + 1).tolist(), len(lane)]
            cuts += [(int(lane[i]), key[i:j], lid[i:j], tag[i:j]) for i, j in zip(at, at[1:], strict=False)]
            rows = [(k, len(e[0]), shut(*e)) for k, *e in cuts]
        self.held, self.n = [], 0
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["lane", "m", "data"])


def _lanes(decide: Callable[[Entries, bool], pa.RecordBatch], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What *decide* says of each lane's entries, in order, and of crowds (true), pack by pack. Rows come sorted by lane."""
    now, held = None, []
    for b in batches:
        for lane, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and lane != now:
                yield decide(ordered(held), now < 0)
                held = []
            now = lane
            held.append(opened(data, n, np.uint64, np.int64, np.uint32))
    if held:
        yield decide(ordered(held), now < 0)


def _again(lanes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs for more lanes."""
    packs = Packs(lanes)
    for b in batches:
        for lane, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if lane < 0:
                yield pa.RecordBatch.from_arrays([pa.array([lane], pa.int64()), pa.array([n], pa.int32()), pa.array([data], pa.binary())], names=["lane", "m", "data"])
            else:
                yield from packs.add(*opened(data, n, np.uint64, np.int64, np.uint32))
    yield packs.send()


def first_lanes(lanes: int) -> int:
    """Lanes of the first exchange."""
    return max(1, min(lanes, SPREAD))


def meet(packs: DataFrame, lanes: int, decide: Callable[[Entries, bool], pa.RecordBatch], schema: str) -> DataFrame:
    """The rows of *schema* that *decide* makes of the entries of each of *lanes*; *packs* were made for first_lanes(lanes).

    A pack is cut into SPREAD parts at most, however many lanes there are: with more lanes there is an exchange more.
    """
    n, at = packs.sparkSession.sparkContext.defaultParallelism, first_lanes(lanes)
    while at < lanes:
        more = min(lanes, at * SPREAD)
        packs = arrow_map(packs.repartition(at, "lane"), lambda it, more=more: _again(more, it), Packs.SCHEMA)
        at = more
    return arrow_map(packs.repartition(max(n, at), "lane").sortWithinPartitions("lane"), lambda it: _lanes(decide, it), schema)


def cut_off(df: DataFrame, count: str, most: int) -> int:
    """The least count that at most *most* rows of *df* reach, as far as a histogram of counts tells it; no task sees all rows.

    Counts below 4,096 are told apart, larger ones by their leading 12 bits.
    """
    n = F.col(count)
    wide = F.greatest(F.lit(0), F.floor(F.log2(n.cast("double"))).cast("int") - 11)
    low = F.when(n < 4096, n).otherwise(F.call_function("shiftleft", F.call_function("shiftright", n, wide), wide))
    bins = df.where(n > 0).groupBy(low.alias("low")).count().collect()  # some ten thousand rows at most
    at, left = 2**62, most
    for r in sorted(bins, key=lambda r: -r[0]):
        left -= r[1]
        if left < 0:
            break
        at = r[0]
    return at


def components(edges: DataFrame, name: str, rounds: int = 100) -> DataFrame:
    """Connected components of edges (a, b): a table (node, label), label being the least node.

    Alternating large-star and small-star rounds on the edge table, each written to the shared folder, until
    the edges stand still; a hub's neighbours meet only in aggregates, whose partial sums run before the shuffle.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stash(both, f"{name}-edges")
    mark = None
    for _ in range(rounds):
        sides = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = sides.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low2, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.*")
        new = stash(small.where("a <> b").distinct(), f"{name}-edges")
        drop(now)
        now = new
        at = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if at == mark:
            break
        mark = at
    else:
        raise RuntimeError(f"components: no rest after {rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
