"""The index: Parquet tables of documents, postings and terms below one path, and snapshots of them."""

from __future__ import annotations

import gc
import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SearchError, invalid
from ..functions.analysis import analyze, terms, words_at
from ..ship import ship

#: The limits of ids, versions, fields, string filters, payloads and synonyms.
ID_BYTES, VERSION_BYTES, FIELDS, STRING_BYTES, PAYLOAD_BYTES = 4096, 4096, 1024, 65_530, 65_536
RULES, REPLACEMENTS = 1024, 16
_TYPES = {"string": "string", "number": "double", "boolean": "boolean"}


@dataclass(frozen=True)
class Options:
    """What an index is opened with. Weights are of queries, the rest is its identity."""

    fields: tuple[tuple[str, float], ...]
    filters: tuple[tuple[str, str], ...] = ()
    stop_words: bool = True
    positions: bool = True
    surface_terms: bool = False
    synonyms: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    @property
    def weights(self) -> dict[str, float]:
        return dict(self.fields)

    @property
    def kinds(self) -> dict[str, str]:
        return dict(self.filters)

    def identity(self) -> str:
        own = [self.names, self.filters, self.stop_words, self.positions, self.surface_terms, self.synonyms, "porter2-1", "blocks-1"]
        return hashlib.sha256(json.dumps(own).encode()).hexdigest()


def validate_options(fields: list, filters: list | None = None, stop_words: bool = True, positions: bool = True, surface_terms: bool = False, synonyms: list | None = None) -> Options:
    """Options from {name, weight?}, {name, type} and {source, replacements} entries, or an error."""
    text = [(f, 1.0) if isinstance(f, str) else (f["name"], float(f.get("weight", 1))) for f in fields]
    meta = [(f["name"], f["type"]) for f in filters or []]
    for names in ([n for n, _ in text], [n for n, _ in meta]):
        if len(names) > FIELDS or len(set(names)) < len(names) or any(not n or n.startswith("__quill_") for n in names):
            raise invalid("field names are distinct, not empty and not reserved")
    if not text or any(not 0 <= w < float("inf") for _, w in text):
        raise invalid("an index has text fields of finite weights")
    if any(t not in _TYPES for _, t in meta):
        raise invalid(f"filter types are {sorted(_TYPES)}")
    rules: dict[str, tuple[str, ...]] = {}
    for r in synonyms or []:
        one = lambda s: (lambda ts: ts[0].term if len(ts) == 1 else None)(analyze(s, stop_words))
        to = tuple(sorted({one(x) or "" for x in r["replacements"]}))
        source = one(r["source"])
        if not source or "" in to or source in to or source in rules or len(to) > REPLACEMENTS:
            raise invalid("a synonym is one token, to others than itself, once")
        rules[source] = to
    if len(rules) > RULES:
        raise invalid("at most 1,024 synonym rules")
    return Options(tuple(text), tuple(meta), stop_words, positions, surface_terms, tuple(sorted(rules.items())))


def as_records(df: DataFrame, options: Options, id_col: str = "id", version: str | None = None, fields: dict[str, str] | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """Records (id, version, t_<field> and f_<filter> arrays) from columns that are scalars or arrays.

    Strings and Booleans of a filter are kept once, numbers with their repeats and with -0 as 0; nulls are missing.
    """
    def many(name: str, to: str):
        col = F.col(name)
        if df.schema[name].dataType.typeName() != "array":
            col = F.array(col)
        return F.filter(F.coalesce(col.cast(f"array<{to}>"), F.array().cast(f"array<{to}>")), lambda x: x.isNotNull())

    cols = [F.col(id_col).cast("string").alias("id"), (F.col(version).cast("string") if version else F.lit(None).cast("string")).alias("version")]
    for n in options.names:
        cols.append(many((fields or {}).get(n, n), "string").alias(f"t_{n}"))
    for n, kind in options.filters:
        col = many((filters or {}).get(n, n), _TYPES[kind])
        cols.append((F.transform(col, lambda x: x + F.lit(0.0)) if kind == "number" else F.array_distinct(col)).alias(f"f_{n}"))
    return df.select(*cols)


def _code(options: Options) -> Column:
    """Why a record can't be indexed, or null."""
    code = F.when(F.col("id").isNull() | ~F.octet_length("id").between(1, ID_BYTES) | (F.coalesce(F.octet_length("version"), F.lit(0)) > VERSION_BYTES), F.lit("E_INVALID_ARGUMENT"))
    for n, kind in options.filters:
        if kind == "string":
            code = code.when(F.exists(f"f_{n}", lambda x: F.octet_length(x) > STRING_BYTES), "E_RESOURCE_LIMIT")
        if kind == "number":
            code = code.when(F.exists(f"f_{n}", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "E_INVALID_ARGUMENT")
    return code


def rejections(records: DataFrame, options: Options) -> DataFrame:
    """id, operation and code of the records that can't be indexed: bad ids, versions, or values that are too long or not finite."""
    return records.select("id", F.lit("upsert").alias("operation"), _code(options).alias("code")).where("code is not null")


_RETIRED = ".quill-retired"
_TERM = "surface boolean, field int, term string, df long, total long"
_POSTING = "surface boolean, field int, term string, id string, tf int, positions array<int>, len int"


#: How postings are stored: those of a term in some records are a row, with how many they are and their summed tf; BLOCK of them at most.
_BLOCKS = "surface boolean, field int, term string, df long, total long, posts array<struct<id: string, tf: int, positions: array<int>, len: int>>"
BLOCK = 4096
#: Words of records whose postings are made at once: they take much more room here than their texts.
_AT_ONCE = 1 << 17


def _grouped(options: Options, packed: bool, field: int, ids: pa.Array, words: list[str], counts: list[int], rows: list[int], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Postings of a field, in blocks if *packed*: *words* of all its values, with the number, the record and the positions of those of each value."""
    coded = pa.array(words, pa.string()).dictionary_encode()
    known = [terms(w, options.stop_words) for w in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy()
    row, at = np.repeat(np.array(rows, np.int64), counts), np.concatenate(places)
    synonyms = dict(options.synonyms)
    for raw in (False, True) if options.surface_terms else (False,):
        number: dict[str, int] = {}
        of = np.array([-1 if t[not raw] is None else number.setdefault(t[not raw], len(number)) for t in known], np.int64)[code]
        some = np.flatnonzero(of >= 0)
        of, doc, place = of[some], row[some], at[some]
        own, own_doc, own_place = of, doc, place
        for source, more in synonyms.items() if not raw else ():
            if source in number:
                mine = np.flatnonzero(own == number[source])
                for x in more:
                    extra = np.full(len(mine), number.setdefault(x, len(number)))
                    of, doc, place = np.concatenate([of, extra]), np.concatenate([doc, own_doc[mine]]), np.concatenate([place, own_place[mine]])
        if not len(of):
            continue
        listed = sorted(number)
        rank = np.empty(len(listed), np.int64)
        rank[[number[t] for t in listed]] = np.arange(len(listed))
        of = rank[of]
        key = of * (int(doc.max()) + 1) + doc
        # Positions rise within a record, but for those of synonyms.
        by = np.lexsort((place, key)) if synonyms else np.argsort(key, kind="stable")
        start = np.flatnonzero(np.diff(key[by], prepend=-1))
        lists = pa.ListArray.from_arrays(np.append(start, len(by)).astype(np.int32), pa.array(place[by].astype(np.int32))) if options.positions and not raw else pa.nulls(len(start), pa.list_(pa.int32()))
        of, sizes, doc = of[by[start]], np.bincount(doc), doc[by[start]]
        tf = np.diff(start, append=len(by)).astype(np.int32)
        posts = [ids.take(pa.array(doc)), pa.array(tf), lists, pa.array(sizes[doc].astype(np.int32))]
        names = ["id", "tf", "positions", "len"]
        if packed:
            first = np.flatnonzero(np.diff(of, prepend=-1))
            first = np.flatnonzero((np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of)))) % BLOCK == 0)
            n = np.diff(first, append=len(of))
            whole = pa.ListArray.from_arrays(np.append(first, len(of)).astype(np.int32), pa.StructArray.from_arrays(posts, names))
            posts, names = [pa.array(n), pa.array(np.add.reduceat(tf, first, dtype=np.int64)), whole], ["df", "total", "posts"]
            of = of[first]
        # By term, so that little is left to sort.
        cols = [pa.array(np.full(len(of), raw)), pa.array(np.full(len(of), field, np.int32)), pa.array(listed, pa.string()).take(pa.array(of))]
        yield pa.RecordBatch.from_arrays([*cols, *posts], names=["surface", "field", "term", *names])


def _postings(options: Options, batches: Iterator[pa.RecordBatch], packed: bool = False) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(len(options.fields)):
            held: tuple[list[str], list[int], list[int], list[np.ndarray]] = ([], [], [], [])
            for row, values in enumerate(b.column(k + 1)):
                base = 0
                for v in values.values or ():
                    found, places, last = words_at(v.as_py())
                    if found:
                        held[0].extend(found)
                        held[1].append(len(found))
                        held[2].append(row)
                        held[3].append(places + base)
                    # One place of a gap, so that no phrase runs across values.
                    base += last + 2
                if len(held[0]) >= _AT_ONCE:
                    yield from _grouped(options, packed, k, b.column(0), *held)
                    held = ([], [], [], [])
            if held[0]:
                yield from _grouped(options, packed, k, b.column(0), *held)


def spread(records: DataFrame) -> DataFrame:
    """Few partitions are dealt anew, as one row group of a file is one task; a large table has enough and stays."""
    n = records.sparkSession.sparkContext.defaultParallelism
    return records.repartition(4 * n) if records.rdd.getNumPartitions() < n * 2 else records


def postings(records: DataFrame, options: Options, packed: bool = False) -> DataFrame:
    """One row for each term of a field of a record: the analysed ones and, if asked for, the surface forms; or blocks of them."""
    ship(records.sparkSession)
    conf = records.sparkSession.conf
    # Ten thousand long texts in a row would be more than a worker may hold.
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 22))
    return spread(records).select("id", *(f"t_{n}" for n in options.names)).mapInArrow(lambda it: _postings(options, it, packed), _BLOCKS if packed else _POSTING)


def _blocks(posts: DataFrame, n_docs: int) -> DataFrame:
    """Blocks of postings of *n_docs* records, BLOCK or so at most."""
    deal = F.pmod(F.xxhash64("id"), F.lit(n_docs // BLOCK + 1))
    made = posts.groupBy("surface", "field", "term", deal.alias("deal")).agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.collect_list(F.struct("id", "tf", "positions", "len")).alias("posts"))
    return made.drop("deal")


@dataclass
class Tables:
    """What queries run on. Stored postings are sorted by term within each file and terms throughout, so a query's terms prune the rest."""

    spark: SparkSession
    options: Options
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    n_docs: int
    totals: dict[tuple[bool, int], int] = field(default_factory=dict)
    snapshot: str = ""


def tables(docs: DataFrame, posts: DataFrame, options: Options, terms: DataFrame | None = None, snapshot: str = "") -> Tables:
    terms = posts.groupBy("surface", "field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")) if terms is None else terms
    totals = {(r[0], r[1]): r[2] for r in terms.groupBy("surface", "field").agg(F.sum("total")).collect()}  # one row a field
    return Tables(docs.sparkSession, options, docs, posts, terms, docs.count(), totals, snapshot)


def build(records: DataFrame, options: Options) -> Tables:
    """Tables of a record frame, for a session: nothing is stored but Spark's own cache."""
    posts = postings(records, options).persist()
    docs = records.select("id", "version", *(f"f_{n}" for n, _ in options.filters))
    return tables(docs, posts, options, snapshot=options.identity()[:16])


class _Files:
    """Small files beside the tables, by Hadoop's file systems so that any path serves."""

    def __init__(self, spark: SparkSession, top: str):
        self.jvm, self.top = spark.sparkContext._jvm, top
        self.fs = self.path(top).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self) -> list[str]:
        at = self.path(self.top)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def numbers(self, kind: str) -> list[int]:
        found = (re.fullmatch(rf"_{kind}-(\d+)\.json", n) for n in self.names())
        return sorted(int(m[1]) for m in found if m)

    def manifest(self, number: int) -> dict:
        stream = self.fs.open(self.path(f"{self.top}/_manifest-{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def latest(self) -> dict | None:
        """The newest manifest: a manifest is there whole or not at all, and never changes."""
        numbers = self.numbers("manifest")
        return self.manifest(numbers[-1]) if numbers else None

    def claim(self, number: int) -> None:
        """Only one writer gets a number."""
        try:
            self.fs.create(self.path(f"{self.top}/_claim-{number:012d}.json"), False).close()
        except Py4JJavaError as e:
            raise SearchError("E_LOCK_BUSY", f"another writer makes snapshot {number}") from e

    def publish(self, value: dict) -> None:
        """Written beside and renamed into its place, which no other manifest has."""
        name = f"_manifest-{value['snapshot']:012d}.json"
        temp = self.path(f"{self.top}/_new-{uuid.uuid4().hex}")
        out = self.fs.create(temp, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not self.fs.rename(temp, self.path(f"{self.top}/{name}")):
            raise SearchError("E_STORAGE", f"can't write {name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.top}/{name}"), True)


def _summed(terms: DataFrame) -> DataFrame:
    return terms.groupBy("surface", "field", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _owner(options: Options) -> dict:
    return {"identity": options.identity(), "snapshot": 0, "payload": None, "segments": [], "dead": []}


class TextReader:
    """A snapshot of a stored index; reload() moves on to the newest."""

    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.files = _Files(spark, self.path)
        if not self.files.numbers("manifest"):
            raise SearchError("E_INDEX_NOT_READY", f"no index at {path}")
        self.reload()

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options) -> TextReader:
        return cls(spark, path, options)

    def reload(self) -> None:
        """The newest snapshot. A writer may clear away the one that is being read, so that is tried again."""
        for wait in (0.001, 0.002, None):
            m = self.files.latest()
            if m["identity"] != self.options.identity():
                raise SearchError("E_IDENTITY_MISMATCH", "the index was made with other options")
            try:
                self.tables = self._tables(m)
            except AnalysisException as e:
                if wait is None:
                    raise SearchError("E_RELOAD_FAILED", "the tables of the snapshot are gone") from e
                time.sleep(wait)
            else:
                self.manifest = m
                return

    def _read(self, kind: str, segments: list[dict], schema: str) -> DataFrame:
        """A table of all segments, with the number of each in seg."""
        out = self.spark.createDataFrame([], f"{schema}, seg string")
        for s in segments:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/seg={s['seg']}/{kind}").withColumn("seg", F.lit(str(s["seg"]))))
        return out

    def _schema(self) -> str:
        return "id string, version string" + "".join(f", `f_{n}` array<{_TYPES[k]}>" for n, k in self.options.filters)

    def _live(self, m: dict, kind: str, schema: str, segments: list[dict] | None = None) -> DataFrame:
        """Rows of documents that no later commit replaced or deleted."""
        rows = self._read(kind, m["segments"] if segments is None else segments, _BLOCKS if kind == "postings" else schema)
        if kind == "postings":
            rows = rows.select("surface", "field", "term", "seg", F.inline("posts"))
        if not m["dead"]:
            return rows
        dead = self.spark.read.schema("id string, seg string").parquet(*(f"{self.path}/dead={n}" for n in m["dead"]))
        return rows.join(dead, ["id", "seg"], "left_anti")

    def _tables(self, m: dict) -> Tables:
        docs, posts = self._live(m, "docs", self._schema()), self._live(m, "postings", _POSTING)
        # Each segment has the terms that it adds, and those of the documents that its commit took away, below zero.
        terms = _summed(self._read("terms", m["segments"], _TERM)).where("df > 0")
        totals: dict[tuple[bool, int], int] = {}
        for s in m["segments"]:
            for raw, k, n in s["totals"]:
                totals[(raw, k)] = totals.get((raw, k), 0) + n
        n_docs = sum(s["docs"] for s in m["segments"])
        return Tables(self.spark, self.options, docs.drop("seg"), posts.drop("seg"), terms, n_docs, totals, f"{m['identity'][:16]}-{m['snapshot']}")

    @property
    def committed_payload(self) -> str | None:
        return self.manifest.get("payload")


class TextIndex(TextReader):
    """The writer: stages changes, and publishes them as the next snapshot.

    A commit writes a segment of the changed documents alone, and the places of those that they replace. Segments
    merge geometrically, so that there are few and each document is rewritten a logarithmic number of times.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.staged: list[tuple[DataFrame | None, DataFrame]] = []
        files = _Files(spark, path.rstrip("/"))
        if not files.numbers("manifest"):
            files.publish(_owner(options))
        super().__init__(spark, path, options)

    def _release(self) -> None:
        """What written plans shuffled isn't read again; its files go once the driver sees that no plan holds them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _write(self, name: str, docs: DataFrame, posts: DataFrame, terms: Callable[[DataFrame], DataFrame]) -> dict:
        """Segment *name*; *terms* gives what it changes in the dictionary, from its stored blocks of postings."""
        at = f"{self.path}/seg={name}"
        docs.write.mode("overwrite").parquet(f"{at}/docs")
        # Each file is by term, so a query reads a page or so of it. Files of few terms would need all postings to be shuffled.
        order = ["term", "surface", "field"]  # sorting looks at the first bytes of the first one, and seldom further
        posts.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/postings")
        self._release()
        change = _summed(terms(self.spark.read.schema(_BLOCKS).parquet(f"{at}/postings")))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        change.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{at}/terms")
        per = self.spark.read.schema(_TERM).parquet(f"{at}/terms").groupBy("surface", "field").agg(F.sum("total")).collect()  # one row a field
        rows = self.spark.read.schema(self._schema()).parquet(f"{at}/docs").count()
        return {"seg": name, "rows": rows, "docs": rows, "totals": [[r[0], r[1], r[2]] for r in per]}

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, rejected_upsert: str = "reject") -> DataFrame:
        """Stage records and ids to delete; returns the rejected records. An id may come once in all.

        Upserts replace what has their id. With rejected_upsert='delete' a rejected record's id is deleted.
        """
        ids = deletes.select(F.col("id").cast("string").alias("id")) if deletes is not None else self.spark.createDataFrame([], "id string")
        if upserts is None:
            self.staged.append((None, ids))
            return self.spark.createDataFrame([], "id string, operation string, code string")
        bad = rejections(upserts, self.options)
        good = upserts.where(_code(self.options).isNull())  # ids come once, so nothing else is rejected with them
        if not upserts.select("id").unionByName(ids).groupBy("id").count().where("count > 1").isEmpty():
            raise invalid("an id may come once in a batch")
        gone = ids.unionByName(good.select("id"))
        if rejected_upsert == "delete":
            gone = gone.unionByName(bad.select("id").where("id is not null"))
        self.staged.append((good, gone))
        return bad

    def commit(self, payload: str | None = None) -> int:
        """Write what is staged as the next snapshot; readers see it once they reload."""
        if payload is None and self.manifest.get("payload") is not None:
            raise SearchError("E_CHECKPOINT_REQUIRED", "this index is published with payloads")
        if payload is not None and len(payload.encode()) > PAYLOAD_BYTES:
            raise SearchError("E_RESOURCE_LIMIT", "a payload may have 64 KiB")
        m = self.files.latest()
        number = max([m["snapshot"], *self.files.numbers("claim")]) + 1
        self.files.claim(number)
        m = m | {"snapshot": number, "payload": payload}
        if self.staged:
            m = self._merged(self._added(m, number))
        self.files.publish(m)
        self.staged.clear()
        self.manifest = m
        return number

    def _added(self, m: dict, number: int) -> dict:
        """The manifest with a segment of what is staged; a later change of an id undoes the earlier ones."""
        fresh, gone = None, None
        for good, ids in self.staged:
            ids = ids.distinct()
            if fresh is not None:
                fresh = fresh.join(ids, "id", "left_anti")
            if good is not None:
                fresh = good if fresh is None else fresh.unionByName(good)
            gone = ids if gone is None else gone.unionByName(ids)
        none = self.spark.createDataFrame([], self._schema() + "".join(f", `t_{n}` array<string>" for n in self.options.names))
        fresh = none if fresh is None else none.unionByName(fresh.select(none.columns))
        # The records are a table while their segment is made, so that what they come from is worked out once.
        at = f"seg={number}/records"
        fresh.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{at}")
        self._release()
        fresh = self.spark.read.schema(fresh.schema).parquet(f"{self.path}/{at}")
        dead = self._live(m, "docs", self._schema()).select("id", "seg").join(gone.distinct(), "id", "left_semi")
        dead.write.mode("overwrite").parquet(f"{self.path}/dead={number}")
        dead = self.spark.read.schema("id string, seg string").parquet(f"{self.path}/dead={number}")
        n_dead = dead.count()
        alone = n_dead == sum(s["docs"] for s in m["segments"])

        def change(new: DataFrame) -> DataFrame:
            plus = new.select("surface", "field", "term", "df", "total")
            if alone or not n_dead:
                return plus
            minus = self._live(m, "postings", _POSTING).join(dead, ["id", "seg"], "left_semi")
            return plus.unionByName(minus.select("surface", "field", "term", F.lit(-1).cast("long").alias("df"), (-F.col("tf")).cast("long").alias("total")))

        docs = fresh.select("id", "version", *(f"f_{n}" for n, _ in self.options.filters))
        seg = self._write(str(number), docs, postings(fresh, self.options, True), change)
        self.files.delete(at)
        if alone:
            # Nothing lives on of the other segments, so the new one is all there is, and its dictionary the whole one.
            return m | {"segments": [seg], "dead": []}
        seg["docs"] -= n_dead
        return m | {"segments": [*m["segments"], seg], "dead": [*m["dead"], *([number] if n_dead else [])]}

    def _merged(self, m: dict) -> dict:
        """The manifest with segments merged from the end while they are less than double; a merge has what lives of them.

        Dictionary changes add up, those that concern documents of other segments too.
        """
        sizes = [s["rows"] for s in m["segments"]]
        k = len(sizes) - 1
        while k > 0 and sizes[k - 1] < 2 * sum(sizes[k:]):
            k -= 1
        if k == len(sizes) - 1:
            return m
        parts = m["segments"][k:]
        docs, posts = self._live(m, "docs", self._schema(), parts).drop("seg"), self._live(m, "postings", _POSTING, parts).drop("seg")
        seg = self._write(f"{m['snapshot']}m", docs, _blocks(posts, sum(sizes[k:])), lambda _: self._read("terms", parts, _TERM).drop("seg"))
        return m | {"segments": [*m["segments"][:k], seg | {"docs": sum(s["docs"] for s in parts)}], "dead": m["dead"] if k else []}

    def clear_away(self, keep: int = 2) -> int:
        """Delete the tables that none of the last *keep* snapshots has; how many were deleted."""
        numbers = self.files.numbers("manifest")
        kept = [self.files.manifest(n) for n in numbers[-keep:]]
        used = {f"seg={s['seg']}" for m in kept for s in m["segments"]} | {f"dead={n}" for m in kept for n in m["dead"]}
        old = [n for n in self.files.names() if n.startswith(("seg=", "dead=")) and n not in used]
        for n in old:
            self.files.delete(n)
        for n in numbers[:-keep]:
            self.files.delete(f"_manifest-{n:012d}.json")
        return len(old)

    def publish(self, payload: str) -> int:
        number = self.commit(payload)
        self.reload()
        self.clear_away()
        return number

    def close(self, mode: str = "require-clean") -> None:
        if mode == "require-clean" and self.staged:
            raise SearchError("E_DIRTY_CLOSE", "changes are staged")
        self.staged.clear()


def inspect_index(spark: SparkSession, path: str, options: Options) -> dict:
    """{state: missing | incompatible | cursorless | checkpointed, payload?} without opening."""
    m = _Files(spark, path.rstrip("/")).latest()
    if m is None:
        return {"state": "missing"}
    if m["identity"] != options.identity():
        return {"state": "incompatible"}
    return {"state": "cursorless"} if m["payload"] is None else {"state": "checkpointed", "payload": m["payload"]}


def reset_index(spark: SparkSession, path: str) -> str | None:
    """Move an index aside; its new place, or None if there is none. What else stands at either place is left alone."""
    files = _Files(spark, path.rstrip("/"))
    if not files.names():
        return None
    if not files.numbers("manifest"):
        raise SearchError("E_INDEX_CORRUPT", f"what stands at {path} is no index")
    reclaim_retired(spark, path)
    to = f"{path.rstrip('/')}{_RETIRED}"
    if not files.fs.rename(files.path(path.rstrip("/")), files.path(to)):
        raise SearchError("E_STORAGE", f"can't move {path}")
    return to


def reclaim_retired(spark: SparkSession, path: str) -> bool:
    """Delete the index that reset_index moved aside, if there is one; nothing but an index is deleted."""
    files = _Files(spark, f"{path.rstrip('/')}{_RETIRED}")
    if not files.names():
        return False
    if not files.numbers("manifest"):
        raise SearchError("E_INDEX_CORRUPT", f"what stands at {files.top} is no index")
    return bool(files.fs.delete(files.path(files.top), True))
