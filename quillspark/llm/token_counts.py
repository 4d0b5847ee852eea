"""Token counts: pieces once per distinct pre-token, joined to each document's pre-token frequencies."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import arrow_map, chunks, cut_off, stash

#: Distinct pre-tokens that a task sums up before it sends them on.
TABLE = 400_000
#: Pre-tokens of most occurrences that are broadcast at most with their pieces, and characters up to which one stands for itself
#: there; longer ones go by a digest. So what is broadcast has a bound, and no other pre-token is in more than one of HEAD occurrences.
HEAD, SHORT = 131_072, 64


def pretokens(text: str) -> list[str]:
    """Split so that no piece of the vocabulary crosses a cut: before each run of spaces.

    Each item but a last blank one is what the library turns into the run's space marks and its word, as it
    puts one mark before a text itself: a run of m spaces and a word gives m - 1 spaces and the word. Blank
    texts stand for themselves behind a mark, which no other item has.
    """
    if not text:
        return []
    if not text.strip(" ▁"):
        return ["▁" + text]
    if "▁" in text:
        text = text.replace("▁", " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, gap = [], 0
    for p in parts:
        if p:
            out.append(" " * gap + p)
            gap = 0
        else:
            gap += 1
    if gap and text:
        out.append(" " * gap)  # only marks follow; shortened by one when counted
    return out


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens with their occurrences, summed within the task as far as memory allows."""
    seen: Counter = Counter()

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])

    for b in chunks(batches):
        for t in b.column(0).to_pylist():
            seen.update(pretokens(t))
        if len(seen) > TABLE:
            yield send()
            seen.clear()
    yield send()


def _pieces(model: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pieces the library makes of each pre-token."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for b in batches:
        # A run of m spaces at the end of a text has one mark less than the library would put for it alone.
        texts = [u[1:] if u.startswith("▁") or not u.strip(" ") else u for u in b.column(0).to_pylist()]
        n = [len(x) for x in library.encode(texts, num_threads=1)]
        n = [1 if not t else k for t, k in zip(texts, n, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["unit", "n", "pieces"])


def _key(unit: str) -> str:
    return unit if len(unit) <= SHORT else "\0" + hashlib.md5(unit.encode(), usedforsecurity=False).hexdigest()


def _count(head: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document with the pieces of its frequent pre-tokens, and one for each other pre-token that it has."""
    row = TaskContext.get().partitionId() << 33
    for b in chunks(batches):
        rows, ids, sizes, known, units, n = [], [], [], [], [], []
        for i, text, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            total = 0
            for u, k in Counter(pretokens(text)).items():
                p = head.get(_key(u))
                if p is None:
                    for c, x in zip((rows, ids, sizes, known, units, n), (row, None, None, None, u, k), strict=True):
                        c.append(x)
                else:
                    total += k * p
            for c, x in zip((rows, ids, sizes, known, units, n), (row, i, size, total, None, None), strict=True):
                c.append(x)
            row += 1
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((rows, ids, sizes, known, units, n), kinds, strict=True)], names=["rid", "doc_id", "n_bytes", "known", "unit", "n"])


def token_counts(docs: DataFrame, model: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row's whole text under the sentencepiece model at path *model*.

    All distinct pre-tokens are a table, each counted once by the library. A document's frequencies are joined to
    it and summed, no id list of a document being built: the *head* most frequent pre-tokens where the document is,
    the others by a shuffled join, in which none is hot. Null and empty texts count 0, very long ones are read like others;
    repeated rows and null ids give a row each; an empty table gives an empty result.
    """
    with open(model, "rb") as f:
        data = f.read()
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(data)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    units = arrow_map(rows.select("text"), _distinct, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    table = stash(arrow_map(units, lambda it: _pieces(shared.value, it), "unit string, n long, pieces long"), "token-pieces")
    key = F.when(F.length("unit") <= SHORT, F.col("unit")).otherwise(F.concat(F.lit("\0"), F.md5("unit")))
    top = table.where(F.col("n") >= cut_off(table, "n", head))
    frequent = sc.broadcast({r[0]: r[1] for r in top.select(key.alias("key"), "pieces").toLocalIterator()})
    found = stash(arrow_map(rows, lambda it: _count(frequent.value, it), "rid long, doc_id long, n_bytes long, known long, unit string, n long"), "token-rest")
    rest = found.where("unit is not null").select("rid", "unit", "n").join(table.select("unit", "pieces"), "unit")
    rest = rest.groupBy("rid").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    out = found.where("unit is null").join(rest, "rid", "left")
    return out.select("doc_id", "n_bytes", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))
