"""Personal data: fixed seed patterns, then contextual patterns bootstrapped from what the seeds mark."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import arrow_map, chunks, drop, keyed, stash

#: The seed kinds in the order in which equal starts are listed, the base ones first; learned spans come after them.
KINDS = ("email", "ip", "card", "phone", "secret", "learned")
BASE = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Published forms of credentials, and names that a value is given to as a credential.
_ISSUED = re.compile(r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[opsru]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})(?![0-9A-Za-z])")
_GIVEN = re.compile(r"[=:]\s?[\"']?([^\s\"',;<>()]{8,})")
_NAMED = re.compile(r"(?:api[_-]?key|access[_-]?key|private[_-]?key|secret|token|passwd|password|pwd)[\"']?\s?$", re.IGNORECASE)
#: An instance has six characters or more without its edges: groups of letters and digits with single spaces between them,
#: an unspaced run that holds a digit, what stands in quotes without a space, or what follows an equals sign.
_THING = re.compile(r"(?<![0-9A-Za-z])[A-Z]{0,2}[0-9]{2,6}(?: [0-9A-Z]{2,6}){2,}(?![0-9A-Za-z])|[^\s|]*[0-9][^\s|]*|(?<=[\"'=])[^\s\"'=]{6,}(?=[\"']|(?<==)\S|\s)")
_EDGE = "\"'`()[]{}<>,;:.!?*#$%&|"
#: A word of more characters stands in a pattern by its digest.
LONG = 64


def _bare(digits: str) -> str:
    return digits.lstrip("0")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each seed entity, leftmost and non-overlapping within its kind, sorted."""
    out: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in map(_bare, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    out.sort()
    return out


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of credentials by their issuers' forms or by the name that they are given to; more seeds of patterns."""
    out = [(m.start(), BASE, m.end()) for m in _ISSUED.finditer(text)]
    for m in _GIVEN.finditer(text):
        if _NAMED.search(text[max(0, m.start() - 16) : m.start()]) and any(c.isdigit() for c in m[1]):
            out.append((m.start(1), BASE, m.end(1)))
    return sorted(set(out))


def _shape(word: str) -> str:
    """A coarse class: runs of digits, letters and the rest, so that no pattern names a person."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", word))


def _word(word: str) -> str:
    """A word of a pattern: case and edge marks aside, but for a word of marks; whole, however long it is."""
    w = word.strip(_EDGE).lower() or word
    w = _shape(w) if any(c.isdigit() for c in w) else w
    return w if len(w) <= LONG else hashlib.blake2b(w.encode(), digest_size=16).hexdigest()


def instances(text: str, found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str, bool, list[str]]]:
    """(start, end, value, seeded, patterns) of each identifier-like run of the text, and of the seeds *found* (sorted).

    Patterns are the two words before it, and these with what follows. A word that goes on into the run, or out of it,
    is a word of the pattern as far as it is outside. Both lists are read once, side by side.
    """
    places = [(s, e, True) for s, _, e in found]
    upto, at = 0, 0
    for m in _THING.finditer(text):
        raw = m.group()
        s = m.start() + len(raw) - len(raw.lstrip(_EDGE))
        e = m.end() - (len(raw) - len(raw.rstrip(_EDGE)))
        while at < len(found) and found[at][0] < e:
            upto = max(upto, found[at][2])
            at += 1
        if e - s >= 6 and upto <= s:
            places.append((s, e, False))
    if not places:
        return
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    starts = [s for s, _ in words]
    for s, e, seeded in places:
        k = bisect_right(starts, s) - 1
        before = [text[x:y] for x, y in words[max(0, k - 2) : k]] + ([text[starts[k] : s]] if starts[k] < s else [])
        j = bisect_right(starts, e - 1) - 1
        after = text[e : words[j][1]] or (text[slice(*words[j + 1])] if j + 1 < len(words) else "")
        left = " ".join(map(_word, before[-2:]))
        yield s, e, text[s:e], seeded, [left, f"{left} _ {_word(after)}"]


_PASS = "_id long, _th long, doc_id long, base array<struct<start:int,kind:int,end:int>>, base_sha256 string, occ array<struct<start:int,end:int,value:string,seeded:boolean,patterns:array<string>>>"


def _write(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def apart(spans: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of *spans* that touch none of *found* and none of their own before them; both are sorted."""
    out, upto, at = [], 0, 0
    for s, k, e in spans:
        while at < len(found) and found[at][0] < e:
            upto, at = max(upto, found[at][2]), at + 1
        if upto <= s:
            out.append((s, k, e))
            upto = e
    return out


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one reading of the texts: seed spans, and the identifier-like runs with their patterns."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    run = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("seeded", pa.bool_()), ("patterns", pa.list_(pa.string()))]))
    for b in chunks(batches):
        base, sha, occ = [], [], []
        for text in b.column(3).to_pylist():
            found = seeds(text)
            sha.append(hashlib.sha256(_write(found).encode()).hexdigest())
            found = sorted([*found, *apart(secrets(text), found)])
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            occ.append([{"start": s, "end": e, "value": hashlib.blake2b(v.encode(), digest_size=8).hexdigest(), "seeded": known, "patterns": p} for s, e, v, known, p in instances(text, found)])
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(base, span), pa.array(sha), pa.array(occ, run)], names=["_id", "_th", "doc_id", "base", "base_sha256", "occ"])


def learn(read: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """Learned spans (_id, _th, start, end) of identifiers that the seed patterns miss.

    Seeds and other identifier-like runs are the instances, the words around them the patterns. In each round a
    pattern's score is the mean score of its distinct instances, shrunk by one unbelieved instance; a non-seed
    instance takes the score of its best pattern that has *support* distinct instances, seeds among them.
    After the last round instances at or above *confidence* are spans. Patterns and instances meet in
    aggregates alone; a hot pattern is summed before the shuffle.
    """
    occ = read.select("_id", "_th", F.explode("occ").alias("o")).select("_id", "_th", "o.*")
    edges = stash(occ.select("value", "seeded", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("seeded").alias("seeded")), "pii-edges")
    score = edges.groupBy("value").agg(F.max(F.col("seeded").cast("double")).alias("score"))
    old = stash(score, "pii-scores")
    for _ in range(rounds):
        patterns = edges.join(old, "value").groupBy("pattern").agg(F.sum("score").alias("hit"), F.count("*").alias("n"))
        good = patterns.where(f"n >= {int(support)} and hit > 0").select("pattern", (F.col("hit") / (F.col("n") + 1)).alias("trust"))
        fresh = edges.join(good, "pattern").groupBy("value").agg(F.max("trust").alias("trust"))
        new = old.join(fresh, "value", "left").select("value", F.when(F.col("score") >= 1, 1.0).otherwise(F.coalesce("trust", F.lit(0.0))).alias("score"))
        new = stash(new, "pii-scores")
        drop(old)
        old = new
    drop(edges)
    good = old.where(F.col("score") >= confidence).select("value")
    return occ.where("not seeded").join(good, "value", "left_semi").select("_id", "_th", "start", "end").distinct()


def find_pii(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """Personal data in each row's whole text: doc_id, counts by kind, base_sha256, spans, n_spans, n_secret, n_learned.

    Seed spans stay as found: the base kinds, and credentials that touch none of these, of kind 'secret'. Learned ones, of
    kind 'learned', never overlap them. Offsets are code points, ends
    exclusive. A null text counts as empty and has no spans; rows that repeat id and text get equal results.
    Null ids stay null; other columns are ignored; an empty table gives an empty result. A very long text is read
    once, in time that grows with its length alone; so is a word of any length in a pattern.
    """
    read = stash(arrow_map(keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long")), _pass, _PASS), "pii-pass")
    more = learn(read, rounds, confidence, support).groupBy("_id", "_th").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("learned")).alias("kind"), "end")).alias("more"))
    out = read.drop("occ").join(more, ["_id", "_th"], "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    names = F.array(*map(F.lit, KINDS))
    spell = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"]))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE + 1)]
    learned = F.coalesce(F.size("more"), F.lit(0)).cast("long")
    return out.select("doc_id", *counts[:BASE], "base_sha256", F.array_join(spell, ",").alias("spans"), (F.size("base") + learned).alias("n_spans"), counts[BASE], learned.alias("n_learned"))
