"""Match tracing: which values of given records match a request, where, and in what snippets."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import invalid
from ..functions.analysis import Token, analyze, both, edits, fuzzy_eligible, query_terms, surface
from ..plans.request import request
from ..ship import ship
from ..sources.index import Options, spread

#: Records, bytes of text and spans of a page; tokens of a value, tokens and values of a record, and tokens
#: that clauses may look at in a page.
RECORDS, TEXT_BYTES, SPANS = 100, 1 << 20, 1024
VALUE_TOKENS, RECORD_TOKENS, VALUES, WORK = 262_144, 524_288, 4_096, 8_388_608
_UNSUPPORTED = ("filter", "offset", "limit", "sort", "aggregations", "exactTotal", "continuation")

Values = dict[str, list[str]]
Spans = dict[tuple[str, int], set[tuple[int, int]]]
#: Whether a record matches; None: what could be looked at doesn't tell.
Known = bool | None


@dataclass
class Source:
    """One value of a record as tokens. *cut*: it has more tokens than may be looked at."""

    name: str
    place: int
    tokens: list[Token]
    raw: list[Token]
    cut: bool = False


@dataclass
class Sources:
    """A record's values, the fields of which some weren't read, and the tokens that clauses may still look at (None: all)."""

    read: list[Source]
    unread: set[str]
    work: int | None = None
    complete: bool = True

    def spend(self, v: Source, raw: bool) -> bool:
        if self.work is None:
            return True
        cost = len(v.tokens) + (len(v.raw) if raw else 0)
        if cost > self.work:
            self.complete = False
            return False
        self.work -= cost
        return True


def sources(values: Values, options: Options, work: int | None = None) -> Sources:
    """The record's values analysed, with *work* under the limits of a record."""
    synonyms, out, left = dict(options.synonyms), Sources([], set(), work), RECORD_TOKENS
    for n in options.names:
        for k, text in enumerate(values.get(n, [])):
            if work is not None and (len(out.read) == VALUES or (left <= 0 and text)):
                out.unread.add(n)
                continue
            shown, tokens, _ = both(text, options.stop_words, synonyms)
            v = Source(n, k, tokens, shown)
            if work is not None:
                most = min(VALUE_TOKENS, left)
                v.cut = len(v.tokens) > most or len(v.raw) > most
                v.tokens, v.raw = v.tokens[:most], v.raw[:most]
                left -= max(len(v.tokens), len(v.raw))
            out.read.append(v)
    return out


def _near(term: str, token: str, node: dict, prefix: bool) -> bool:
    if not fuzzy_eligible(term) or node["distance"] == 0:
        return False
    return edits(term, token, node["swaps"], prefix) <= node["distance"]


def _leaf(node: dict, record: Sources, options: Options, negated: bool) -> tuple[Known, Spans]:
    """(whether the record matches the clause, its spans): membership is of all its values together."""
    mode, stop, spans = node["mode"], options.stop_words, {}
    whole = surface(node["text"], True) if "prefix" in mode else []
    if "prefix" in mode and (not whole or node["text"][-1:].isspace()):
        return _leaf(node | {"mode": "all"}, record, options, negated)
    raw = "fuzzy" in mode or "prefix" in mode
    unknown = bool(record.unread & set(node["fields"]))
    seen: list[Source] = []
    for v in record.read:
        if v.name in node["fields"]:
            if record.spend(v, raw):
                seen.append(v)
                unknown = unknown or v.cut
            else:
                unknown = True

    def mark(v: Source, start: int, end: int) -> None:
        spans.setdefault((v.name, v.place), set()).add((start, end))

    if mode in ("any", "all"):
        terms, met = query_terms(node["text"], stop), set()
        for v in seen:
            for t in v.tokens:
                if t.term in terms:
                    met.add(t.term)
                    mark(v, t.start, t.end)
        found = bool(terms) and (bool(met) if mode == "any" else len(met) == len(terms))
        unknown = unknown and bool(terms)
    elif mode == "phrase":
        placed = [(t.term, t.position) for t in analyze(node["text"], stop)]
        for v in seen if placed else ():
            at: dict[tuple[str, int], Token] = {(t.term, t.position): t for t in v.tokens}
            for (term, position), t in at.items():
                if term == placed[0][0]:
                    run = [at.get((x, position + p - placed[0][1])) for x, p in placed]
                    if all(run):
                        mark(v, t.start, run[-1].end)
        found = bool(spans)
        unknown = unknown and bool(placed)
    elif mode == "fuzzy":
        found = False
        pairs = [(s, a[0].term) for s in dict.fromkeys(t.term for t in surface(node["text"])) if len(a := analyze(s, stop)) == 1]
        for v in seen:
            shown = {t.position: t.term for t in v.raw}
            for t in v.tokens:
                for s, term in pairs:
                    if t.term == term or fuzzy_eligible(s) and (_near(term, t.term, node, False) or not negated and _near(s, shown.get(t.position, ""), node, False)):
                        found = found or t.term == term or _near(term, t.term, node, False)
                        mark(v, t.start, t.end)
    else:
        last = whole[-1].term
        done = list(dict.fromkeys(t.term for t in analyze(node["text"], stop) if t.position < whole[-1].position))
        met, hit = set(), False
        for v in seen:
            for t in v.tokens:
                if t.term in done:
                    met.add(t.term)
                    mark(v, t.start, t.end)
            for t in v.raw:
                if t.term.startswith(last) or mode == "fuzzy-prefix" and _near(last, t.term, node, True):
                    hit = True
                    mark(v, t.start, t.end)
        found = hit and len(met) == len(done)
    return (True if found else None if unknown else False), spans if found else {}


def _merge(parts: list[Spans]) -> Spans:
    out: Spans = {}
    for p in parts:
        for key, s in p.items():
            out.setdefault(key, set()).update(s)
    return out


def evaluate(node: dict, record: Sources, options: Options, negated: bool = False) -> tuple[Known, Spans]:
    """Membership of a tree in three values, and the spans of the branches that match; what is under a NOT has none.

    One branch that fails an AND, or that meets an OR, decides it whatever the unknown ones are.
    """
    op = node["op"]
    if op == "leaf":
        return _leaf(node, record, options, negated)
    if op == "optional":
        need, spans = evaluate(node["required"], record, options, negated)
        parts = [evaluate(c, record, options, negated) for c in node["of"]]
        return need, _merge([spans, *(s for f, s in parts if f)]) if need else {}
    parts = [evaluate(c, record, options, negated != (op == "not")) for c in node["of"]]
    if op == "not":
        found = parts[0][0]
        return (None if found is None else not found), {}
    if op == "boost":
        return parts[0]
    met = {f for f, _ in parts}
    decisive = op == "or"
    found = decisive if decisive in met else None if None in met else not decisive
    return found, _merge([s for f, s in parts if f]) if found else {}


def _utf16(text: str) -> list[int]:
    """For each code point place, its place in UTF-16 units."""
    out = [0]
    for c in text:
        out.append(out[-1] + (2 if ord(c) > 0xFFFF else 1))
    return out


def snippets(text: str, spans: list[tuple[int, int]], length: int = 160, most: int = 3) -> list[dict]:
    """Windows of about *length* UTF-16 units with a span in the middle, unless an earlier one holds them; pairs of units stay whole.

    *spans* are in code points; those of a window are clipped to it and count from its start.
    """
    units = _utf16(text)
    total, out = units[-1], []
    marked = [(units[a], units[b]) for a, b in spans]
    for a, b in marked:
        if len(out) == most:
            break
        start = max(0, a - (length - (b - a)) // 2)
        end = min(total, start + length)
        start = max(0, end - length)
        # Code points that the window cuts belong to it.
        lo, hi = bisect_right(units, start) - 1, bisect_left(units, end)
        if not any(x <= lo and hi <= y for x, y in out):
            out.append((lo, hi))
    return [{"text": text[x:y], "start": units[x], "spans": [{"start": max(a, units[x]) - units[x], "end": min(b, units[y]) - units[x]} for a, b in marked if a < units[y] and b > units[x]]} for x, y in out]


def trace_values(tree: dict, values: Values, options: Options, opts: dict | None = None, work: int | None = None) -> tuple[Known, list[dict], Sources]:
    """(membership, the matching values, what was read) of one record."""
    opts = opts or {}
    record = sources(values, options, work)
    found, spans = evaluate(tree, record, options)
    out = []
    for n in options.names if found else ():
        for k, text in enumerate(values.get(n, [])):
            got = sorted(spans.get((n, k), ()))
            if got:
                units = _utf16(text)
                value = {"field": n, "valueIndex": k, "spans": [{"start": units[a], "end": units[b]} for a, b in got]}
                if opts.get("snippets"):
                    value["fragments"] = snippets(text, got, opts.get("fragmentLength", 160), opts.get("maxFragmentsPerValue", 3))
                out.append(value)
    return found, out, record


def trace_record(tree: dict, values: Values, options: Options, opts: dict | None = None) -> list[dict] | None:
    """The matching values of one record, or None if it doesn't match; without limits."""
    found, out, _ = trace_values(tree, values, options, opts)
    return out if found else None


def _checked(req: dict, options: Options, opts: dict | None) -> dict:
    if any(k in req for k in _UNSUPPORTED):
        raise invalid(f"tracing takes none of {_UNSUPPORTED}")
    if opts and not (32 <= opts.get("fragmentLength", 160) <= 512 and 1 <= opts.get("maxFragmentsPerValue", 3) <= 5):
        raise invalid("fragments have 32 to 512 units, and a value 1 to 5 of them")
    return request(req, options.names)


def _lists(fields: dict) -> Values:
    return {n: [v] if isinstance(v, str) else list(v) for n, v in fields.items()}


def trace_page(req: dict, records: list[dict], options: Options, opts: dict | None = None) -> dict:
    """{complete, records, nextRecord, states} for as many whole records as the limits allow.

    A record that doesn't fit is left for the next page; one that alone is too large is cut and counted as done. Its
    membership is None where the part that was read doesn't decide it.
    """
    if len(records) > RECORDS or sum(len(t.encode()) for r in records for vs in _lists(r["fields"]).values() for t in vs) > TEXT_BYTES:
        raise invalid("a trace takes 100 records and 1 MiB")
    r = _checked(req, options, opts)
    out, states, left, work, complete = [], [], SPANS, WORK, True
    for at, rec in enumerate(records):
        asked = r["ids"] is None or rec["id"] in r["ids"]
        found, values, read = trace_values(r["tree"], _lists(rec["fields"]), options, opts, work) if asked else (False, [], Sources([], set(), work))
        n = sum(len(v["spans"]) for v in values)
        if states and (n > left or not read.complete):
            return {"complete": False, "records": out, "nextRecord": at, "states": states}
        if n > left:
            over = left
            for v in values:
                v["spans"] = v["spans"][:over]
                over -= len(v["spans"])
            values = [v for v in values if v["spans"]]
        analysed = read.complete and not read.unread and not any(v.cut for v in read.read)
        complete = complete and analysed and n <= left
        states.append({"membership": found, "analysisComplete": analysed, "spansComplete": analysed and n <= left})
        stop = n > left or not read.complete
        left, work = left - min(n, left), read.work
        if found:
            out.append({"id": rec["id"], "values": values})
        if stop:
            return {"complete": False, "records": out, "nextRecord": at + 1, "states": states}
    return {"complete": complete, "records": out, "nextRecord": len(records), "states": states}


def trace_matches(req: dict, records: list[dict], options: Options, opts: dict | None = None) -> dict:
    page = trace_page(req, records, options, opts)
    return {"complete": page["complete"], "records": page["records"]}


_SPAN = "array<struct<start:int,end:int>>"


def _trace_batches(tree: dict, options: Options, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        rows = []
        for k, i in enumerate(b.column(0).to_pylist()):
            values = {n: b.column(j + 1)[k].as_py() or [] for j, n in enumerate(options.names)}
            rows += [(i, v["field"], v["valueIndex"], v["spans"]) for v in trace_record(tree, values, options) or []]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), kind), strict=True)], names=["id", "field", "value_index", "spans"])


def trace_frame(req: dict, records: DataFrame, options: Options) -> DataFrame:
    """The spans of a whole record frame, in parallel and without limits: id, field, value_index, spans (UTF-16)."""
    r = _checked(req, options, None)
    ship(records.sparkSession)
    return spread(records).select("id", *(f"t_{n}" for n in options.names)).mapInArrow(lambda it: _trace_batches(r["tree"], options, it), f"id string, field string, value_index int, spans {_SPAN}")
