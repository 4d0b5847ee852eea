"""Validation of search requests: their shape and their budgets."""

from __future__ import annotations

import math

from ..errors import invalid

#: The modes, and the limits of a request.
MODES = ("any", "all", "phrase", "prefix", "fuzzy", "fuzzy-prefix")
DEPTH, TEXT_BYTES, WINDOW, PREFIX_WINDOW, CANDIDATES, CANDIDATE_BYTES = 8, 65_536, 10_000, 100, 1_024, 1 << 20
TERMS, CLAUSES, EXPANSIONS, FUZZY_TERMS, FUZZY_UNITS, PHRASE_POSITIONS = 64, 256, 50, 16, 256, 16_384
_KEYS = {"and": "clauses", "or": "clauses", "not": "clause", "boost": "clause", "optional": "required"}
_LEAF = {"text", "mode", "operator", "fields", "fuzzyDistance", "fuzzyTranspositions"}


def is_leaf(expr: dict) -> bool:
    return "text" in expr


def leaf(expr: dict, fields: list[str]) -> dict:
    """A clause with all options filled in."""
    if set(expr) - _LEAF:
        raise invalid(f"unknown keys {sorted(set(expr) - _LEAF)}")
    if not isinstance(expr["text"], str):
        raise invalid("text must be a string")
    if "mode" in expr and "operator" in expr:
        raise invalid("mode excludes operator")
    mode = expr.get("mode") or expr.get("operator") or "any"
    if mode not in MODES:
        raise invalid(f"unknown mode {mode!r}")
    if ("fuzzyDistance" in expr or "fuzzyTranspositions" in expr) and "fuzzy" not in mode:
        raise invalid("fuzzy options need a fuzzy mode")
    distance = expr.get("fuzzyDistance", 1)
    if distance not in (0, 1, 2):
        raise invalid("fuzzyDistance is 0, 1 or 2")
    asked = expr.get("fields") or fields
    if len(set(asked)) < len(asked) or set(asked) - set(fields):
        raise invalid("fields must be distinct and configured")
    return {"text": expr["text"], "mode": mode, "fields": list(asked), "distance": distance, "swaps": expr.get("fuzzyTranspositions", True)}


def normalize(expr: dict, fields: list[str], depth: int = 0) -> dict:
    """The expression as a checked tree of {op, ...} nodes."""
    if depth > DEPTH:
        raise invalid(f"a query may be nested {DEPTH} deep")
    if is_leaf(expr):
        return {"op": "leaf", **leaf(expr, fields)}
    op = expr.get("operator")
    if op not in _KEYS:
        raise invalid(f"unknown operator {op!r}")
    allowed = {"operator", _KEYS[op]} | ({"boost"} if op == "boost" else set()) | ({"optional"} if op == "optional" else set())
    if set(expr) - allowed or _KEYS[op] not in expr:
        raise invalid(f"{op} takes {sorted(allowed)}")
    down = lambda e: normalize(e, fields, depth + 1)
    if op in ("and", "or"):
        if not expr["clauses"]:
            raise invalid(f"{op} needs clauses")
        return {"op": op, "of": [down(e) for e in expr["clauses"]]}
    if op == "optional":
        if not expr.get("optional"):
            raise invalid("optional needs clauses")
        return {"op": op, "required": down(expr["required"]), "of": [down(e) for e in expr["optional"]]}
    if op == "boost":
        by = expr.get("boost")
        if not isinstance(by, (int, float)) or isinstance(by, bool) or not 0 <= by <= 100 or math.copysign(1, by) < 0:
            raise invalid("a boost is 0 to 100")
        return {"op": op, "boost": float(by), "of": [down(expr["clause"])]}
    return {"op": op, "of": [down(expr["clause"])]}


def leaves(node: dict) -> list[dict]:
    if node["op"] == "leaf":
        return [node]
    return [x for c in [*([node["required"]] if "required" in node else []), *node["of"]] for x in leaves(c)]


def request(req: dict, fields: list[str], page: bool = False) -> dict:
    """A whole request: tree, candidates, window."""
    if ("query" in req) == ("text" in req):
        raise invalid("a request has text or query")
    simple = {k: req[k] for k in _LEAF if k in req}
    if "query" in req and simple:
        raise invalid("query excludes simple options")
    tree = normalize(req.get("query") or simple, fields)
    if sum(len(x["text"].encode()) for x in leaves(tree)) > TEXT_BYTES:
        raise invalid("query texts may have 64 KiB")
    ids = req.get("candidateIds")
    if ids is not None and (len(ids) > CANDIDATES or sum(len(i.encode()) for i in ids) > CANDIDATE_BYTES or any(not i for i in ids)):
        raise invalid("candidateIds are at most 1,024 and 1 MiB")
    offset, limit = req.get("offset") or 0, req.get("limit", 20)
    if offset < 0 or limit < 1 or offset + limit > WINDOW:
        raise invalid(f"a window ends at {WINDOW}")
    prefixed = any("prefix" in x["mode"] for x in leaves(tree))
    if prefixed and not page and (offset or limit > PREFIX_WINDOW):
        raise invalid("prefix modes take offset 0 and a limit of 100")
    if page and (offset or req.get("sort") or req.get("aggregations")):
        raise invalid("paging takes no offset, sort or aggregations")
    return {"tree": tree, "ids": None if ids is None else sorted(set(ids)), "filter": req.get("filter"), "offset": offset, "limit": limit, "sort": req.get("sort"), "aggregations": req.get("aggregations") or [], "exact": bool(req.get("exactTotal"))}
