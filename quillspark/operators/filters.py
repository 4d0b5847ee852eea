"""Metadata filters as two-valued predicates over array columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import invalid

LEAVES, DEPTH = 256, 8
_RANGE = {"lt": lambda x, v: x < v, "le": lambda x, v: x <= v, "gt": lambda x, v: x > v, "ge": lambda x, v: x >= v}


def _value(kind: str, v):
    good = {"string": isinstance(v, str), "number": isinstance(v, (int, float)) and not isinstance(v, bool), "boolean": isinstance(v, bool)}[kind]
    if not good or kind == "number" and not math.isfinite(v):
        raise invalid(f"a {kind} filter can't be compared with {v!r}")
    return F.lit(float(v) + 0.0 if kind == "number" else v)


def compile_filter(expr: dict, kinds: dict[str, str], depth: int = 0, count: list[int] | None = None) -> Column:
    """A Boolean column that is never null; columns of *kinds* hold arrays, null or empty ones being missing."""
    count = [0] if count is None else count
    if depth > DEPTH:
        raise invalid(f"filters may be nested {DEPTH} deep")
    op = expr.get("operator")
    if op == "not":
        return ~compile_filter(expr["clause"], kinds, depth + 1, count)
    if op in ("and", "or"):
        if not 1 <= len(expr["clauses"]) <= LEAVES:
            raise invalid(f"{op} takes 1 to {LEAVES} clauses")
        parts = [compile_filter(c, kinds, depth + 1, count) for c in expr["clauses"]]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
    if op is not None:
        raise invalid(f"unknown filter operator {op!r}")
    count[0] += 1
    if count[0] > LEAVES:
        raise invalid(f"a filter may have {LEAVES} comparisons")
    field, how = expr["field"], expr["comparator"]
    if field not in kinds:
        raise invalid(f"{field!r} is no filter field")
    kind, col = kinds[field], F.col(f"f_{field}")
    if how in ("exists", "missing"):
        if "value" in expr:
            raise invalid(f"{how} takes no value")
        there = F.coalesce(F.size(col), F.lit(0)) > 0
        return there if how == "exists" else ~there
    value = expr["value"]
    if how == "equals":
        test = F.array_contains(col, _value(kind, value))
    elif how == "in":
        if not 1 <= len(value) <= LEAVES:
            raise invalid(f"in takes 1 to {LEAVES} values")
        test = F.arrays_overlap(col, F.array(*(_value(kind, v) for v in value)))
    elif how in _RANGE or how == "between":
        if kind != "number":
            raise invalid(f"{how} is for numbers")
        if how == "between":
            lo, hi = (_value(kind, v) for v in value)
            test = F.exists(col, lambda x: (x >= lo) & (x <= hi))
        else:
            bound = _value(kind, value)
            test = F.exists(col, lambda x: _RANGE[how](x, bound))
    else:
        raise invalid(f"unknown comparator {how!r}")
    return F.coalesce(test, F.lit(False))
