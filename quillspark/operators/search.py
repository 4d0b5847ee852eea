"""Searches over an index: ranked windows, metadata sorts, facets, and authenticated pages."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import math
import os
import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SearchError, invalid
from ..plans.request import request
from ..sources.index import Tables
from .aggregate import aggregate, check
from .match import Matcher

_OWN = os.urandom(32)


def _secret(spark) -> bytes:
    """What seals continuations: the session's spark.quillspark.secret, so that they outlive a driver, or else this process's own."""
    named = spark.conf.get("spark.quillspark.secret", None)
    return hashlib.sha256(named.encode()).digest() if named else _OWN


class Searcher:
    def __init__(self, t: Tables):
        self.t, self.matcher = t, Matcher(t)

    def matches(self, req: dict) -> DataFrame:
        """All matches (id, score) as a DataFrame, for use in larger plans."""
        return self.matcher.matches(request(req, self.t.options.names))

    def _keys(self, sort) -> tuple[list, list[str]]:
        """(what to order by, the columns of docs that it reads)."""
        keys = [sort] if isinstance(sort, dict) else list(sort or [])
        if not keys:
            return [F.desc("score"), F.asc("id")], []
        if len({k["field"] for k in keys}) < len(keys):
            raise invalid("sort fields must be distinct")
        by, needed = [], []
        for k in keys:
            if self.t.options.kinds.get(k["field"]) not in ("string", "number"):
                raise invalid(f"can't sort by {k['field']!r}")
            if k["direction"] not in ("asc", "desc") or k["missing"] not in ("first", "last"):
                raise invalid("a sort is asc or desc, with missing first or last")
            c = F.get(F.col(f"f_{k['field']}"), 0)
            by.append(getattr(c, f"{k['direction']}_nulls_{k['missing']}")())
            needed.append(f"f_{k['field']}")
        return [*by, F.asc("id")], needed

    def _order(self, found: DataFrame, sort) -> DataFrame:
        by, needed = self._keys(sort)
        return (found.join(self.t.docs.select("id", *needed), "id") if needed else found).orderBy(*by)

    def ranked(self, req: dict) -> DataFrame:
        """The asked window as rank (from 0), id, score, version, in order: top rows only are sorted, then hydrated.

        The window has 10,000 rows at most, so it is broadcast to the documents, and one task puts it in order again.
        """
        r = request(req, self.t.options.names)
        by, needed = self._keys(r["sort"])
        top = self._order(self.matcher.matches(r), r["sort"]).offset(r["offset"]).limit(r["limit"]).select("id", "score")
        whole = self.t.docs.select("id", "version", *needed).join(F.broadcast(top), "id")
        place = F.row_number().over(Window.orderBy(*by)) - 1 + r["offset"]
        return whole.select(place.alias("rank"), "id", "score", "version").orderBy("rank")

    def with_metadata(self, req: dict) -> DataFrame:
        """All matches with the metadata columns, for facets."""
        return self.matches(req).join(self.t.docs, "id")

    def search(self, req: dict) -> dict:
        """{total, totalRelation, hits, aggregations?}: a bounded answer on the driver."""
        r = request(req, self.t.options.names)
        check(r["aggregations"], self.t.options.kinds)
        found = self.matcher.matches(r)
        several = bool(r["aggregations"]) or r["exact"] or bool(r["sort"])
        if several:
            found = found.persist()
        try:
            window = r["offset"] + r["limit"]
            top = self._order(found, r["sort"]).select("id", "score").limit(window + 1).collect()
            exact = several or len(top) <= window
            total = len(top) if len(top) <= window else found.count() if several else window
            hits = self._hydrate(top[r["offset"] : window])
            out = {"total": total, "totalRelation": "exact" if exact else "lower-bound", "hits": hits}
            if r["aggregations"]:
                out["aggregations"] = aggregate(found.join(self.t.docs, "id"), r["aggregations"])
            return out
        finally:
            if several:
                found.unpersist()

    def _hydrate(self, rows: list) -> list[dict]:
        """Versions for the winners alone."""
        if any(not math.isfinite(r["score"]) for r in rows):
            raise invalid("a score is beyond the numbers there are: open the index with lower weights")
        ids = [r["id"] for r in rows]
        versions = {r[0]: r[1] for r in self.t.docs.where(F.col("id").isin(ids)).select("id", "version").collect()} if ids else {}
        return [{"id": r["id"], "score": r["score"]} | ({"version": versions[r["id"]]} if versions.get(r["id"]) is not None else {}) for r in rows]

    def _identity(self, req: dict) -> bytes:
        own = {k: v for k, v in req.items() if k not in ("continuation", "limit", "offset", "exactTotal")}
        if own.get("candidateIds") is not None:
            own["candidateIds"] = sorted(set(own["candidateIds"]))
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).digest()

    def _token(self, req: dict, score: float, last: str) -> str:
        body = bytes([3]) + hashlib.sha256(self.t.snapshot.encode()).digest() + struct.pack(">f", score) + last.encode()
        seal = hmac.new(_secret(self.t.spark), body + self._identity(req), hashlib.sha256).digest()
        return base64.urlsafe_b64encode(seal + body).decode().rstrip("=")

    def _after(self, req: dict, token: str) -> tuple[float, str]:
        try:
            raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
        except ValueError:
            raise invalid("no continuation") from None
        seal, body = raw[:32], raw[32:]
        if len(body) < 37 or not hmac.compare_digest(seal, hmac.new(_secret(self.t.spark), body + self._identity(req), hashlib.sha256).digest()):
            raise invalid("the continuation isn't of this request")
        if body[1:33] != hashlib.sha256(self.t.snapshot.encode()).digest():
            raise SearchError("E_CURSOR_EXPIRED", "the index has moved on")
        return struct.unpack(">f", body[33:37])[0], body[37:].decode()

    def search_page(self, req: dict) -> dict:
        """One page after another, in rank order: keyset, so depth costs nothing; continuation is left out on the last."""
        plain = {k: v for k, v in req.items() if k != "continuation"}
        r = request(plain, self.t.options.names, page=True)
        found = self.matcher.matches(r)
        rest = found
        if req.get("continuation"):
            score, last = self._after(req, req["continuation"])
            here = F.lit(score).cast("float")
            rest = found.where((F.col("score") < here) | (F.col("score") == here) & (F.col("id") > last))
        top = self._order(rest, None).limit(r["limit"] + 1).collect()
        page = top[: r["limit"]]
        out = {"total": found.count(), "totalRelation": "exact", "hits": self._hydrate(page)}
        if len(top) > len(page):
            out["continuation"] = self._token(req, page[-1]["score"], page[-1]["id"])
        return out
