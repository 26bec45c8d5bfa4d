"""The guarded surface: validated requests, timed responses, comparison of engines, health."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .functions.text import PYTHON_WHITESPACE, units

MAX_QUERY, DEFAULT_LIMIT, MAX_LIMIT, ROUNDS = 64, 10, 50, 3


class ApiError(Exception):
    """code: invalid_request, not_found, method_not_allowed or internal_error; status: 400, 404, 405 or 500."""

    STATUS = {"invalid_request": 400, "not_found": 404, "method_not_allowed": 405, "internal_error": 500}

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.status = code, self.STATUS[code]

    def body(self) -> dict:
        return {"error": self.code, "message": str(self)}


def valid_query(q: str | None) -> str:
    if q is None:
        raise ApiError("invalid_request", "q is required")
    if len(q.encode("utf-16-le", "surrogatepass")) // 2 > MAX_QUERY:
        raise ApiError("invalid_request", f"q must have at most {MAX_QUERY} characters")
    return q


def valid_limit(limit: Any) -> int:
    try:
        n = int(str(limit))
    except ValueError:
        raise ApiError("invalid_request", "limit must be a number") from None
    if not 1 <= n <= MAX_LIMIT:
        raise ApiError("invalid_request", f"limit must be from 1 to {MAX_LIMIT}")
    return n


def validated(requests: DataFrame) -> DataFrame:
    """A table of requests, with columns q and limit (a string), with what the guards say of each.

    Adds status, 200 or 400, error, message, and checked_limit, which is null if the request is refused.  A null limit is the
    default one.
    """
    limit = F.coalesce(F.trim("limit"), F.lit(str(DEFAULT_LIMIT)))
    number = F.when(limit.rlike(r"\A[+-]?[0-9]{1,9}\z"), F.regexp_replace(limit, r"\A\+", "")).try_cast("int")
    message = (
        F.when(F.col("q").isNull(), "q is required").when(units(F.col("q")) > MAX_QUERY, f"q must have at most {MAX_QUERY} characters")
        .when(number.isNull(), "limit must be a number").when(~number.between(1, MAX_LIMIT), f"limit must be from 1 to {MAX_LIMIT}")
    )
    bad = F.col("message").isNotNull()
    out = requests.withColumn("message", message).withColumn("status", F.when(bad, ApiError.STATUS["invalid_request"]).otherwise(200))
    return out.withColumn("error", F.when(bad, "invalid_request")).withColumn("checked_limit", F.when(~bad, number))


def is_blank(q: str) -> bool:
    return not q.strip(PYTHON_WHITESPACE)


def _timed(run) -> tuple[list[dict], int]:
    began = time.perf_counter()
    rows = [r.asDict() for r in sorted(run().collect(), key=lambda r: r["rank"])]
    return rows, round(1e6 * (time.perf_counter() - began))


def _public(rows: list[dict]) -> list[dict]:
    return [{k: v for k, v in r.items() if k != "rank"} for r in rows]


def search(engine: Engine, q: str | None, limit: Any = DEFAULT_LIMIT, kind: str = "optimized") -> dict:
    """One search's response; a blank query has no results."""
    q, limit = valid_query(q), valid_limit(limit)
    rows, micros = ([], 0) if is_blank(q) else min((_timed(lambda: engine.search(q, limit, kind)) for _ in range(ROUNDS)), key=lambda x: x[1])
    return {"query": q, "engine": kind, "limit": limit, "resultCount": len(rows), "latencyMicros": micros, "results": _public(rows)}


def compare(engine: Engine, q: str | None, limit: Any = DEFAULT_LIMIT) -> dict:
    """Both engines in turns, the best time of each, and whether they agree."""
    q, limit = valid_query(q), valid_limit(limit)
    if is_blank(q):
        return {"query": q, "limit": limit, "optimizedMicros": 0, "naiveMicros": 0, "speedup": 1.0, "identical": True, "optimized": [], "naive": []}
    best: dict[str, tuple[list[dict], int]] = {}
    for _ in range(ROUNDS):
        for kind in ("optimized", "naive"):
            got = _timed(lambda k=kind: engine.search(q, limit, k))
            best[kind] = min(best.get(kind, got), got, key=lambda x: x[1])
    fast, slow = best["optimized"], best["naive"]
    return {"query": q, "limit": limit, "optimizedMicros": fast[1], "naiveMicros": slow[1], "speedup": slow[1] / fast[1], "identical": fast[0] == slow[0], "optimized": _public(fast[0]), "naive": _public(slow[0])}


def health(engine: Engine) -> dict:
    return {"status": "UP"} | engine.stats()


def handle(engine: Engine, method: str, path: str, parameters: dict[str, str]) -> tuple[int, str]:
    """Status and JSON body for a request, errors included."""
    routes = {
        "/api/search": lambda: search(engine, parameters.get("q"), parameters.get("limit", DEFAULT_LIMIT)),
        "/api/search/naive": lambda: search(engine, parameters.get("q"), parameters.get("limit", DEFAULT_LIMIT), "naive"),
        "/api/compare": lambda: compare(engine, parameters.get("q"), parameters.get("limit", DEFAULT_LIMIT)),
        "/api/health": lambda: health(engine),
        "/health": lambda: health(engine),
    }
    try:
        if path not in routes:
            raise ApiError("not_found", f"no such path: {path}")
        if method != "GET":
            raise ApiError("method_not_allowed", f"{method} is not supported")
        return 200, json.dumps(routes[path]())
    except ApiError as e:
        return e.status, json.dumps(e.body())
    except Exception:
        return 500, json.dumps(ApiError("internal_error", "an unexpected error occurred").body())
