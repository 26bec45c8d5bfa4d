"""Plan choice: short circuit, progressive relaxation and indexed against scan plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.score import budget_of
from ..operators.rank import best_first, top_k
from ..operators.search import RESULT, fuzzy_hits, key_of, prefix_hits_of, scored

#: Up to this budget the segments of a single query are few and long enough to be worth a lookup.
INDEXED_BUDGET = 1


def use_index(edits: int) -> bool:
    return edits <= INDEXED_BUDGET


def relax(prefix_hits: DataFrame, limit: int, edits: int, candidates: Callable[[int], DataFrame]) -> DataFrame:
    """Prefix hits alone if they fill the page or no edits are allowed; else candidates(1), candidates(2) ... are
    added until it is full. The candidate plans of later budgets aren't built before they are needed."""
    n = prefix_hits.limit(max(limit, 0)).count()
    found = prefix_hits
    for most in range(1, edits + 1):
        if n >= limit:
            break
        more = candidates(most)
        found = prefix_hits.unionByName(more)
        n = found.select("normalized").distinct().limit(max(limit, 0)).count()
    return found


def search(corpus: DataFrame, q: str, limit: int, fuzzy: Callable[[str, int], DataFrame] | None = None, units: bool = False, top: int | None = None) -> DataFrame:
    """Combined search for one query; fuzzy(q, edits) finds candidates, by default by a scan."""
    key, order = key_of(q), best_first(in_units=units)
    prefix = prefix_hits_of(corpus, key)
    if limit <= 0:
        return top_k(scored(prefix, corpus, top), 0, order).select(*RESULT)
    find = fuzzy or (lambda own, most: fuzzy_hits(corpus, key_of(own), most, units=units))
    hits = relax(prefix, limit, budget_of(q), lambda most: find(q, most).where(~F.col("normalized").startswith(key)))
    return top_k(scored(hits, corpus, top), limit, order).select(*RESULT)
