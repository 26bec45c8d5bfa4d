"""Edit budgets and relevance scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PYTHON_WHITESPACE, strip, units

#: The weights of the two parts of a score.
QUALITY, POPULARITY = 0.7, 0.3
PREFIX, FUZZY = "PREFIX", "FUZZY"


def budget(query: Column) -> Column:
    """How many edits a query of its length may be off: none up to 2 characters, 1 up to 4, else 2."""
    n = units(strip(query))
    return F.when(query.isNull() | (n <= 2), 0).when(n <= 4, 1).otherwise(2)


def budget_of(query: str | None) -> int:
    n = len((query or "").strip(PYTHON_WHITESPACE).encode("utf-16-le", "surrogatepass")) // 2
    return 0 if n <= 2 else 1 if n <= 4 else 2


def match_quality(match_type: Column, edits: Column) -> Column:
    return F.when(match_type == PREFIX, 1.0).otherwise(F.lit(1.0) / (1 + F.greatest(edits, F.lit(0))))


def popularity(weight: Column, max_weight: Column) -> Column:
    top = F.log10(1 + F.greatest(max_weight, F.lit(0)))
    return F.when(top <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log10(1 + F.greatest(weight, F.lit(0))) / top))


def score(match_type: Column, edits: Column, weight: Column, max_weight: Column) -> Column:
    return QUALITY * match_quality(match_type, edits) + POPULARITY * popularity(weight, max_weight)
