"""Levenshtein distance in UTF-16 units.

The built-in columns count code points, which comes to the same for words of the basic plane.  With units=True words with
characters beyond it, and only they, are measured in an Arrow UDF by their UTF-16 units.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import has_astral

Metric = Callable[[Column, Column], Column]


def in_units(text: str) -> list[int]:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).tolist()


def rows_of(a: list[int], b: list[int]) -> list[list[int]]:
    """The whole table of distances between the prefixes of a and b."""
    table = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(table[-1][j] + 1, row[-1] + 1, table[-1][j - 1] + (x != y)))
        table.append(row)
    return table


def banded(a: list[int], b: list[int], most: int) -> int:
    """The distance if it is at most `most`, else -1: only cells within `most` of the diagonal, until a row has none left."""
    if abs(len(a) - len(b)) > most:
        return -1
    far = most + 1
    above = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        row = [far] * (len(b) + 1)
        if i <= most:
            row[0] = i
        for j in range(low, high + 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != b[j - 1]), far)
        if min(row[low - 1 : high + 1]) > most:
            return -1
        above = row
    return above[-1] if above[-1] <= most else -1


@F.pandas_udf(T.IntegerType())
def _in_units(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    pairs = ((None, None, 0) if x is None or y is None else (in_units(x), in_units(y), k) for x, y, k in zip(a, b, most, strict=True))
    return pd.Series([None if x is None else banded(x, y, k if k >= 0 else max(len(x), len(y))) for x, y, k in pairs], dtype="Int32")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _table(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else rows_of(in_units(x), in_units(y)) for x, y in zip(a, b, strict=True)])


def _either(a: Column, b: Column, most: int, native: Column) -> Column:
    """The built-in measure, but in units where a or b has characters beyond the basic plane."""
    wide = has_astral(a) | has_astral(b)
    return F.when(wide, _in_units(F.when(wide, a), F.when(wide, b), F.lit(most))).otherwise(native)


def distance(a: Column, b: Column, units: bool = False) -> Column:
    """Least number of insertions, deletions and substitutions."""
    d = F.levenshtein(a, b)
    return _either(a, b, -1, d) if units else d


def edits(a: Column, b: Column, most: int, units: bool = False) -> Column:
    """The distance if it is at most `most`, else -1."""
    if most < 0:
        raise ValueError("the cutoff must not be negative")
    d = F.levenshtein(a, b, most)
    return _either(a, b, most, d) if units else d


def distance_with_cutoff(a: Column, b: Column, most: int, units: bool = False) -> Column:
    """The distance if it is at most `most`, else most + 1."""
    d = edits(a, b, most, units)
    return F.when(d < 0, most + 1).otherwise(d)


def is_within(a: Column, b: Column, most: int, units: bool = False) -> Column:
    return edits(a, b, most, units) >= 0


def table(a: Column, b: Column) -> Column:
    """The table of the computation, for teaching and debugging."""
    return _table(a, b)
