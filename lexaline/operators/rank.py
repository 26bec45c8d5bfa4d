"""Total orders and top-k."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import unit_order, units


def best_first(score: str = "score", word: str = "word", in_units: bool = False) -> list[Column]:
    """Score down, length up, word up."""
    w = F.col(word)
    return [F.desc(score), units(w) if in_units else F.length(w), unit_order(w) if in_units else w]


def closest_first(distance: str = "distance", word: str = "normalized", in_units: bool = False) -> list[Column]:
    """Distance up, length up, word up."""
    w = F.col(word)
    return [F.asc(distance), units(w) if in_units else F.length(w), unit_order(w) if in_units else w]


def _valid(k: int) -> int:
    if k < 0:
        raise ValueError("k must not be negative")
    return k


def top_k(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows in an order, with rank 1 to k.

    The rank is given after the limit, so no more than k rows meet in one task.
    """
    first = rows.orderBy(*order).limit(_valid(k))
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_k_per(rows: DataFrame, by: list[str], k: int | Column, order: list[Column], most: int | None = None) -> DataFrame:
    """The first k rows of each group, with rank.

    With k a column, most is a number that no k exceeds: by it each task drops rows before the shuffle.
    """
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if isinstance(k, int):
        return out.where(F.col("rank") <= _valid(k))
    return (out if most is None else out.where(F.col("rank") <= most)).where(F.col("rank") <= k)


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """All rows with their place in an order, from 1.

    They are sorted by ranges and counted by partition, so that no task has them all; the driver has one count for each
    partition.  The sorted rows are persisted.  A rank past the last bigint can't come: partitions hold 2**33 rows at most.
    """
    placed = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).persist()
    sizes = {r["part"]: r["n"] for r in placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    offsets = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    at = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("_part")).withColumn(name, at).drop("_at", "_part", "_before")


class BoundedTop:
    """The best k of items that come one by one, for use on the driver."""

    def __init__(self, capacity: int, key: Callable):
        self.capacity, self.key, self._heap, self._n = _valid(capacity), key, [], 0

    def offer(self, item) -> bool:
        """Whether the item was retained; of equals the first to come stays."""
        if item is None:
            raise TypeError("an item must not be None")
        self._n += 1
        entry = (_Reversed((self.key(item), self._n)), item)
        if len(self._heap) < self.capacity:
            heapq.heappush(self._heap, entry)
            return True
        return bool(self._heap) and heapq.heappushpop(self._heap, entry)[1] is not item

    def offer_all(self, items: Iterable) -> None:
        for item in items:
            self.offer(item)

    def worst(self):
        return self._heap[0][1] if self._heap else None

    def drain(self) -> list:
        """All items, best first; none are left."""
        out = [heapq.heappop(self._heap)[1] for _ in range(len(self._heap))]
        return out[::-1]

    def __len__(self) -> int:
        return len(self._heap)


class _Reversed:
    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value
