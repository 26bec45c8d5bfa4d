"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: the sources, in code-point order with null last, weigh 5, 2, 1, 5, 2, 1, ... and share all
tokens; a target stops at MAX_REPEATS times its source's size, and the excess is shared again by weight
among the others until none is above.

Quotas: a source's documents are dealt by a seeded hash to shards of about SHARD_DOCS documents.  The
source's blocks of BLOCK tokens go one by one to its shard with the highest quotient votes / (2 blocks + 1), a
shard's votes being its number of blocks.  The last block of a shard is short, so how many go is settled by
the tokens that they have: as many as bring the source nearest to its target, within half a block.

Blocks: in a shard the documents lie end to end in seeded order, cut into blocks of BLOCK tokens.  A shard
with n blocks and a quota of q takes every block q div n times, and q mod n of them once more, spread
evenly from a seeded start.  How much of a document lies in taken blocks follows from its first and last
token's place alone, so nothing is written per block.

The documents' sizes are counted once and written; they meet in one shuffle, by source and shard, of a
few numbers each.  With keep_columns the texts are shuffled once, to meet their shares.  A source that holds a third of the corpus has many shards.  The driver has one row per source and one per
shard; all sources together have MAX_SHARDS and one each at most, beyond which shards grow.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import keep

BLOCK, SHARD_DOCS, MAX_SHARDS, MAX_REPEATS, SEED, WEIGHTS = 16, 500, 1 << 16, 3, 17, (5, 2, 1)


def targets(sizes: Sequence[int], weights: Sequence[int], cap: int = MAX_REPEATS) -> list[float]:
    """Water filling: shares of sum(sizes) by weight, none above cap times its size.

    Zero where the size is zero.  If all are at their cap the rest is shared no more.
    """
    out, left, open_ = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), set(range(len(sizes)))
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if per * weights[i] >= cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = Fraction(cap * sizes[i])
            left -= out[i]
        open_ -= full
    return [float(x) for x in out]


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2 seats + 1), ties to the first, none beyond most.

    Begins from the divisor that fits nearly, then gives or takes the few seats that are left.
    """
    votes = np.asarray(votes, float)
    most = np.full(len(votes), np.iinfo(np.int64).max) if most is None else np.asarray(most)
    if not votes.sum():
        return np.zeros(len(votes), np.int64)
    seats = int(min(seats, most[votes > 0].astype(float).sum()))
    low, high = 0.0, votes.max() * 2 + 1
    for _ in range(200):  # the least divisor that doesn't give too many
        mid = (low + high) / 2
        if np.minimum(np.ceil(votes / mid - 0.5), most).sum() > seats:
            low = mid
        else:
            high = mid
    got = np.minimum(np.ceil(votes / high - 0.5), most).astype(np.int64)
    heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got, strict=True)) if v > 0 and g < most[i]]
    heapq.heapify(heap)
    for _ in range(int(seats - got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def words_of(quotas: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, starts: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Words that shards' quotas take: all blocks are full but the last, of which the rest of the quota begins at starts."""
    whole, rest = np.divmod(quotas, np.maximum(blocks, 1))
    return block * quotas - (whole + (starts < rest)) * (block * blocks - sizes)


def nearest(target: float, blocks: np.ndarray, sizes: np.ndarray, starts: np.ndarray, block: int = BLOCK, cap: int = MAX_REPEATS) -> np.ndarray:
    """The quotas of one source's shards whose words come nearest to its target.

    One more seat takes one more block, of 1 to `block` words, so two numbers of seats that follow each other enclose the target.
    """

    def at(seats: int) -> tuple[float, np.ndarray]:
        quotas = sainte_lague(blocks, seats, cap * blocks)
        return float(words_of(quotas, blocks, sizes, starts, block).sum()) - target, quotas

    low = max(0, int(target // block) - 1)  # blocks have no more words than that, and are short cap times a shard at most
    high = min(cap * int(blocks.sum()), low + 2 + cap * len(blocks))
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if at(mid)[0] < 0 else (low, mid)
    return min(at(low), at(high), key=lambda x: abs(x[0]))[1]


def _order(name: str | None):
    return (name is None, [] if name is None else [ord(c) for c in name])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEATS, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED, keep_columns: bool = False) -> DataFrame:
    """How many words the mix takes of every document.

    Returns doc_id, size, source_size, target, taken, source, shard, quota (blocks of its shard).  size is
    the number of words (null: 0).  taken counts repeats, is at most cap times size, and is 0 for a
    document without words; a source without words has target 0.  Null is a source like any other.  Rows
    with the same doc_id, or none, are each a document; their order in the shard is settled by text.  Rows of equal
    doc_id, text and source are told apart in one task, which sorts their numbers.
    An empty table gives no rows.  The same rows give the same result in whatever order they come.  Other
    columns are ignored; with keep_columns the rows of docs come with all their columns, followed by size,
    source_size, target and taken, which take the place of columns of these names.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    numbers = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("draw")]
    own = keep(docs.select(*numbers))
    per = sorted(own.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect(), key=lambda r: _order(r["source"]))
    shares, every = targets([r["size"] for r in per], [weights[i % len(weights)] for i in range(len(per))], cap), sum(r["docs"] for r in per)
    dealt = spark.createDataFrame([(r["source"], int(r["size"]), t, min(-(-r["docs"] // shard_docs), max(1, MAX_SHARDS * r["docs"] // every))) for r, t in zip(per, shares, strict=True)], T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("shards", T.LongType())]))
    placed = own.join(dealt, own["source"].eqNullSafe(dealt["source"])).select("doc_id", own["source"], "size", "draw", "source_size", "target", F.pmod(F.shiftright("draw", 20), "shards").alias("shard"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    shards = shards.withColumn("drawn", F.xxhash64(F.lit(seed), "source", "shard")).toArrow().to_pylist()
    shards.sort(key=lambda r: (_order(r["source"]), r["shard"]))
    sizes = np.array([r["shard_size"] for r in shards], np.int64)
    blocks = -(-sizes // block)
    starts = np.array([r["drawn"] for r in shards], np.int64) % np.maximum(blocks, 1)
    quotas, first = np.zeros(len(shards), np.int64), 0
    for _, own in groupby(shards, key=lambda r: r["source"]):
        own = list(own)
        at = slice(first, first := first + len(own))
        quotas[at] = nearest(own[0]["target"], blocks[at], sizes[at], starts[at], block, cap)
    given = spark.createDataFrame(
        pa.table({"source": pa.array([r["source"] for r in shards], pa.string()), "shard": pa.array([r["shard"] for r in shards], pa.int64()), "blocks": pa.array(blocks, pa.int64()), "quota": pa.array(quotas, pa.int64())}))
    line = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = placed.withColumn("end", F.sum("size").over(line))
    at = ends.join(given, ends["source"].eqNullSafe(given["source"]) & (ends["shard"] == given["shard"])).drop(given["source"]).drop(given["shard"])
    n = F.greatest("blocks", F.lit(1))
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), n)

    def before(x: str):
        """Words that the mix takes from the first x words of a shard."""
        k = F.expr(f"{x} div {block}")
        whole = F.floor(F.col("quota") / n)
        extra = lambda j: F.floor((j * F.pmod("quota", n) + start) / n)
        return F.lit(block) * (whole * k + extra(k)) + (F.col(x) - k * block) * (whole + extra(k + 1) - extra(k))

    at = at.withColumn("begin", F.col("end") - F.col("size"))
    out = at.select("doc_id", "size", "source_size", "target", (before("end") - before("begin")).cast("long").alias("taken"), "source", "shard", "quota", "draw")
    if not keep_columns:
        return out.drop("draw")
    # each row's share comes back by the numbers that gave it its place; rows that have all of them alike are dealt their shares in
    # order of their other columns
    marks = ["doc_id", "source", "size", "draw"]
    taken = F.when(F.col("size") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sort_array(F.collect_list("taken"), asc=False))
    shares = keep(out.groupBy(*marks).agg(taken.alias("takens"), F.first("source_size").alias("source_size"), F.first("target").alias("target")))
    drawn = docs.select(F.struct(*(c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken"))).alias("row"), *numbers)

    def told(some: DataFrame, nth) -> DataFrame:
        own = some.withColumnsRenamed({c: f"_{c}" for c in marks})
        joined = drawn.join(own.hint("shuffle_hash"), [drawn[c].eqNullSafe(own[f"_{c}"]) for c in marks])
        return joined.withColumn("nth", nth).select("row.*", "size", "source_size", "target", F.element_at("takens", F.col("nth")).alias("taken"))

    line = Window.partitionBy(*marks).orderBy(F.xxhash64("row"))
    return told(shares.where("size(takens) = 1"), F.lit(1)).unionByName(told(shares.where("size(takens) > 1"), F.row_number().over(line)))
