"""Derived tables that answer lookups by equality: prefixes, their best words, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import in_units, rows_of
from ..functions.score import PREFIX, score
from .rank import best_first, top_k_per

PAGE = 50


def exploded_prefixes(corpus: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """Each word once for each of its prefixes, the empty one among them; only for those lengths if they are given."""
    n = F.length("normalized")
    sizes = F.sequence(F.lit(0), n) if lengths is None else F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda i: i <= n)
    return corpus.withColumn("prefix", F.explode(F.transform(sizes, lambda i: F.substring("normalized", F.lit(1), i))))


def prefix_index(corpus: DataFrame) -> DataFrame:
    """prefix, max_subtree_weight, words, is_terminal, child_count of every prefix of every word."""
    rows = exploded_prefixes(corpus)
    terminal = F.col("prefix") == F.col("normalized")
    own = rows.groupBy("prefix").agg(F.max("weight").alias("max_subtree_weight"), F.count("*").alias("words"), F.bool_or(terminal).alias("is_terminal"))
    longer = own.where("prefix <> ''").groupBy(F.expr("substring(prefix, 1, length(prefix) - 1)").alias("prefix")).agg(F.count("*").alias("child_count"))
    return own.join(longer, "prefix", "left").select("prefix", "max_subtree_weight", "words", "is_terminal", F.coalesce("child_count", F.lit(0)).alias("child_count"))


def with_prefix_scores(rows: DataFrame, max_weight: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(max_weight)).withColumn("score", score(F.lit(PREFIX), F.lit(0), F.col("weight"), F.col("max_weight")))


def max_weight(corpus: DataFrame) -> DataFrame:
    """One row, max_weight; 0 for an empty corpus."""
    return corpus.agg(F.coalesce(F.max("weight"), F.lit(0)).alias("max_weight"))


def prefix_topk(corpus: DataFrame, k: int = PAGE, units: bool = False) -> DataFrame:
    """The best k words of every prefix, by score: a prefix query reads k rows, whatever the corpus.

    Words of a short prefix are many: ranks are taken in two steps, first among the words that share two
    more characters with it, so that no task sorts all words.
    """
    scored = with_prefix_scores(corpus, max_weight(corpus))
    rows = exploded_prefixes(scored).withColumn("part", F.pmod(F.xxhash64("normalized"), F.lit(64)))
    order = best_first(in_units=units)
    few = top_k_per(rows, ["prefix", "part"], k, order).drop("rank", "part")
    return top_k_per(few, ["prefix"], k, order).select("prefix", "rank", "word", "normalized", "score", "weight")


# Segments: words within k edits, by equality.
#
# A word is cut into k + 1 segments.  k edits can't touch all of them, so a word within k edits of a query has a segment
# that stands in the query whole.  It stands there nearly where it stands in the word: i edits at most lie before
# segment i if the ones before it are all touched, and k - i behind it (Li, Deng, Wang, Feng: Pass-Join, 2011).


def _segment(n: Column | int, i: int, k: int) -> tuple:
    """Start, from 0, and length of segment i of a word of n characters; the last ones are longer by one if need be."""
    if isinstance(n, int):
        base, longer = divmod(n, k + 1)
        return i * base + max(0, i - (k + 1 - longer)), base + (i >= k + 1 - longer)
    base, shorter = F.floor(n / (k + 1)).cast("int"), F.lit(k + 1) - F.pmod(n, F.lit(k + 1))
    return F.lit(i) * base + F.greatest(F.lit(0), F.lit(i) - shorter), base + (F.lit(i) >= shorter).cast("int")


def _name(w: Column, n: Column, i: int, k: int) -> Column:
    start, size = _segment(n, i, k)
    return F.concat_ws(":", n, F.lit(i), F.substring(w, start + 1, size))


def segment_index(corpus: DataFrame, k: int) -> DataFrame:
    """segment, place, word, normalized, weight: each word under its k + 1 segments, with the word's length and their place."""
    w, n = F.col("normalized"), F.length("normalized")
    each = [F.struct(_name(w, n, i, k).alias("segment"), F.lit(i).alias("place")) for i in range(k + 1)]
    return corpus.select(F.explode(F.array(*each)).alias("s"), "word", "normalized", "weight").select("s.segment", "s.place", "word", "normalized", "weight")


def _spots(k: int):
    """(word length less query length, segment, shift) where a segment may stand in a query."""
    return [(longer, i, shift) for longer in range(-k, k + 1) for i in range(k + 1) for shift in range(-i, i + 1) if abs(shift + longer) <= k - i]


def probes(key: str, k: int) -> list[str]:
    """The segments to look up for one query."""
    found = set()
    for longer, i, shift in _spots(k):
        n = len(key) + longer
        if n >= 0:
            start, size = _segment(n, i, k)
            if 0 <= start + shift <= len(key) - size:
                found.add(f"{n}:{i}:{key[start + shift : start + shift + size]}")
    return sorted(found)


def with_probes(queries: DataFrame, k: int) -> DataFrame:
    """Queries, with a column key, once for each segment to look up."""
    key, m, each = F.col("key"), F.length("key"), []
    for longer, i, shift in _spots(k):
        n = m + longer
        start, size = _segment(n, i, k)
        fits = (n >= 0) & (start + shift >= 0) & (start + shift + size <= m)
        each.append(F.when(fits, F.concat_ws(":", n, F.lit(i), F.substring(key, start + shift + 1, size))))
    return queries.withColumn("probe", F.explode(F.array_distinct(F.array_compact(F.array(*each)))))


def first_probed(found: list[str], k: int) -> Column:
    """For one query: whether a row of the index is the first of its word's segments that are among the probes."""
    w, n, seen = F.col("normalized"), F.length("normalized"), F.lit(False)
    for i in range(k):
        seen = seen | ((F.col("place") > i) & _name(w, n, i, k).isin(found))
    return ~seen


def first_meeting(key: Column, k: int) -> Column:
    """Whether a row of the index meets the key in none of the word's earlier segments: so each pair is seen once."""
    w, n, m, seen = F.col("normalized"), F.length("normalized"), F.length(key), F.lit(False)
    for i in range(k):
        start, size = _segment(n, i, k)
        met = F.lit(False)
        for shift in range(-i, i + 1):
            at = start + shift
            met = met | ((F.abs(n - m + shift) <= k - i) & (at >= 0) & (at + size <= m) & (F.substring(key, at + 1, size) == F.substring(w, start + 1, size)))
        seen = seen | ((F.col("place") > i) & met)
    return ~seen


def lookup(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """key, word, weight of the keys that the corpus has."""
    return keys.join(corpus.select(F.col("normalized").alias("key"), "word", "weight"), "key")


def contains(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """key, found."""
    have = corpus.select(F.col("normalized").alias("key"), F.lit(True).alias("found"))
    return keys.join(have, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def weight_of(corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """key, weight; 0 for a key that the corpus lacks."""
    have = corpus.select(F.col("normalized").alias("key"), "weight")
    return keys.join(have, "key", "left").select("key", F.coalesce("weight", F.lit(0)).alias("weight"))


def has_prefix(index: DataFrame, keys: DataFrame) -> DataFrame:
    """key, found: whether any word starts with it; the empty key always is found."""
    have = index.select(F.col("prefix").alias("key"), F.lit(True).alias("found"))
    return keys.join(have, "key", "left").select("key", F.coalesce("found", F.col("key") == "").alias("found"))


def node_count(index: DataFrame) -> DataFrame:
    """Nodes of the trie that the prefixes are: the root and one for each prefix that isn't empty."""
    return index.agg((F.lit(1) + F.count_if(F.col("prefix") != "")).alias("nodes"))


def traversal_stats(index: DataFrame, corpus: DataFrame, key: str, k: int) -> DataFrame:
    """nodes_expanded and frontier_pushes that best-first search for the best k words under a prefix would need.

    It expands the prefixes that extend the key and whose best word is no lighter than the k-th result.
    """
    if k <= 0:
        return corpus.sparkSession.createDataFrame([(0, 0)], "nodes_expanded long, frontier_pushes long")
    least = corpus.where(F.col("normalized").startswith(key)).orderBy(F.desc("weight")).limit(k).agg(F.when(F.count("*") == k, F.min("weight")).otherwise(F.lit(-1)).alias("least"))
    expanded = index.where(F.col("prefix").startswith(key)).crossJoin(F.broadcast(least)).where("max_subtree_weight >= least")
    pushes = F.coalesce(F.sum(F.col("is_terminal").cast("long") + F.col("child_count")), F.lit(0))
    return expanded.agg(F.count("*").alias("nodes_expanded"), F.when(F.count("*") > 0, 1 + pushes).otherwise(F.lit(0)).alias("frontier_pushes"))


def metric_tree_depth(words: list[str]) -> int:
    """Levels of the metric tree that inserting a few words in order makes: a diagnostic of its shape, for the driver."""
    children: dict[str, dict[int, str]] = {}
    deepest = 0
    for w in words:
        depth, node = 1, next(iter(children), None)
        while node is not None and node != w:
            d = rows_of(in_units(w), in_units(node))[-1][-1]
            depth, node = depth + 1, children[node].setdefault(d, w)
        if w not in children:
            children[w] = {}
            deepest = max(deepest, depth)
    return deepest
