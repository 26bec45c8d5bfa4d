"""Prefix, fuzzy and combined search, for one query or a table of queries.

A table of queries has query_id, q and limit, and for fuzzy search max_distance.  Results have query_id, rank,
word, score, match_type, edit_distance and weight.  Scan plans look at every word for every query; indexed plans
meet by equality on a prefix or a segment.  Both give the same rows.

units says that words or queries have characters beyond the basic plane: then lengths, order and distances go by UTF-16
units where such characters are.  top is the corpus's largest weight, where it is known already.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distance import Metric, edits, is_within
from ..functions.score import FUZZY, PREFIX, budget, score
from ..functions.text import normalize
from .index import PAGE, exploded_prefixes, first_meeting, max_weight, segment_index, with_probes
from .rank import best_first, ranked, top_k, top_k_per

RESULT = ["rank", "word", "score", "match_type", "edit_distance", "weight"]
MOST = 2
#: Queries that a scan sends to all tasks at once; more go in several blocks.
BLOCK = 10_000


def keyed(queries: DataFrame) -> DataFrame:
    return queries.withColumn("key", normalize(F.col("q")))


def scored(hits: DataFrame, corpus: DataFrame, top: int | None = None) -> DataFrame:
    """Hits with their score."""
    if top is None:
        hits, most = hits.crossJoin(F.broadcast(max_weight(corpus))), F.col("max_weight")
    else:
        most = F.lit(top).cast("long")
    return hits.withColumn("score", score(F.col("match_type"), F.col("edit_distance"), F.col("weight"), most)).drop("max_weight")


def _hits(rows: DataFrame, match_type: str, distance: Column, *by: str) -> DataFrame:
    return rows.select(*by, "word", "normalized", "weight", F.lit(match_type).alias("match_type"), distance.cast("int").alias("edit_distance"))


def largest(queries: DataFrame) -> int:
    """The largest limit of a table of queries."""
    return max(queries.agg(F.max("limit")).first()[0] or 0, 0)


def key_of(q: str) -> Column:
    """A query's key, as a column that the planner folds to a literal."""
    return normalize(F.lit(q))


# One query: a filter over the corpus and a bounded sort.


def prefix_hits_of(corpus: DataFrame, key: Column) -> DataFrame:
    return _hits(corpus.where(F.col("normalized").startswith(key)), PREFIX, F.lit(0))


def prefix_search(corpus: DataFrame, q: str, limit: int, units: bool = False, top: int | None = None) -> DataFrame:
    """Words that start with the query, best first; all words for an empty one."""
    hits = prefix_hits_of(corpus, key_of(q))
    return top_k(scored(hits, corpus, top), max(limit, 0), best_first(in_units=units)).select(*RESULT)


def all_with_prefix(corpus: DataFrame, q: str, units: bool = False) -> DataFrame:
    """Every word that starts with the query, ranked by weight."""
    return ranked(corpus.where(F.col("normalized").startswith(key_of(q))), best_first("weight", in_units=units)).select("rank", "word", "weight")


def fuzzy_hits(corpus: DataFrame, key: Column, most: int, metric: Metric | None = None, units: bool = False) -> DataFrame:
    """Words within `most` edits of a key; under another metric every word is measured."""
    if most < 0:
        raise ValueError("the edit budget must not be negative")
    word = F.col("normalized")
    if metric is not None:
        return _hits(corpus.withColumn("d", metric(word, key)).where(F.col("d") <= most), FUZZY, F.col("d"))
    # in code points the distance, and so the difference in length, is never larger than in units
    near = corpus.where(F.abs(F.length(word) - F.length(key)) <= most).withColumn("d", edits(word, key, most, units))
    return _hits(near.where("d >= 0"), FUZZY, F.col("d"))


def fuzzy_search(corpus: DataFrame, q: str, limit: int, most: int, metric: Metric | None = None, units: bool = False, top: int | None = None) -> DataFrame:
    """Words within `most` edits of the query, those that start with it included, best first."""
    hits = fuzzy_hits(corpus, key_of(q), most, metric, units)
    return top_k(scored(hits, corpus, top), max(limit, 0), best_first(in_units=units)).select(*RESULT)


# A table of queries.


def blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in blocks of about BLOCK at most, each small enough to be sent to all tasks."""
    n = -(-queries.count() // (BLOCK * 3 // 4)) or 1
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64("query_id", "q"), F.lit(n)) == i) for i in range(n)]


def every_block(queries: DataFrame, find) -> DataFrame:
    return reduce(DataFrame.unionByName, (find(b) for b in blocks(queries)))


def prefix_hits(queries: DataFrame, corpus: DataFrame, indexed: bool, pages: DataFrame | None = None) -> DataFrame:
    """query_id, limit, key and the words that start with the key; from pages only the best PAGE of them."""
    own = keyed(queries)
    if pages is not None:
        found = pages.drop("rank", "score").join(own, F.col("prefix") == F.col("key"))
    elif indexed:
        lengths = sorted(r[0] for r in own.where("key is not null").select(F.length("key")).distinct().collect())
        found = exploded_prefixes(corpus, lengths).join(own, F.col("prefix") == F.col("key"))
    else:
        found = every_block(own, lambda b: corpus.join(F.broadcast(b), F.col("normalized").startswith(F.col("key"))))
    return _hits(found, PREFIX, F.lit(0), "query_id", "limit")


def fuzzy_pairs(queries: DataFrame, corpus: DataFrame, most: int, indexed: bool, segments: DataFrame | None = None, units: bool = False) -> DataFrame:
    """query_id, limit, key, max_distance and the words within max_distance (at most `most`) of the key.

    Indexed: by the words' segments, which may be given.  Scan: by word length.  Either way each pair is
    measured where it meets, and comes once.
    """
    own, words = keyed(queries), corpus.select("word", "normalized", "weight")
    if indexed:
        have = segment_index(words, most) if segments is None else segments
        pairs = have.join(with_probes(own, most), F.col("segment") == F.col("probe"))
    else:
        sized = own.withColumn("size", F.explode(F.sequence(F.length("key") - most, F.length("key") + most)))
        pairs = every_block(sized, lambda b: words.join(F.broadcast(b), F.length("normalized") == F.col("size")))
    near = pairs.withColumn("d", edits(F.col("normalized"), F.col("key"), most, units)).where((F.col("d") >= 0) & (F.col("d") <= F.col("max_distance")))
    return near.where(first_meeting(F.col("key"), most)).drop("segment", "place", "probe") if indexed else near.drop("size")


def prefix_batch(queries: DataFrame, corpus: DataFrame, indexed: bool = True, units: bool = False, top: int | None = None) -> DataFrame:
    hits = scored(prefix_hits(queries, corpus, indexed), corpus, top)
    return top_k_per(hits, ["query_id"], F.col("limit"), best_first(in_units=units), largest(queries)).select("query_id", *RESULT)


def prefix_page(queries: DataFrame, topk: DataFrame) -> DataFrame:
    """The same for limits up to the table's, from the best words of every prefix: an equality join and no ranking."""
    found = topk.join(keyed(queries), F.col("prefix") == F.col("key")).where(F.col("rank") <= F.col("limit"))
    return found.select("query_id", "rank", "word", "score", F.lit(PREFIX).alias("match_type"), F.lit(0).alias("edit_distance"), "weight")


def fuzzy_batch(queries: DataFrame, corpus: DataFrame, most: int = MOST, indexed: bool = True, segments: DataFrame | None = None, units: bool = False, top: int | None = None) -> DataFrame:
    pairs = fuzzy_pairs(queries, corpus, most, indexed, segments, units)
    hits = scored(_hits(pairs, FUZZY, F.col("d"), "query_id", "limit"), corpus, top)
    return top_k_per(hits, ["query_id"], F.col("limit"), best_first(in_units=units), largest(queries)).select("query_id", *RESULT)


def merge(prefix: DataFrame, fuzzy: DataFrame, by: list[str]) -> DataFrame:
    """Hits of both; a word found by both is a prefix hit."""
    both = prefix.unionByName(fuzzy)
    first = F.row_number().over(Window.partitionBy(*by, "normalized").orderBy((F.col("match_type") != PREFIX).cast("int"), "edit_distance"))
    return both.withColumn("first", first).where("first = 1").drop("first")


def search_batch(queries: DataFrame, corpus: DataFrame, indexed: bool = True, most: int = MOST, pages: DataFrame | None = None, segments: DataFrame | None = None, units: bool = False, top: int | None = None) -> DataFrame:
    """Combined search: prefix hits, and while the page is short words within 1 edit, then 2, as the budget allows.

    One pass: with P prefix hits and N(d) other words within d edits, the edits allowed are 0 if P fills the
    page, else the least d within the budget with P + N(d) >= limit, or else the whole budget.  Of the hits of one query
    at one distance only the best that a page could hold are ever seen or counted, so that tables of the best words will
    do while no limit exceeds theirs, and no task gets all that a short query finds.
    """
    page = largest(queries)
    pages = pages if page <= PAGE else None
    own = keyed(queries).withColumn("budget", budget(F.col("q")))
    prefix = prefix_hits(own.select("query_id", "q", "limit"), corpus, indexed, pages)
    full = prefix.groupBy("query_id").agg(F.count("*").alias("n"))
    # queries whose page is full need no fuzzy candidates at all
    short = own.join(full, "query_id", "left").where((F.coalesce("n", F.lit(0)) < F.col("limit")) & (F.col("budget") > 0))
    pairs = fuzzy_pairs(short.select("query_id", "q", "limit", F.col("budget").alias("max_distance")), corpus, most, indexed, segments, units)
    fuzzy = _hits(pairs.where(~F.col("normalized").startswith(F.col("key"))), FUZZY, F.col("d"), "query_id", "limit")
    order = best_first(in_units=units)
    best = top_k_per(scored(prefix.unionByName(fuzzy), corpus, top), ["query_id", "edit_distance"], F.col("limit"), order, page).drop("rank")
    each = Window.partitionBy("query_id")
    enough = [F.when(F.count_if(F.col("edit_distance") <= d).over(each) >= F.col("limit"), d) for d in range(most)]
    allowed = best.withColumn("allowed", F.coalesce(*enough, F.lit(most))).where(F.col("edit_distance") <= F.col("allowed")).drop("allowed")
    return top_k_per(allowed, ["query_id"], F.col("limit"), order, page).select("query_id", *RESULT)


def candidates(queries: DataFrame, corpus: DataFrame, most: int = MOST, indexed: bool = True, segments: DataFrame | None = None) -> DataFrame:
    """query_id, candidates_verified, found: of how many words each query's distance is computed, and how many are near enough."""
    own, words = keyed(queries), corpus.select("normalized")
    if indexed:
        have = segment_index(corpus, most) if segments is None else segments
        pairs = have.join(with_probes(own, most), F.col("segment") == F.col("probe")).where(first_meeting(F.col("key"), most))
    else:
        sized = own.withColumn("size", F.explode(F.sequence(F.length("key") - most, F.length("key") + most)))
        pairs = every_block(sized, lambda b: words.join(F.broadcast(b), F.length("normalized") == F.col("size")))
    d = F.levenshtein("normalized", "key", most)
    seen = pairs.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if((d >= 0) & (d <= F.col("max_distance"))).alias("near"))
    none = F.lit(0).cast("long")
    return queries.select("query_id").join(seen, "query_id", "left").select("query_id", F.coalesce("n", none).alias("candidates_verified"), F.coalesce("near", none).alias("found"))


def within(pairs: DataFrame, most: int, units: bool = False) -> DataFrame:
    """Pairs a, b with whether they are within `most` edits."""
    return pairs.withColumn("within", is_within(F.col("a"), F.col("b"), most, units))
