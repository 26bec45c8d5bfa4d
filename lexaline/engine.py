"""A corpus with the tables derived from it, built once and read by many queries."""

from __future__ import annotations

import time
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distance import Metric, edits
from .functions.text import PYTHON_WHITESPACE, has_astral, normalize
from .operators import index, search
from .operators.rank import best_first, top_k
from .plans import routing
from .sources import words


class Engine:
    """Search over a corpus by scan ("naive") or by its indexes ("optimized"); the answers are the same.

    Tables are persisted at the storage level given: lost blocks are rebuilt from their lineage, which starts at files.
    Words go by UTF-16 units where the corpus or a query has characters beyond the basic plane.
    """

    #: Asked, each WARM_ROUNDS times, before the first user asks.
    WARM_UP = ("a", "th", "the", "s", "in", "heit", "worth", "apple", "ing", "er", "tion", "recieve", "aple", "o")
    WARM_ROUNDS = 3

    def __init__(self, corpus: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.level = level
        began = time.perf_counter()
        self.corpus = corpus.persist(level)
        own = F.coalesce(F.bool_or(has_astral(F.col("normalized")) | has_astral(F.col("word"))), F.lit(False))
        self.size, self.has_astral, self.top = self.corpus.agg(F.count("*"), own, F.coalesce(F.max("weight"), F.lit(0))).first()
        self.build_millis = {"corpus": round(1000 * (time.perf_counter() - began))}

    @classmethod
    def from_documents(cls, spark: SparkSession, path: str, text: str = "text") -> Engine:
        return cls(words.from_tokens(spark.read.parquet(path), text))

    @classmethod
    def from_words(cls, spark: SparkSession, path: str, max_entries: int | None = None) -> Engine:
        """Over a word list; max_entries is by default what the session's configuration says."""
        return cls(words.load(spark, path, max_entries)[0])

    def _built(self, name: str, df: DataFrame) -> DataFrame:
        began = time.perf_counter()
        df = df.persist(self.level)
        df.count()
        self.build_millis[name] = round(1000 * (time.perf_counter() - began))
        return df

    @cached_property
    def prefixes(self) -> DataFrame:
        return self._built("prefix_index", index.prefix_index(self.corpus))

    @cached_property
    def pages(self) -> DataFrame:
        """The best words of every prefix."""
        return self._built("prefix_topk", index.prefix_topk(self.corpus, units=self.has_astral))

    @cached_property
    def segments(self) -> DataFrame:
        """Words by the halves that one edit leaves, for single queries."""
        return self._built("segment_index", index.segment_index(self.corpus, routing.INDEXED_BUDGET))

    @cached_property
    def segments_of_all(self) -> DataFrame:
        """Words by the thirds that two edits leave, for tables of queries."""
        return self._built("segment_index_2", index.segment_index(self.corpus, search.MOST))

    def _units(self, q: str) -> bool:
        return self.has_astral or any(ord(c) > 0xFFFF for c in q)

    def _units_of(self, queries: DataFrame) -> bool:
        return self.has_astral or not queries.where(has_astral(F.col("q"))).isEmpty()

    def prefix_search(self, q: str, limit: int, engine: str = "optimized") -> DataFrame:
        if engine == "optimized" and 0 < limit <= index.PAGE:
            page = self.pages.where((F.col("prefix") == search.key_of(q)) & (F.col("rank") <= limit))
            return page.select("rank", "word", "score", F.lit(search.PREFIX).alias("match_type"), F.lit(0).alias("edit_distance"), "weight").orderBy("rank")
        return search.prefix_search(self.corpus, q, limit, self._units(q), self.top)

    def _near(self, q: str, most: int, units: bool) -> DataFrame:
        """Candidates within `most` edits from the segments."""
        key, k = q.strip(PYTHON_WHITESPACE).lower(), routing.INDEXED_BUDGET
        if not q.isascii():  # lower case by Spark's rules, which the index goes by
            key = self.corpus.sparkSession.range(1).select(normalize(F.lit(q))).first()[0]
        probes = index.probes(key, k)
        met = self.segments.where(F.col("segment").isin(probes) & index.first_probed(probes, k))
        return search._hits(met.withColumn("d", edits(F.col("normalized"), F.lit(key), most, units)).where("d >= 0"), search.FUZZY, F.col("d"))

    def fuzzy_search(self, q: str, limit: int, most: int, engine: str = "optimized", metric: Metric | None = None) -> DataFrame:
        units = self._units(q)
        if engine == "optimized" and routing.use_index(most) and most >= 0 and metric is None:
            return top_k(search.scored(self._near(q, most, units), self.corpus, self.top), max(limit, 0), best_first(in_units=units)).select(*search.RESULT)
        return search.fuzzy_search(self.corpus, q, limit, most, metric, units, self.top)

    def search(self, q: str, limit: int, engine: str = "optimized") -> DataFrame:
        units = self._units(q)

        def find(own: str, most: int) -> DataFrame:
            if engine == "optimized" and routing.use_index(most):
                return self._near(own, most, units)
            return search.fuzzy_hits(self.corpus, search.key_of(own), most, units=units)

        return routing.search(self.corpus, q, limit, find, units, self.top)

    def prefix_batch(self, queries: DataFrame, engine: str = "optimized") -> DataFrame:
        return search.prefix_batch(queries, self.corpus, engine == "optimized", self._units_of(queries), self.top)

    def fuzzy_batch(self, queries: DataFrame, engine: str = "optimized") -> DataFrame:
        """For a table of query_id, q, limit, max_distance, the last at most 2."""
        indexed = engine == "optimized"
        return search.fuzzy_batch(queries, self.corpus, search.MOST, indexed, self.segments_of_all if indexed else None, self._units_of(queries), self.top)

    def search_batch(self, queries: DataFrame, engine: str = "optimized") -> DataFrame:
        units = self._units_of(queries)
        if engine != "optimized":
            return search.search_batch(queries, self.corpus, False, units=units, top=self.top)
        return search.search_batch(queries, self.corpus, True, pages=self.pages, segments=self.segments_of_all, units=units, top=self.top)

    def build(self) -> None:
        """Build what queries read."""
        for table in (self.prefixes, self.pages, self.segments, self.segments_of_all):
            table.count()

    def warm_up(self) -> int:
        """Build all tables and ask the warm-up queries; how many answers they had."""
        self.build()
        asked = self.corpus.sparkSession.createDataFrame([(i, q, 10) for i, q in enumerate(self.WARM_UP)], "query_id int, q string, limit int")
        return sum(self.search_batch(asked).count() for _ in range(self.WARM_ROUNDS))

    def stats(self, engine: str = "optimized") -> dict:
        """Name, size, build times and, of an indexed engine, what its tables hold."""
        held = {"prefixes": self.prefixes.count(), "segments": self.segments.count()} if engine == "optimized" else {}
        return {"name": engine, "size": self.size, "build_millis": dict(self.build_millis)} | held

    def close(self) -> None:
        """Give back what is persisted."""
        for name in ("prefixes", "pages", "segments", "segments_of_all"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()
        self.corpus.unpersist()


_engines: dict[tuple[str, str], Engine] = {}


def shared(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over a folder's documents, built once for a Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        _engines[key] = Engine.from_documents(spark, f"{sf_dir}/documents.parquet")
    return _engines[key]
