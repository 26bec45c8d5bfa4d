"""The registered queries over words of documents, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .engine import Engine, shared
from .folders import work_dir
from .functions import distance, score, text
from .operators import index, search
from .operators.rank import best_first, closest_first, ranked, top_k, top_k_per
from .plans import routing
from .sources import sinks, words
from .streaming.queries import debounced

#: Fixed query sets.
PREFIXES = ("th", "heit", "worth", "s", "é", "inger", "zzz", "", "ciónos")
TYPOS = ("teh", "heitsch", "ingrein", "worthles", "thier", "schne", "th", "eaux", "qwertz", "onthe", "ciónso", "étrre", "fur", "fürr")
PAIRS = (("", ""), ("", "apple"), ("apple", "apple"), ("abc", "xyz"), ("apple", "aple"), ("kitten", "sitting"), ("saturday", "sunday"), ("flaw", "lawn"), ("teh", "the"), ("recieve", "receive"), ("a", "abcdefghij"), ("apple", "apples"), ("für", "fur"), ("éó", "ó"))
BUDGETS = ("", "a", "ap", "app", "appl", "  app  ", "apple", "accommodation")
CORPUS = r"""WITH tok AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}]+')) AS word FROM documents),
entries AS (SELECT word, lower(word) AS normalized, count(*) AS weight FROM tok GROUP BY word),
corpus AS (SELECT arg_min(word, (-weight, word)) AS word, normalized, CAST(sum(weight) AS BIGINT) AS weight FROM entries GROUP BY normalized),
mx AS (SELECT coalesce(max(weight), 0) AS m FROM corpus)"""
POP = "0.3::DOUBLE * least(1.0::DOUBLE, log10(1 + weight) / log10(1 + m))"
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql is not None:
            S[f.__name__] = sql
        return f

    return put


def lev(a: str, b: str) -> str:
    """SQL for the distance in characters: the built-in one counts bytes, so the tables' other letters become digits."""
    of = lambda x: f"translate({x}, 'éóèñçüêäößí', '0123456789_')"
    return f"levenshtein({of(a)}, {of(b)})"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return shared(spark, d).corpus


def values(rows) -> str:
    """SQL rows of strings."""
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 9))


def table(spark: SparkSession, rows, limit: int = 10, most: int = 2) -> DataFrame:
    return spark.createDataFrame([(i, q, limit, most) for i, q in enumerate(rows)], "query_id int, q string, limit int, max_distance int")


def ranked_sql(hits: str, limit: str = "10", by: str = "") -> str:
    """SQL that ranks rows of word, weight, t, d (m beside them)."""
    quality = "CASE WHEN t = 'PREFIX' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1 + d) END"
    cols = f"{by + ', ' if by else ''}word, 0.7::DOUBLE * {quality} + {POP} AS sc, t, d, weight"
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {by + ', ' if by else ''}CAST(rn AS INTEGER) AS rank, word, round(sc, 9) AS score, t AS match_type, CAST(d AS INTEGER) AS edit_distance, weight FROM (
SELECT *, row_number() OVER ({part}ORDER BY sc DESC, length(word), word) AS rn FROM (SELECT {cols}{', lim' if by else ''} FROM ({hits}), mx)) WHERE rn <= {'lim' if by else limit}"""


def prefix_sql(q: str, limit: int) -> str:
    return CORPUS + "\n" + ranked_sql(f"SELECT word, weight, 'PREFIX' AS t, 0 AS d FROM corpus WHERE starts_with(normalized, '{q}')", str(limit))


def fuzzy_sql(q: str, most: int, limit: int = 10) -> str:
    return CORPUS + "\n" + ranked_sql(f"SELECT word, weight, 'FUZZY' AS t, {lev("normalized", repr(q))} AS d FROM corpus WHERE {lev("normalized", repr(q))} <= {most}", str(limit))


def search_sql(rows, limit: int = 10) -> str:
    """Combined search for a table of queries, by the formula for the allowed edits."""
    qs = values((i, q, limit) for i, q in enumerate(rows))
    return CORPUS + f""", q AS (SELECT *, lower(trim(q)) AS k, CASE WHEN length(trim(q)) <= 2 THEN 0 WHEN length(trim(q)) <= 4 THEN 1 ELSE 2 END AS b FROM (VALUES {qs}) v(query_id, q, lim)),
cand AS (SELECT query_id, lim, b, word, weight, CASE WHEN starts_with(normalized, k) THEN 'PREFIX' ELSE 'FUZZY' END AS t, CASE WHEN starts_with(normalized, k) THEN 0 ELSE {lev("normalized", "k")} END AS d FROM corpus, q WHERE starts_with(normalized, k) OR {lev("normalized", "k")} <= b),
n AS (SELECT query_id, count(*) FILTER (d = 0) AS n0, count(*) FILTER (d <= 1) AS n1 FROM cand GROUP BY query_id),
ok AS (SELECT cand.* FROM cand JOIN n USING (query_id) WHERE d <= CASE WHEN n0 >= lim THEN 0 WHEN n1 >= lim THEN least(b, 1) ELSE b END)
""" + ranked_sql("SELECT * FROM ok", by="query_id")


# Corpus.


@query(CORPUS + "\nSELECT word, normalized, weight FROM corpus")
def corpus_dedup(spark, d):
    return corpus(spark, d).select("word", "normalized", "weight")


@query(CORPUS + "\nSELECT count(*) AS words, CAST(sum(weight) AS BIGINT) AS tokens, max(length(normalized)) AS longest, (SELECT count(*) FROM entries) - count(*) AS merged_away FROM corpus")
def corpus_stats(spark, d):
    c = corpus(spark, d).agg(F.count("*").alias("words"), F.sum("weight").alias("tokens"), F.max(F.length("normalized")).cast("long").alias("longest"))
    n = words.tokens(spark.read.parquet(f"{d}/documents.parquet")).agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(n)).select("words", "tokens", "longest", (F.col("n") - F.col("words")).alias("merged_away"))


@query(CORPUS + "\nSELECT weight, count(*) AS words FROM corpus GROUP BY weight")
def weight_tie_density(spark, d):
    return corpus(spark, d).groupBy("weight").agg(F.count("*").alias("words"))


@query(CORPUS + "\nSELECT m AS max_weight FROM mx")
def max_weight(spark, d):
    return index.max_weight(corpus(spark, d))


#: A word list of every kind of line, made of the parts' names: in SQL and, below, in Spark.
LIST = r"""WITH raw AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 10 = 0 THEN '# ' || p_name WHEN p_partkey % 10 = 1 THEN '  ' WHEN p_partkey % 10 = 2 THEN p_name || ', ' || p_size WHEN p_partkey % 10 = 3 THEN upper(p_name) || ';' || p_size
WHEN p_partkey % 10 = 4 THEN p_name WHEN p_partkey % 10 = 5 THEN p_name || chr(9) || 'x' || chr(9) || p_size WHEN p_partkey = 7 THEN 'far too many' || chr(9) || '99999999999999999999' ELSE ' ' || p_name || chr(9) || p_size || ' ' END AS line FROM part),
parsed AS (SELECT pos, trim(line) AS t, regexp_extract(trim(line), '^(.+?)[\t,; ]+(\d+)\s*$', 1) AS term, regexp_extract(trim(line), '^(.+?)[\t,; ]+(\d+)\s*$', 2) AS digits FROM raw),
usable AS (SELECT pos, CASE WHEN digits <> '' THEN trim(term) ELSE t END AS word, least(coalesce(TRY_CAST(nullif(digits, '') AS HUGEINT), 0), 9223372036854775807)::BIGINT AS weight FROM parsed WHERE t <> '' AND NOT starts_with(t, '#') AND NOT contains(CASE WHEN digits <> '' THEN term ELSE t END, chr(9))),
listed AS (SELECT word, lower(word) AS normalized, weight, pos FROM usable),
merged AS (SELECT arg_min(word, (-weight, word)) AS word, normalized, CAST(sum(weight) AS BIGINT) AS weight FROM listed GROUP BY normalized)
"""


def word_list(spark: SparkSession, d: str) -> DataFrame:
    """line_no, line."""
    name, size, at, tab = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey"), F.lit("\t")
    line = F.when(at % 10 == 0, F.concat(F.lit("# "), name)).when(at % 10 == 1, "  ").when(at % 10 == 2, F.concat(name, F.lit(", "), size)).when(at % 10 == 3, F.concat(F.upper(name), F.lit(";"), size))
    line = line.when(at % 10 == 4, name).when(at % 10 == 5, F.concat(name, tab, F.lit("x"), tab, size)).when(at == 7, "far too many\t99999999999999999999").otherwise(F.concat(F.lit(" "), name, tab, size, F.lit(" ")))
    return spark.read.parquet(f"{d}/part.parquet").select(at.alias("line_no"), line.alias("line"))


def listed_file(spark: SparkSession, d: str) -> str:
    path = work_dir(spark)
    word_list(spark, d).repartitionByRange(1, "line_no").sortWithinPartitions("line_no").select("line").write.text(path)
    return path


@query(LIST + "SELECT (SELECT count(*) FROM raw) AS lines_read, (SELECT count(*) FROM raw) - (SELECT count(*) FROM usable) AS skipped, (SELECT count(*) FROM usable) - count(*) AS merged_away, count(*) AS entries, (SELECT CASE WHEN bool_or(digits <> '') THEN 'COLUMN' ELSE 'RANK' END FROM parsed) AS weight_source FROM merged")
def load_report(spark, d):
    r = words.from_lines(word_list(spark, d))[1]
    return spark.createDataFrame([(r.lines_read, r.skipped, r.merged_away, r.entries, r.weight_source)], "lines_read long, skipped long, merged_away long, entries long, weight_source string")


@query(LIST + "SELECT word, normalized, weight FROM merged")
def load_words(spark, d):
    return words.from_lines(word_list(spark, d))[0].select("word", "normalized", "weight")


@query(LIST + "SELECT word, normalized, weight FROM merged")
def load_file(spark, d):
    return words.load(spark, listed_file(spark, d))[0].select("word", "normalized", "weight")


@query(LIST + ", first AS (SELECT * FROM listed ORDER BY pos LIMIT 40) SELECT arg_min(word, (-weight, word)) AS word, normalized, CAST(sum(weight) AS BIGINT) AS weight FROM first GROUP BY normalized")
def load_limited(spark, d):
    """The limit comes from the session's configuration."""
    spark.conf.set("lexaline.dataset.max-entries", "40")
    try:
        return words.load(spark, listed_file(spark, d))[0].select("word", "normalized", "weight")
    finally:
        spark.conf.unset("lexaline.dataset.max-entries")


@query("SELECT c_custkey, c_acctbal::BIGINT < 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 AS refused FROM customer")
def refused_entries(spark, d):
    name = F.when(F.col("c_custkey") % 7 == 0, "\u3000 ").when(F.col("c_custkey") % 11 != 0, F.col("c_name"))
    entries = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", name.alias("word"), F.lower(name).alias("normalized"), F.bround("c_acctbal").cast("long").alias("weight"))
    return entries.select("c_custkey", words.fault().alias("refused"))


@query("SELECT n_name AS word, lower(n_name) AS normalized, count(*) OVER () - (row_number() OVER (ORDER BY n_nationkey) - 1) AS weight FROM nation")
def rank_weights(spark, d):
    lines = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("line_no"), F.col("n_name").alias("line"))
    return words.weighted(words.parse(lines)).select("word", "normalized", "weight")


@query(r"SELECT p_partkey, lower(trim(p_name)) AS normalized FROM part")
def normalize_keys(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.normalize(F.concat(F.lit("\t "), "p_name", F.lit(" \n"))).alias("normalized"))


# Scalars.


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "a string, b string")


@query(f"SELECT a, b, CAST({lev("a", "b")} AS INTEGER) AS distance FROM (VALUES {values(PAIRS)}) v(a, b)")
def levenshtein_exact(spark, d):
    return pairs(spark).withColumn("distance", distance.distance(F.col("a"), F.col("b")))


@query(CORPUS + f"""\nSELECT normalized, CAST(least({lev("normalized", "'heitsch'")}, 4) AS INTEGER) AS distance FROM corpus""")
def levenshtein_cutoff(spark, d):
    return corpus(spark, d).select("normalized", distance.distance_with_cutoff(F.col("normalized"), F.lit("heitsch"), 3).alias("distance"))


@query(f"SELECT a, b, {lev("a", "b")} <= 2 AS within FROM (VALUES {values(PAIRS)}) v(a, b)")
def is_within(spark, d):
    return search.within(pairs(spark), 2)


@query(f"""SELECT a, b, i, j, CAST({lev("substr(a, 1, i)", "substr(b, 1, j)")} AS INTEGER) AS distance FROM (SELECT a, b, i, unnest(range(0, length(b) + 1)) AS j FROM (SELECT a, b, unnest(range(0, length(a) + 1)) AS i FROM (VALUES {values(PAIRS)}) v(a, b)))""")
def distance_table(spark, d):
    rows = pairs(spark).select("a", "b", F.posexplode(distance.table(F.col("a"), F.col("b"))).alias("i", "row"))
    return rows.select("a", "b", F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "distance")).withColumn("j", F.col("j").cast("long"))


@query(f"SELECT q, CASE WHEN length(trim(q)) <= 2 THEN 0 WHEN length(trim(q)) <= 4 THEN 1 ELSE 2 END AS budget FROM (VALUES {values((b,) for b in BUDGETS)}) v(q)")
def fuzzy_budget(spark, d):
    return spark.createDataFrame([(b,) for b in BUDGETS], "q string").withColumn("budget", score.budget(F.col("q")))


@query(CORPUS + f"\nSELECT normalized, t AS match_type, d AS edit_distance, round(0.7::DOUBLE * CASE WHEN t = 'PREFIX' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1 + d) END + {POP}, 9) AS score FROM corpus, mx, (VALUES ('PREFIX', 0), ('FUZZY', 1), ('FUZZY', 2), ('FUZZY', 3)) v(t, d)")
def relevance_score(spark, d):
    c = corpus(spark, d)
    kinds = spark.createDataFrame([("PREFIX", 0), ("FUZZY", 1), ("FUZZY", 2), ("FUZZY", 3)], "match_type string, edit_distance int")
    return rounded(search.scored(c.crossJoin(F.broadcast(kinds)), c)).select("normalized", "match_type", "edit_distance", "score")


# Lookups.

KEYS = ("the", "heit", "teh", "worth", "th", "zzz", "")


def keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in KEYS], "key string")


@query(CORPUS + f"\nSELECT key, key IN (SELECT normalized FROM corpus) AS found FROM (VALUES {values((k,) for k in KEYS)}) v(key)")
def contains_lookup(spark, d):
    return index.contains(corpus(spark, d), keys(spark))


@query(CORPUS + f"\nSELECT key, coalesce(weight, 0) AS weight FROM (VALUES {values((k,) for k in KEYS)}) v(key) LEFT JOIN corpus ON key = normalized")
def weight_of(spark, d):
    return index.weight_of(corpus(spark, d), keys(spark))


@query(CORPUS + f"\nSELECT key, word, weight FROM (VALUES {values((k,) for k in KEYS)}) v(key) JOIN corpus ON key = normalized")
def lookup(spark, d):
    return index.lookup(corpus(spark, d), keys(spark))


@query(CORPUS + f"\nSELECT key, key = '' OR EXISTS (SELECT 1 FROM corpus WHERE starts_with(normalized, key)) AS found FROM (VALUES {values((k,) for k in KEYS)}) v(key)")
def has_prefix(spark, d):
    return index.has_prefix(shared(spark, d).prefixes, keys(spark))


# Prefix search.


@query(CORPUS + "\nSELECT CAST(row_number() OVER (ORDER BY weight DESC, length(word), word) AS BIGINT) AS rank, word, weight FROM corpus WHERE starts_with(normalized, 'heit')")
def prefix_all(spark, d):
    return search.all_with_prefix(corpus(spark, d), "heit")


@query(prefix_sql("th", 10))
def prefix_topk(spark, d):
    return rounded(shared(spark, d).prefix_search("TH ", 10, "naive"))


@query(prefix_sql("", 10))
def prefix_topk_empty_query(spark, d):
    return rounded(shared(spark, d).prefix_search("", 10, "naive"))


PREFIX_BATCH = CORPUS + f", q AS (SELECT * FROM (VALUES {values((i, q, 10) for i, q in enumerate(PREFIXES))}) v(query_id, q, lim))\n" + ranked_sql("SELECT query_id, lim, word, weight, 'PREFIX' AS t, 0 AS d FROM corpus, q WHERE starts_with(normalized, q)", by="query_id")


@query(PREFIX_BATCH)
def prefix_topk_batch(spark, d):
    return rounded(shared(spark, d).prefix_batch(table(spark, PREFIXES)))


@query(PREFIX_BATCH)
def prefix_topk_scan_batch(spark, d):
    return rounded(shared(spark, d).prefix_batch(table(spark, PREFIXES), "naive"))


@query(PREFIX_BATCH)
def prefix_topk_indexed(spark, d):
    return rounded(search.prefix_page(table(spark, PREFIXES), shared(spark, d).pages))


PREFIX_INDEX = CORPUS + """, p AS (SELECT unnest(range(0, length(normalized) + 1)) AS n, normalized, weight FROM corpus),
own AS (SELECT substr(normalized, 1, n) AS prefix, max(weight) AS max_subtree_weight, count(*) AS words, bool_or(n = length(normalized)) AS is_terminal FROM p GROUP BY 1),
ch AS (SELECT substr(prefix, 1, length(prefix) - 1) AS prefix, count(*) AS child_count FROM own WHERE prefix <> '' GROUP BY 1),
ix AS (SELECT prefix, max_subtree_weight, words, is_terminal, coalesce(child_count, 0) AS child_count FROM own LEFT JOIN ch USING (prefix))
"""


@query(PREFIX_INDEX + "SELECT * FROM ix")
def prefix_index_bounds(spark, d):
    return index.prefix_index(corpus(spark, d))


@query(PREFIX_INDEX + "SELECT 1 + count(*) FILTER (prefix <> '') AS nodes FROM ix")
def trie_node_count(spark, d):
    return index.node_count(shared(spark, d).prefixes)


@query(PREFIX_INDEX.rstrip() + """,
k AS (SELECT CASE WHEN count(*) = 10 THEN min(weight) ELSE -1 END AS w FROM (SELECT weight FROM corpus WHERE starts_with(normalized, 's') ORDER BY weight DESC LIMIT 10))
SELECT count(*) AS nodes_expanded, CAST(1 + sum(child_count + is_terminal::INT) AS BIGINT) AS frontier_pushes FROM ix, k WHERE starts_with(prefix, 's') AND max_subtree_weight >= w""")
def prefix_traversal_stats(spark, d):
    e = shared(spark, d)
    return index.traversal_stats(e.prefixes, e.corpus, "s", 10)


# Fuzzy search.


@query(fuzzy_sql("heitsch", 0))
def fuzzy_d0(spark, d):
    return rounded(shared(spark, d).fuzzy_search("heitsch", 10, 0, "naive"))


@query(fuzzy_sql("heitsch", 1))
def fuzzy_d1(spark, d):
    return rounded(shared(spark, d).fuzzy_search("heitsch", 10, 1, "naive"))


@query(fuzzy_sql("teh", 2))
def fuzzy_d2(spark, d):
    return rounded(shared(spark, d).fuzzy_search("teh", 10, 2, "naive"))


@query(fuzzy_sql("worthles", 3))
def fuzzy_d3(spark, d):
    return rounded(shared(spark, d).fuzzy_search("worthles", 10, 3, "naive"))


@query(fuzzy_sql("ingrein", 1))
def fuzzy_indexed_d1(spark, d):
    return rounded(shared(spark, d).fuzzy_search("ingrein", 10, 1))


FUZZY_BATCH = CORPUS + f", q AS (SELECT * FROM (VALUES {values((i, q, 10) for i, q in enumerate(TYPOS))}) v(query_id, q, lim))\n" + ranked_sql(f"SELECT query_id, lim, word, weight, 'FUZZY' AS t, {lev('normalized', 'q')} AS d FROM corpus, q WHERE {lev('normalized', 'q')} <= 2", by="query_id")


@query(FUZZY_BATCH)
def fuzzy_batch(spark, d):
    return rounded(shared(spark, d).fuzzy_batch(table(spark, TYPOS), "naive"))


@query(FUZZY_BATCH)
def fuzzy_indexed_batch(spark, d):
    return rounded(shared(spark, d).fuzzy_batch(table(spark, TYPOS)))


@query(CORPUS + "\nSELECT CAST(row_number() OVER (ORDER BY d, length(normalized), normalized) AS INTEGER) AS rank, normalized, CAST(d AS INTEGER) AS distance FROM (SELECT normalized, " + lev("normalized", "'ingrein'") + " AS d FROM corpus) WHERE d <= 2")
def closest_first_range(spark, d):
    hits = search.fuzzy_hits(corpus(spark, d), search.key_of("ingrein"), 2).select("normalized", F.col("edit_distance").alias("distance"))
    return ranked(hits, closest_first()).withColumn("rank", F.col("rank").cast("int"))


# Combined search.


@query(CORPUS + "\n" + ranked_sql("SELECT word, weight, CASE WHEN starts_with(normalized, 'heit') THEN 'PREFIX' ELSE 'FUZZY' END AS t, CASE WHEN starts_with(normalized, 'heit') THEN 0 ELSE " + lev("normalized", "'heit'") + " END AS d FROM corpus WHERE starts_with(normalized, 'heit') OR " + lev("normalized", "'heit'") + " <= 2", "500"))
def merge_prefix_wins(spark, d):
    c = corpus(spark, d)
    prefix = search._hits(c.where(F.col("normalized").startswith("heit")), score.PREFIX, F.lit(0))
    hits = search.merge(prefix, search.fuzzy_hits(c, search.key_of("heit"), 2), [])
    return rounded(top_k(search.scored(hits, c), 500, best_first()).select(*search.RESULT))


def one_search(q: str, limit: int = 10):
    def run(spark, d):
        return rounded(shared(spark, d).search(q, limit))

    return run


for _name, _q, _limit in (("search_short_circuit", "th", 10), ("search_relax_d1", "heit", 300), ("search_relax_d2", "worthles", 10), ("search_short_query", "ou", 10)):
    _run = one_search(_q, _limit)
    _run.__name__ = _name
    query(f"SELECT rank, word, score, match_type, edit_distance, weight FROM ({search_sql((_q,), _limit)})")(_run)


@query(search_sql((*PREFIXES, *TYPOS)))
def search_batch(spark, d):
    return rounded(shared(spark, d).search_batch(table(spark, (*PREFIXES, *TYPOS))))


@query(search_sql((*PREFIXES, *TYPOS)))
def search_scan_batch(spark, d):
    return rounded(shared(spark, d).search_batch(table(spark, (*PREFIXES, *TYPOS)), "naive"))


@query(f"SELECT query_id, count(*) AS results, true AS identical FROM ({search_sql((*PREFIXES, *TYPOS))}) GROUP BY query_id")
def compare_engines(spark, d):
    """Results of both engines, and whether both have the very same rows."""
    e, q = shared(spark, d), table(spark, (*PREFIXES, *TYPOS))
    each = [e.search_batch(q, kind).groupBy("query_id").agg(F.count("*").alias(kind), F.array_sort(F.collect_list(F.struct(*search.RESULT))).alias(f"{kind}_rows")) for kind in ("naive", "optimized")]
    return each[0].join(each[1], "query_id", "full").select("query_id", F.coalesce("optimized", "naive").alias("results"), F.coalesce(F.col("naive_rows") == F.col("optimized_rows"), F.lit(False)).alias("identical"))


SINGLE = ("fürr", "th")


@query(f"SELECT query_id, string_agg(word, ' ' ORDER BY rank) AS words, true AS identical FROM ({search_sql(SINGLE, 5)}) GROUP BY query_id")
def compare_requests(spark, d):
    """The same by the guarded comparison of one request at a time."""
    got = [(i, api.compare(shared(spark, d), q, "5")) for i, q in enumerate(SINGLE)]
    return spark.createDataFrame([(i, " ".join(r["word"] for r in g["optimized"]), g["identical"] and g["speedup"] > 0) for i, g in got], "query_id int, words string, identical boolean")


@query(CORPUS + ", s AS (SELECT count(*) AS n, coalesce(sum(length(normalized) + 1), 0) AS letters FROM corpus) SELECT 'UP' AS status, 'optimized' AS name, n AS size, (SELECT count(DISTINCT substr(normalized, 1, i)) FROM corpus, range(0, 200) r(i) WHERE i <= length(normalized)) AS prefixes, 2 * n AS segments FROM s")
def engine_stats(spark, d):
    h = api.health(shared(spark, d))
    return spark.createDataFrame([(h["status"], h["name"], h["size"], h["prefixes"], h["segments"])], "status string, name string, size long, prefixes long, segments long")


@query(CORPUS + f", q AS (SELECT * FROM (VALUES {values(enumerate(TYPOS))}) v(query_id, q)) SELECT query_id, count(*) AS candidates_verified, count(*) FILTER ({lev('normalized', 'q')} <= 2) AS found FROM q, corpus WHERE length(normalized) BETWEEN length(q) - 2 AND length(q) + 2 GROUP BY query_id")
def candidates_scan(spark, d):
    return search.candidates(table(spark, TYPOS), corpus(spark, d), indexed=False)


@query(CORPUS + f", q AS (SELECT * FROM (VALUES {values(enumerate(TYPOS))}) v(query_id, q)) SELECT query_id, count(*) FILTER ({lev('normalized', 'q')} <= 2) AS found, true AS fewer FROM q, corpus WHERE length(normalized) BETWEEN length(q) - 2 AND length(q) + 2 GROUP BY query_id")
def candidates_indexed(spark, d):
    """Of fewer words the distance is computed, and as many are found."""
    q, e = table(spark, TYPOS), shared(spark, d)
    by_scan = search.candidates(q, e.corpus, indexed=False).select("query_id", F.col("candidates_verified").alias("scan"))
    return search.candidates(q, e.corpus, segments=e.segments_of_all).join(by_scan, "query_id").select("query_id", "found", (F.col("candidates_verified") <= F.col("scan")).alias("fewer"))


TREE = CORPUS + """, s AS (SELECT normalized, row_number() OVER (ORDER BY weight DESC, normalized) AS pos FROM corpus QUALIFY pos <= 400)"""


@query(TREE.replace("WITH", "WITH RECURSIVE", 1) + f""", t AS (SELECT 1 AS depth, '' AS branch, normalized, pos FROM s
UNION ALL SELECT depth + 1, branch || '/' || {lev("normalized", "node")}, normalized, pos FROM (SELECT *, first_value(normalized) OVER (PARTITION BY branch ORDER BY pos) AS node FROM t) WHERE node <> normalized)
SELECT CAST(max(depth) AS BIGINT) AS depth FROM t""")
def metric_tree_depth(spark, d):
    top = [r["normalized"] for r in words.slice_of(corpus(spark, d), 400).collect()]
    return spark.createDataFrame([(index.metric_tree_depth(top),)], "depth long")


@query(CORPUS + "\n" + ranked_sql("SELECT word, weight, 'FUZZY' AS t, abs(length(normalized) - 5) AS d FROM corpus WHERE abs(length(normalized) - 5) <= 1", "25"))
def fuzzy_other_metric(spark, d):
    """Under another metric: the difference in length."""
    metric = lambda a, b: F.abs(F.length(a) - F.length(b))
    return rounded(shared(spark, d).fuzzy_search("heits", 25, 1, metric=metric))


# Beyond the basic plane: every second e is a character of two units, in SQL two characters of its own.

WIDE = CORPUS.replace("lower(word) AS normalized", "replace(lower(word), 'e', '\U0001F600') AS normalized").replace("SELECT word, replace", "SELECT replace(lower(word), 'e', '\U0001F600') AS word, replace", 1).replace("FROM tok GROUP BY word", "FROM tok WHERE length(word) BETWEEN 4 AND 7 GROUP BY ALL")
WIDE_QUERIES = tuple(q.replace("e", "\U0001F600") for q in ("heitsch", "eaux", "these", "her", "worthles", "ment", "schne", "été"))


def wide(expr: str) -> str:
    return f"replace({expr}, '\U0001F600', 'XY')"


def wide_sql(rows) -> str:
    """The combined search with lengths, order and distances in units."""
    qs, n, low = values((i, q, 10) for i, q in enumerate(rows)), f"length({wide('q')})", wide("normalized")
    d = lev(low, wide("k"))
    sql = f""", q AS (SELECT *, lower(q) AS k, CASE WHEN {n} <= 2 THEN 0 WHEN {n} <= 4 THEN 1 ELSE 2 END AS b FROM (VALUES {qs}) v(query_id, q, lim)),
cand AS (SELECT query_id, lim, b, word, weight, CASE WHEN starts_with(normalized, k) THEN 'PREFIX' ELSE 'FUZZY' END AS t, CASE WHEN starts_with(normalized, k) THEN 0 ELSE {d} END AS d FROM corpus, q WHERE starts_with(normalized, k) OR {d} <= b),
n AS (SELECT query_id, count(*) FILTER (d = 0) AS n0, count(*) FILTER (d <= 1) AS n1 FROM cand GROUP BY query_id),
ok AS (SELECT cand.* FROM cand JOIN n USING (query_id) WHERE d <= CASE WHEN n0 >= lim THEN 0 WHEN n1 >= lim THEN least(b, 1) ELSE b END)
"""
    return WIDE + sql + ranked_sql("SELECT * FROM ok", by="query_id").replace("length(word), word)", f"length({wide('word')}), {wide('word')})")


_wide: dict[tuple[str, str], Engine] = {}


def wide_engine(spark: SparkSession, d: str) -> Engine:
    key = (spark.sparkContext.applicationId, d)
    if key not in _wide:
        own = words.tokens(spark.read.parquet(f"{d}/documents.parquet")).where(F.length("word").between(4, 7))
        word = F.replace(F.lower("word"), F.lit("e"), F.lit("\U0001F600"))
        _wide[key] = Engine(words.deduplicate(own.select("ord", word.alias("word"), word.alias("normalized"), "weight").groupBy("ord", "word", "normalized").agg(F.sum("weight").alias("weight"))))
    return _wide[key]


@query(wide_sql(WIDE_QUERIES))
def search_wide_batch(spark, d):
    return rounded(wide_engine(spark, d).search_batch(table(spark, WIDE_QUERIES)))


@query(wide_sql(WIDE_QUERIES))
def search_wide_scan_batch(spark, d):
    return rounded(wide_engine(spark, d).search_batch(table(spark, WIDE_QUERIES), "naive"))


@query(f"SELECT rank, word, score, match_type, edit_distance, weight FROM ({wide_sql(WIDE_QUERIES[3:4])})")
def search_wide_single(spark, d):
    return rounded(wide_engine(spark, d).search(WIDE_QUERIES[3], 10))


# Responses, guards, labels and points.


@query(f"SELECT query_id, to_json({{'query_id': query_id, 'result_count': count(*), 'results': list({{'word': word, 'score': score, 'match_type': match_type, 'edit_distance': edit_distance, 'weight': weight}} ORDER BY rank)}})::VARCHAR AS response FROM ({search_sql(TYPOS, 3)}) GROUP BY query_id")
def json_responses(spark, d):
    return sinks.responses(rounded(shared(spark, d).search_batch(table(spark, TYPOS, 3))), ["query_id"]).select("query_id", "response")


@query("""SELECT conv_id, turn, CASE WHEN message IS NULL THEN 200 ELSE 400 END AS status, CASE WHEN message IS NOT NULL THEN 'invalid_request' END AS error, message FROM (
SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'q is required' WHEN length(q) > 64 THEN 'q must have at most 64 characters' WHEN turn % 3 = 2 THEN 'limit must be a number' WHEN conv_id % 60 NOT BETWEEN 1 AND 50 THEN 'limit must be from 1 to 50' END AS message FROM (SELECT *, substr(text, 1, 60 + turn::INTEGER * 2) AS q FROM conversations))""")
def guarded_requests(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    limit = F.when(F.col("turn") % 3 == 2, "many").otherwise((F.col("conv_id") % 60).cast("string"))
    q = F.when(F.col("turn") % 5 != 4, F.substring("text", F.lit(1), 60 + F.col("turn").cast("int") * 2))
    return api.validated(c.select("conv_id", "turn", q.alias("q"), limit.alias("limit"))).select("conv_id", "turn", "status", "error", "message")


@query("SELECT * FROM (VALUES ('GET', '/api/search', 200, NULL), ('POST', '/api/search', 405, 'method_not_allowed'), ('GET', '/api/nothing', 404, 'not_found'), ('GET', '/api/compare', 400, 'invalid_request'), ('GET', '/health', 200, NULL)) v(method, path, status, error)")
def error_mapping(spark, d):
    import json

    e, out = shared(spark, d), []
    for method, path, given in (("GET", "/api/search", {"q": " "}), ("POST", "/api/search", {}), ("GET", "/api/nothing", {}), ("GET", "/api/compare", {"q": "x", "limit": "0"}), ("GET", "/health", {})):
        status, body = api.handle(e, method, path, given)
        out.append((method, path, status, json.loads(body).get("error")))
    return spark.createDataFrame(out, "method string, path string, status int, error string")


@query(CORPUS + "\nSELECT word, CASE WHEN starts_with(lower(word), 'heit') THEN substr(word, 1, 4) ELSE '' END AS head, CASE WHEN starts_with(lower(word), 'heit') THEN substr(word, 5) ELSE word END AS tail FROM corpus")
def highlighted(spark, d):
    return corpus(spark, d).select("word", text.highlight(F.col("word"), F.lit(" HEIT")).alias("h")).select("word", "h.head", "h.tail")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN m >= 1000 THEN printf('%.2f ms', m / 1000) WHEN m >= 10 THEN printf('%.0f µs', m) ELSE printf('%.2f µs', m) END AS micros, CASE WHEN s IS NULL OR isinf(s) THEN '—' WHEN s >= 100 THEN printf('%.0f×', s) WHEN s >= 10 THEN printf('%.1f×', s) ELSE printf('%.2f×', s) END AS speedup, format('{:,}', l_partkey * 1000) AS n FROM (SELECT *, l_suppkey::DOUBLE / 4 + 0.0625 AS m, l_quantity / nullif(l_linenumber - 1, 0) + 0.03125 AS s FROM lineitem)")
def labels(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    micros, speedup = F.col("l_suppkey").cast("double") / 4 + 0.0625, F.col("l_quantity") / F.nullif(F.col("l_linenumber") - 1, F.lit(0)) + 0.03125
    return rows.select("l_orderkey", "l_linenumber", text.micros_label(micros).alias("micros"), text.speedup_label(speedup).alias("speedup"), text.count_label(F.col("l_partkey") * 1000).alias("n"))


@query("SELECT l_orderkey, l_linenumber, 1e6::DOUBLE / l_extendedprice AS ops_per_second, l_tax <> 0.01 AND l_discount * 100 <= 0.25 * l_quantity AS reliable, l_extendedprice / l_quantity AS speedup FROM lineitem")
def benchmark_points(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    error = F.when(F.col("l_tax") == 0.01, float("nan")).otherwise(F.col("l_discount") * 100)
    rates = sinks.with_rates(rows.select("*", F.col("l_quantity").alias("micros"), error.alias("error_micros"))).drop("micros", "error_micros", "ops_per_second")
    points = sinks.with_rates(rates.select("l_orderkey", "l_linenumber", F.col("reliable").alias("r"), F.col("l_extendedprice").alias("micros"), F.lit(0.0).alias("error_micros"), "l_quantity"))
    return sinks.with_speedup(points, "micros", "l_quantity").select("l_orderkey", "l_linenumber", "ops_per_second", F.col("r").alias("reliable"), "speedup")


@query("SELECT kind, r_regionkey, r_name FROM region, (VALUES ('csv'), ('json')) v(kind)")
def written_points(spark, d):
    points, at = spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", "r_name"), work_dir(spark)
    sinks.write_points(points, at)
    csv, json = (sinks.read_points(points, at, kind).select(F.lit(kind).alias("kind"), "r_regionkey", "r_name") for kind in ("csv", "json"))
    return csv.unionByName(json)


@query("SELECT user_id, CAST((floor(epoch(ts))::BIGINT // 3600 + 1) * 3600 AS BIGINT) AS ends, arg_max(event_type, ts) AS q FROM events GROUP BY ALL")
def debounced_keystrokes(spark, d):
    """The last of each user's queries in each hour; on a stream a second is usual."""
    keys = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", F.col("event_type").alias("q"), F.lit(10).alias("limit"))
    return debounced(keys, "1 hour").select("user_id", F.unix_timestamp("ts").alias("ends"), "q")


# Generated queries and slices.


@query(CORPUS + "\nSELECT normalized, substr(normalized, 1, length(normalized) // 2) || substr(normalized, length(normalized) // 2 + 2) AS typo FROM corpus WHERE length(normalized) >= 6")
def typo_queries(spark, d):
    half = F.expr("length(normalized) div 2").cast("int")
    typo = F.concat(F.substring("normalized", F.lit(1), half), F.substring("normalized", half + 2, F.length("normalized")))
    return corpus(spark, d).where(F.length("normalized") >= 6).select("normalized", typo.alias("typo"))


@query(CORPUS + "\nSELECT DISTINCT substr(normalized, 1, 3) AS prefix FROM (SELECT * FROM corpus ORDER BY weight DESC, normalized LIMIT 1000) WHERE length(normalized) >= 3")
def prefix_queries(spark, d):
    top = words.slice_of(corpus(spark, d), 1000)
    return top.where(F.length("normalized") >= 3).select(F.substring("normalized", 1, 3).alias("prefix")).distinct()


@query(CORPUS + ", r AS (SELECT *, row_number() OVER (ORDER BY weight DESC, normalized) AS pos FROM corpus) SELECT n AS slice, count(*) AS words, CAST(sum(weight) AS BIGINT) AS tokens, 0::BIGINT AS outside FROM r, (VALUES (1000), (10000)) v(n) WHERE pos <= n GROUP BY n")
def nested_slices(spark, d):
    """Slices of the heaviest words, and how many of a slice's words the next larger one lacks."""
    c, out = corpus(spark, d), None
    for small, large in ((1000, 10000), (10000, 50000)):
        a, b = (words.slice_of(c, n).select("normalized", "weight") for n in (small, large))
        own = a.join(b.select("normalized", F.lit(1).alias("there")), "normalized", "left")
        row = own.agg(F.lit(small).alias("slice"), F.count("*").alias("words"), F.sum("weight").alias("tokens"), F.count_if(F.col("there").isNull()).alias("outside"))
        out = row if out is None else out.unionByName(row)
    return out


@query(CORPUS + "\nSELECT word, length(normalized) AS n FROM corpus QUALIFY row_number() OVER (PARTITION BY length(normalized) ORDER BY weight DESC, length(word), word) <= 3")
def top_k_per_group(spark, d):
    rows = corpus(spark, d).select("word", "weight", F.length("normalized").cast("long").alias("n"))
    return top_k_per(rows, ["n"], 3, best_first("weight")).select("word", "n")


@query(CORPUS + "\nSELECT budget, budget <= 1 AS by_index, count(*) AS words FROM (SELECT CASE WHEN length(word) <= 2 THEN 0 WHEN length(word) <= 4 THEN 1 ELSE 2 END AS budget FROM corpus) GROUP BY budget")
def candidate_routing(spark, d):
    """By which plan the words of the corpus would be looked for, if each were a query."""
    own = corpus(spark, d).select(score.budget(F.col("word")).alias("budget")).groupBy("budget").agg(F.count("*").alias("words"))
    by_index = F.create_map(*(F.lit(x) for b in range(4) for x in (b, routing.use_index(b))))
    return own.select("budget", by_index[F.col("budget")].alias("by_index"), "words")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return search_batch(spark, d)
