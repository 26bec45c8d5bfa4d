"""Search: fixtures, scan against indexed plans against plain Python, guards, plans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexaline import api
from lexaline.engine import Engine
from lexaline.functions import distance
from lexaline.functions.distance import in_units, rows_of
from lexaline.functions.score import budget_of
from lexaline.operators import index, search
from lexaline.operators.rank import BoundedTop, best_first, top_k
from lexaline.plans import routing
from lexaline.sources import words


def corpus_of(spark, entries):
    rows = [(i, w, w.lower(), n) for i, (w, n) in enumerate(entries)]
    return words.deduplicate(words.checked(spark.createDataFrame(rows, "ord long, word string, normalized string, weight long")))


BASIC = [("apple", 5000), ("apply", 3000), ("application", 8000), ("ape", 400), ("banana", 900), ("band", 2000), ("orange", 100)]


@pytest.fixture(scope="module")
def basic(spark):
    return Engine(corpus_of(spark, BASIC))


def found(df):
    return [r["word"] for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("kind", ["optimized", "naive"])
def test_basic(basic, kind):
    assert found(basic.prefix_search("app", 10, kind)) == ["application", "apple", "apply"]
    assert found(basic.prefix_search(" BANA", 10, kind)) == ["banana"] and found(basic.prefix_search("zebra", 10, kind)) == []
    assert found(basic.prefix_search("", 3, kind)) == ["application", "apple", "apply"] and found(basic.prefix_search("a", 0, kind)) == []
    assert set(found(basic.fuzzy_search("aple", 10, 1, kind))) == {"apple", "ape"} and found(basic.fuzzy_search("apple", 10, 0, kind)) == ["apple"]
    assert found(basic.fuzzy_search("bend", 10, 2, kind))[0] == "band"
    assert {r["match_type"] for r in basic.search("ap", 10, kind).collect()} == {"PREFIX"}
    with pytest.raises(ValueError):
        basic.fuzzy_search("a", 1, -1, kind)


@pytest.mark.parametrize("kind", ["optimized", "naive"])
def test_relaxation_prefers_the_least_edits(spark, kind):
    e = Engine(corpus_of(spark, [("relieve", 500), ("receive", 10**7), ("banana", 1000), ("zebra", 1000), ("mango", 1000)]))
    assert found(e.search("recieve", 1, kind)) == ["relieve"] and found(e.search("recieve", 5, kind)) == ["receive", "relieve"]
    e = Engine(corpus_of(spark, [("search", 10**7), ("searched", 5 * 10**6), ("searching", 4 * 10**6), ("searches", 3 * 10**6), ("searchable", 100), ("seatch", 9 * 10**8), ("scarch", 8 * 10**8)]))
    assert found(e.search("search", 3, kind)) == found(e.prefix_search("search", 3, kind))
    e = Engine(corpus_of(spark, [("app", 100), ("apps", 90), ("apple", 80), ("ape", 70), ("axe", 60)]))
    rows = e.search("app", 10, kind).collect()
    assert [r["match_type"] for r in rows if r["word"] == "apps"] == ["PREFIX"]
    e = Engine(corpus_of(spark, [(w, 0) for w in ("car", "cart", "care", "cars", "card", "cat")]))
    assert found(e.search("car", 5, kind)) == ["car", "card", "care", "cars", "cart"]
    e = Engine(corpus_of(spark, [("Apple", 30), ("apple", 70), ("APPLE", 5), ("apply", 200), ("apt", 50)]))
    assert {r["word"]: r["weight"] for r in e.prefix_search("appl", 10, kind).collect()} == {"apple": 105, "apply": 200}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_segments_find_all_once(spark, k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))
    have, asked = sorted({word() for _ in range(150)}), [word() for _ in range(60)]
    corpus = spark.createDataFrame([(0, w, w, 1) for w in have], "ord long, word string, normalized string, weight long")
    df = spark.createDataFrame([(i, q, 9, k) for i, q in enumerate(asked)], "query_id int, q string, limit int, max_distance int")
    want = sorted((i, w) for i, q in enumerate(asked) for w in have if rows_of(in_units(w), in_units(q))[-1][-1] <= k)
    got = sorted((r["query_id"], r["normalized"]) for r in search.fuzzy_pairs(df, corpus, k, True).collect())
    assert got == want == sorted((r["query_id"], r["normalized"]) for r in search.fuzzy_pairs(df, corpus, k, False).collect())
    probed = index.with_probes(df.select("query_id", F.col("q").alias("key")), k).groupBy("query_id").agg(F.sort_array(F.collect_set("probe")).alias("p"))
    assert {r["query_id"]: r["p"] for r in probed.collect()} == {i: index.probes(q, k) for i, q in enumerate(asked)}


def test_queries_in_several_blocks(spark, basic, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    df = spark.createDataFrame([(i, q, 5, 2) for i, q in enumerate(["app", "aple", "bend", "", "oran", "x"] * 4)], "query_id int, q string, limit int, max_distance int")
    assert len(search.blocks(df)) == 8
    for run in (basic.search_batch, basic.prefix_batch, basic.fuzzy_batch):
        assert sorted(map(str, run(df, "naive").collect())) == sorted(map(str, run(df).collect()))


def test_a_distance_that_is_no_metric(spark):
    """Swaps break the triangle inequality, the plain distance keeps it; a scan takes either as its metric."""

    def osa(a, b):
        """Distance that swaps neighbours too, but no letter twice: not a metric."""
        t = rows_of(in_units(a), in_units(b))
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
        return t[-1][-1]

    assert (osa("CA", "AC"), osa("AC", "ABC"), osa("CA", "ABC")) == (1, 1, 3)
    rows = spark.createDataFrame([("CA", "AC"), ("AC", "ABC"), ("CA", "ABC")], "a string, b string")
    assert [r[0] for r in rows.select(distance.distance(F.col("a"), F.col("b"))).collect()] == [2, 1, 3]
    swaps = F.udf(osa, "int")
    e = Engine(corpus_of(spark, [("ac", 5), ("abc", 3), ("xyz", 2)]))
    assert found(e.fuzzy_search("ca", 10, 1, metric=swaps)) == ["ac"] and found(e.fuzzy_search("ca", 10, 1)) == []


def test_ranked(spark):
    rows = spark.createDataFrame([(f"w{i % 97}", float(i % 7)) for i in range(500)], "word string, score double").repartition(7)
    got = search.ranked(rows, best_first()).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert [(r["word"], r["score"]) for r in got] == sorted(((r["word"], r["score"]) for r in got), key=lambda x: (-x[1], len(x[0]), x[0]))
    assert search.ranked(rows.limit(0), best_first()).count() == 0


def test_warm_up_asks(spark):
    e = Engine(corpus_of(spark, BASIC))
    assert e.warm_up() == 3 * e.search_batch(spark.createDataFrame([(i, q, 10) for i, q in enumerate(e.WARM_UP)], "query_id int, q string, limit int")).count() > 0
    assert set(e.build_millis) == {"corpus", "prefix_index", "prefix_topk", "segment_index", "segment_index_2"}
    e.close()


def test_guards_of_tables(spark):
    asked = [("a", "5"), (None, "5"), ("x" * 65, "5"), ("😀" * 33, None), ("😀" * 32, None), ("a", "0"), ("a", "51"), ("a", "-1"), ("a", "x"), ("a", ""), (" ", "50"), ("a", "1000"), ("a", " 7 "), ("a", "99999999999"), ("a", "+3")]
    rows = api.validated(spark.createDataFrame([(i, q, n) for i, (q, n) in enumerate(asked)], "i int, q string, limit string")).collect()
    for r, (q, n) in zip(sorted(rows, key=lambda r: r["i"]), asked, strict=True):
        try:
            api.valid_query(q)
            assert (api.valid_limit(10 if n is None else n), 200) == (r["checked_limit"], r["status"])
        except api.ApiError as e:
            # a number beyond all limits is told from no number by one of them only
            assert (r["status"], r["error"]) == (e.status, e.code) and (r["message"] == str(e) or n == "99999999999")


def test_astral_words(spark):
    e = Engine(corpus_of(spark, [("a😀b", 5), ("ab", 3), ("axb", 2)]))
    got = {r["word"]: r["edit_distance"] for r in e.fuzzy_search("a😀b", 10, 2).collect()}
    assert e.has_astral and got == {"a😀b": 0, "ab": 2, "axb": 2}


def test_astral_queries_alone_and_in_batch(spark):
    """Words of the basic plane, and a query that isn't: single, batch and scan have the same answers."""
    e = Engine(corpus_of(spark, [("abcd", 5), ("xabcd", 3), ("axbcd", 2), ("zz", 1)]))
    df = spark.createDataFrame([(0, "a😀bcd", 9)], "query_id int, q string, limit int")
    want = {("abcd", 2), ("axbcd", 2)}
    answers = [e.search_batch(df), e.search_batch(df, "naive"), e.search("a😀bcd", 9), e.search("a😀bcd", 9, "naive")]
    assert not e.has_astral and all({(r["word"], r["edit_distance"]) for r in a.collect()} == want for a in answers)


def plain(entries, q, limit):
    """Combined search in plain Python."""
    import math

    merged = {}
    for w, n in entries:
        merged.setdefault(w.lower(), []).append((-n, w))
    rows = {k: (min(v)[1], -sum(n for n, _ in v)) for k, v in merged.items()}
    top = max((n for _, n in rows.values()), default=0)
    hits = {k: ("PREFIX", 0) for k in rows if k.startswith(q)}
    dist = {k: rows_of(in_units(k), in_units(q))[-1][-1] for k in rows if k not in hits}
    for most in range(1, budget_of(q) + 1):
        if len(hits) >= limit:
            break
        hits = {k: v for k, v in hits.items() if v[0] == "PREFIX"} | {k: ("FUZZY", d) for k, d in dist.items() if d <= most}

    def result(k):
        t, d = hits[k]
        pop = min(1.0, math.log10(1 + rows[k][1]) / math.log10(1 + top)) if top > 0 else 0.0
        return (-round(0.7 * (1.0 if t == "PREFIX" else 1 / (1 + d)) + 0.3 * pop, 12), len(in_units(rows[k][0])), rows[k][0].encode("utf-16-be"), rows[k][0], t, d)

    return [(w, t, d) for _, _, _, w, t, d in sorted(map(result, hits))[: max(limit, 0)]]


def test_engines_agree_with_plain_python(spark):
    for seed in range(3):
        rng = random.Random(seed)
        letters = ("abcde", "abcde", "ab😀é\uff61𝒳")[seed]
        word = lambda most=8: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
        entries = [(word(), rng.choice([rng.randint(0, 9), rng.randint(0, 99_999), rng.randint(0, 4)])) for _ in range(300)]
        queries = [(i, word() if i else "", rng.randint(1, 15)) for i in range(60)]
        e = Engine(corpus_of(spark, entries))
        df = spark.createDataFrame(queries, "query_id int, q string, limit int")
        for kind in ("naive", "optimized"):
            got = {}
            for r in e.search_batch(df, kind).orderBy("query_id", "rank").collect():
                got.setdefault(r["query_id"], []).append((r["word"], r["match_type"], r["edit_distance"]))
            assert got == {i: want for i, q, n in queries if (want := plain(entries, q, n))}
            for i, q, n in queries[1:60:15]:
                one = [(r["word"], r["match_type"], r["edit_distance"]) for r in e.search(q, n, kind).orderBy("rank").collect()]
                assert one == plain(entries, q, n)


def test_index_tables(spark):
    c = corpus_of(spark, [("car", 50), ("cart", 900), ("dog", 10)])
    rows = {r["prefix"]: (r["max_subtree_weight"], r["words"], r["is_terminal"], r["child_count"]) for r in index.prefix_index(c).collect()}
    assert rows[""] == (900, 3, False, 2) and rows["car"] == (900, 2, True, 1) and rows["dog"] == (10, 1, True, 0)
    prefixes = index.prefix_index(c)
    assert index.node_count(prefixes).first()[0] == 8
    assert tuple(index.traversal_stats(prefixes, c, "c", 1).first()) == (4, 6) and tuple(index.traversal_stats(prefixes, c, "x", 1).first()) == (0, 0)
    keys = spark.createDataFrame([("car",), ("ca",), ("",), ("x",)], "key string")
    assert {r["key"]: r["found"] for r in index.contains(c, keys).collect()} == {"car": True, "ca": False, "": False, "x": False}
    assert {r["key"]: r["found"] for r in index.has_prefix(prefixes, keys).collect()} == {"car": True, "ca": True, "": True, "x": False}
    assert {r["key"]: r["weight"] for r in index.weight_of(c, keys).collect()} == {"car": 50, "ca": 0, "": 0, "x": 0}
    assert index.has_prefix(index.prefix_index(c.limit(0)), keys).where("key = ''").first()["found"]


def test_top_k(spark):
    rng = random.Random(1)
    items = [("".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))), float(rng.randint(0, 4))) for _ in range(200)]
    df = spark.createDataFrame(items, "word string, score double")
    key = lambda x: (-x[1], len(x[0]), x[0])
    for k in (0, 1, 7, 300):
        assert [tuple(r)[:2] for r in top_k(df, k, best_first()).orderBy("rank").collect()] == sorted(items, key=key)[:k]
        heap = BoundedTop(k, key)
        heap.offer_all(items)
        assert heap.worst() == (sorted(items, key=key)[:k] or [None])[-1] and heap.drain() == sorted(items, key=key)[:k] and len(heap) == 0
    heap = BoundedTop(1, lambda x: x[0])
    assert heap.offer((1, "first")) and not heap.offer((1, "second")) and heap.offer((0, "third")) and not BoundedTop(0, key).offer(("a", 1.0))
    for bad in (lambda: top_k(df, -1, best_first()), lambda: BoundedTop(-1, key)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        heap.offer(None)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, basic):
    assert "TakeOrderedAndProject" in plan(search.prefix_search(basic.corpus, "ap", 5))
    q = spark.createDataFrame([(0, "aple", 5, 2)], "query_id int, q string, limit int, max_distance int")
    p = plan(search.fuzzy_batch(q, basic.corpus))
    # words and queries meet by equality of segments; the one nested loop adds the single row of the largest weight
    assert "CartesianProduct" not in p and p.count("NestedLoopJoin") == 1 and "Join [segment" in p and "WindowGroupLimit" in p
    # an engine knows that weight, and a pair that meets twice is told apart without a shuffle: one exchange, for the ranks
    own = lambda df: plan(df).split("InMemoryRelation")[0]  # noqa: E731  without what is persisted
    p = own(basic.fuzzy_batch(q))
    assert "NestedLoopJoin" not in p and p.count("Exchange hashpartitioning") == 1
    single = own(basic.fuzzy_search("aple", 5, 1))
    assert "Join" not in single and "TakeOrderedAndProject" in single
    stored = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where(F.col("p_name").startswith("a"))
    assert "StringStartsWith" in plan(stored)
    assert [routing.use_index(n) for n in range(3)] == [True, True, False]


def test_short_circuit_builds_no_fuzzy_plan(basic):
    asked = []
    routing.search(basic.corpus, "app", 2, lambda key, most: asked.append(most))
    assert asked == []


def test_api(basic):
    got = api.search(basic, "aple", 3)
    assert got["resultCount"] == len(got["results"]) == 2 and got["engine"] == "optimized"
    assert api.search(basic, " \t", 3)["results"] == [] and api.compare(basic, "  ")["speedup"] == 1.0
    both = api.compare(basic, "aple", "5")
    assert both["identical"] and both["naiveMicros"] > 0
    for limit in (0, -1, 51, 1000, "abc", None):
        with pytest.raises(api.ApiError):
            api.search(basic, "a", limit)
    assert api.valid_query("x" * 64) and api.valid_limit("50") == 50
    for q in (None, "x" * 65):
        with pytest.raises(api.ApiError):
            api.valid_query(q)
    for q in ('"', "<b>", "a%20b", "../x", "café", "日本語", "a&b=c", "100%", "\\", "*", "?"):
        assert api.search(basic, q)["results"] is not None
    assert api.handle(basic, "GET", "/nowhere", {})[0] == 404 and api.handle(basic, "POST", "/api/search", {})[0] == 405
    status, body = api.handle(basic, "GET", "/api/search", {"q": "a", "limit": "x"})
    assert status == 400 and json.loads(body) == {"error": "invalid_request", "message": "limit must be a number"}
    assert json.loads(api.handle(basic, "GET", "/health", {})[1])["status"] == "UP"


def test_stream(spark, basic, tmp_path):
    from lexaline.streaming import queries as stream

    schema = "query_id int, q string, limit int"
    spark.createDataFrame([(1, "app", 2), (2, "aple", 5)], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    running = stream.answered(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), basic, lambda df, n: seen.extend(df.collect()), str(tmp_path / "state"))
    running.processAllAvailable()
    running.stop()
    assert {(r["query_id"], r["word"]) for r in seen} == {(1, "application"), (1, "apple"), (2, "apple"), (2, "ape")}
