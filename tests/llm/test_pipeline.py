"""The pipeline's stages against brute force, each on its own input, and the corpus queries against their SQL."""

import os
import random
import re

import duckdb
import pytest

import corpus_pipeline
from lexaline.llm import decontaminate, quality, queries, simhash
from lexaline.llm.common import keep
from test_operators import line_brute  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "size", "taken"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with nulls, copies, leaks, junk, a repeated row and columns that clash with the operators' own."""
    at, rng = tmp_path_factory.mktemp("tables"), random.Random(11)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", *(f"w{i}" for i in range(400))]) for _ in range(n))
    leak = "Alpha beta gamma delta epsilon zeta eta. Theta iota kappa lambda mu nu."
    line = "\nthis line stands in very many documents\n"
    base = prose(150)
    texts = [None, "", "too short", *(prose(120) + line + prose(20) for _ in range(12)), base, base, base.replace(" the ", " a ", 1), *(prose(90) + " " + leak for _ in range(2)), *(" ".join(f"w{rng.randint(0, 400)}***" for _ in range(90)) for _ in range(6)), *(prose(100) for _ in range(12))]
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    rows += [rows[5], (None, prose(100), "en", "s1", 9, "x", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, taken string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int("***" not in (t or "")), 0) for i, t in enumerate(texts) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    assert [re.split(r"[ -]", n)[0] for n in by_name] == ["quality", "line", "SimHash", "benchmark", "mixing"]

    kept = keep(by_name["quality rules"](spark, docs, folder))
    judged = quality.judge_texts(docs, spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id"))
    assert kept.columns == COLUMNS and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in judged.where("kept").collect()), key=str)
    assert not any("***" in t for _, t in rows_of(kept)) and kept.count() > 25

    lines = keep(by_name["line dedup"](spark, kept, folder))
    before = rows_of(kept)
    want = line_brute([r for r in before if r[0] is not None])
    import hashlib

    assert lines.columns == COLUMNS and len(rows_of(lines)) == len(before)
    assert all(hashlib.sha256(t.encode()).hexdigest() == want[i][2] for i, t in rows_of(lines) if i is not None)

    near = keep(by_name["SimHash near-dedup"](spark, lines, folder))
    before = {i: t for i, t in rows_of(lines) if i is not None}

    def shingles(t):
        ws = WORDS.findall(t.lower())
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}

    sets, stay = {i: shingles(t) for i, t in before.items()}, []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in stay):
            stay.append(i)
    kept_ids = [r["doc_id"] for r in near.collect()]
    assert len(stay) < len(before) and sorted(i for i in kept_ids if i is not None) == sorted(i for i, _ in rows_of(lines) if i in stay) and near.columns == COLUMNS
    # no two documents that stay are equal or alike; rows that share a doc_id are one document
    unlike = {i: sets[i] for i in kept_ids if i is not None}
    assert not any(i < j and len(unlike[i] & unlike[j]) >= 0.8 * len(unlike[i] | unlike[j]) for i in unlike for j in unlike)

    clean = keep(by_name["benchmark decontamination"](spark, near, folder))
    leaked = {i for i, t in rows_of(near) if "Alpha beta" in t}
    assert leaked and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - leaked and clean.columns == COLUMNS

    mixed = by_name["mixing to target weights"](spark, clean, folder)
    for r in mixed.collect():
        assert r["size"] == len(WORDS.findall(r["text"])) and 0 < r["taken"] <= 3 * r["size"]
    assert sum(r["taken"] for r in mixed.collect()) == pytest.approx(sum(len(WORDS.findall(t)) for _, t in rows_of(clean)), rel=0.05)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"}
    first = sorted(map(str, out.collect()))
    assert first and first == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert decontaminate.without_leaks(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == docs.count()
    assert simhash.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in os.listdir(small):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{small}/{t}'")
    df, want = queries.QUERIES[name](spark, small), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
