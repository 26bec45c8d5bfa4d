"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, ctw, decontaminate, lines, mixing, passages, quality, secrets, simhash, warc
from .common import read


def op1_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(read(spark, sf_dir, "documents"))


def op2_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_texts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")).withColumn("llr", F.round("llr", 8))


def op3_reversible_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_deletion_variant_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages"), payloads=False).drop("payload")


def op7_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumn("bm25", F.round("bm25", 8))


def op8_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.drop_passages(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


# What SQL can say of the others: columns that don't need the model.


def base_of_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and their shares, beside the scores."""
    return op1_context_tree_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def base_of_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the base kinds."""
    return op9_secret_ownership(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def targets_of_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets, and whether the words taken of a source come within two blocks of its target."""
    out = op10_sainte_lague_mix(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    per = out.groupBy("source").agg(F.count("*").alias("docs"), F.first("source_size").alias("source_size"), F.round(F.first("target"), 6).alias("target"), F.sum("taken").alias("taken"))
    return per.select("source", "docs", "source_size", "target", (F.abs(F.col("taken") - F.col("target")) <= 2 * mixing.BLOCK).alias("near"))


def revisits_of_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of pages of which two thirds come again, once or twice."""
    pages = read(spark, sf_dir, "pages")
    again = pages.where("page_id % 3 > 0").withColumn("page_id", F.col("page_id") + 1_000_000)
    third = pages.where("page_id % 3 = 2").withColumn("page_id", -1 - F.col("page_id"))
    return warc.archive(pages.unionByName(again).unionByName(third), payloads=False).drop("payload")


QUERIES = {f.__name__: f for f in (op1_context_tree_scores, op2_ngram_ratio_rules, op3_reversible_line_dedup, op4_fourier_quality, op5_deletion_variant_simhash, op6_warc_segments, op7_bm25_leaks, op8_phrase_automata, op9_secret_ownership, op10_sainte_lague_mix, base_of_op1, base_of_op9, targets_of_op10, revisits_of_op6)}

#: The table of CRC-32, one row, and the CRC-32 of a string by it.
CRC = """bits AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
"""


def crc(x: str) -> str:
    bytes_ = f"list_transform(range(1, octet_length(encode({x})) + 1), lambda i: ('0x' || substr(hex(encode({x})), 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), 4294967295), 4294967295)"


WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Multipliers of single words, of the words of a pair, and of pairs: in SQL by 128 bits, modulo two to the 64.
ONE, FIRST, SECOND, PAIR = (f"{x}::UHUGEINT" for x in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
MOD = f"{1 << 64}::UHUGEINT"
ASSIGN = secrets.ASSIGN.pattern.replace("'", "''")


def marked(pattern: str) -> str:
    """SQL for the pieces of a text: before the first match, and then each match, a mark and what follows."""
    return f"string_split(regexp_replace(coalesce(text, ''), '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1))"


def spans(kind: str, n: int, pattern: str, good: str) -> str:
    return f"""SELECT doc_id, '{kind}' AS kind, {n} AS n, pos, pos + length(m) AS till, m FROM (SELECT doc_id, split_part(p, chr(2), 1) AS m, i, coalesce(sum(length(p) - (i > 1)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
FROM (SELECT doc_id, unnest({marked(pattern)}) AS p, unnest(range(1, len({marked(pattern)}) + 1)) AS i FROM documents)) WHERE i > 1 AND {good}"""




def with_terms(sql: str) -> str:
    """SQL with the terms of a text, and the five-word shingles of a list of terms, written out where they are named."""
    terms = lambda m: "regexp_extract_all(" + LOWER.format(f"coalesce({m[1]}, '')") + ", '[^\\x00-/:-`\\x7b-\\x7f]+')"
    grams = lambda m: f"CASE WHEN len({m[1]}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len({m[1]}) - 4) + 1), lambda i: array_to_string({m[1]}[i:i + 4], ' '))) END"
    return re.sub(r"\{GRAMS\}\((\w+)\)", grams, re.sub(r"\{TERMS\}\((\w+)\)", terms, sql))


ORACLES: dict[str, str] = {
    "op3_reversible_line_dedup": """
WITH lists AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM lists),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
told AS (SELECT doc_id, line, n, last IS NOT NULL AND last <> doc_id AS gone FROM keyed LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY doc_id""",
    "op6_warc_segments": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM m""",
    "op8_phrase_automata": """
WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM lists),
windows AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS k FROM starts),
least AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k),
hit AS (SELECT doc_id, s FROM windows JOIN least USING (k) WHERE low < doc_id),
each AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM lists),
marked AS (SELECT each.*, coalesce(bool_or(hit.s IS NOT NULL) OVER (PARTITION BY each.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM each LEFT JOIN hit ON hit.doc_id = each.doc_id AND hit.s = each.i),
out AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM lists LEFT JOIN out USING (doc_id)""",
    "op2_ngram_ratio_rules": f"""
WITH {CRC}lists AS (SELECT doc_id, text, {WORDS} AS ws FROM documents),
each AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM lists),
hashed AS (SELECT w, ({crc("w")})::UHUGEINT AS h FROM (SELECT DISTINCT w FROM each), bits),
placed AS (SELECT doc_id, w, i, h, lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM each JOIN hashed USING (w)),
grams AS (SELECT doc_id, (h * {ONE} % {MOD}) // {1 << 48} AS bucket FROM placed UNION ALL SELECT doc_id, ((h * {FIRST} + after * {SECOND}) % {MOD} * {PAIR} % {MOD}) // {1 << 48} AS bucket FROM placed WHERE after IS NOT NULL),
counted AS (SELECT bucket, count(*)::DOUBLE AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))::DOUBLE AS good FROM grams GROUP BY bucket),
share AS (SELECT sum(good) / sum(raw) AS scale FROM counted),
ratios AS (SELECT bucket, ln((good + {quality.SMOOTHING}::DOUBLE) / (raw * scale + {quality.SMOOTHING}::DOUBLE)) AS r FROM counted, share),
means AS (SELECT doc_id, fsum(r) / count(*) AS llr FROM grams JOIN ratios USING (bucket) GROUP BY doc_id),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws[i:i + 2] AS k FROM lists)),
again AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM windows, range(3) r(d) WHERE n > 1 GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
repeats AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM split WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
told AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(repeats.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(llr, 0) AS ratio
FROM lists LEFT JOIN repeats USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN means USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND ratio >= {quality.THRESHOLD}::DOUBLE AS kept, round(ratio, 8) AS llr FROM told""",
    "base_of_op1": f"""
WITH {CRC}lists AS (SELECT doc_id, {crc("doc_id::VARCHAR")} % 5 = 1 AS held_out, {WORDS.replace("coalesce(text, '')", LOWER.format("coalesce(text, '')"))} AS ws FROM documents, bits),
each AS (SELECT doc_id, held_out, unnest(list_append(ws, chr(10))) AS w FROM lists),
learnt AS (SELECT w, count(*) AS c FROM each WHERE NOT held_out GROUP BY w),
total AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM learnt)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(fsum(log10((coalesce(c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)))), 6) AS base_score FROM each LEFT JOIN learnt USING (w), total GROUP BY doc_id, held_out, n""",
    "base_of_op9": f"""
WITH found AS ({spans("assign", 0, ASSIGN, f"length(regexp_extract(m, '{ASSIGN}', 2)) >= 6")} UNION ALL {spans("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")} UNION ALL {spans("hex", 2, "[0-9a-f]+", "length(m) >= 24")})
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce(string_agg(kind || ':' || pos || ':' || till, ',' ORDER BY pos, n), '')) AS base_sha256 FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id""",
    "targets_of_op10": f"""
WITH per AS (SELECT source, count(*) AS docs, sum(len({WORDS}))::BIGINT AS source_size FROM documents GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM per),
-- by how soon a source meets its limit: the first k are at it, and the others share what is left
line AS (SELECT *, row_number() OVER o AS pos, coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spent, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open, (SELECT sum(source_size) FROM per)::DOUBLE AS every FROM weighed WINDOW o AS (ORDER BY 3 * source_size::DOUBLE / w, source NULLS LAST)),
cut AS (SELECT arg_min((every - spent) / open, pos) AS unit FROM line WHERE (every - spent) / open * w < 3 * source_size)
SELECT source, docs, source_size, round(least(3.0::DOUBLE * source_size, coalesce(unit, 'inf'::DOUBLE) * w), 6) AS target, true AS near FROM line, cut""",
    "revisits_of_op6": """
WITH all_pages AS (SELECT page_id, html FROM pages UNION ALL SELECT page_id + 1000000, html FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT -1 - page_id, html FROM pages WHERE page_id % 3 = 2),
p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM all_pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM m""",
    "op7_bm25_leaks": f"""
WITH asked AS (SELECT row_number() OVER () AS pos, item_id, string_split(regexp_replace(coalesce(text, ''), '([.?!\\n])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM benchmark),
sentences AS (SELECT pos, item_id, list_filter(list_transform(parts, lambda p: {{TERMS}}(p)), lambda t: len(t) > 0) AS ss FROM asked),
halves AS (SELECT pos, item_id, CASE WHEN len(ss) < 2 THEN flatten(ss) ELSE flatten(ss[:-2]) END AS q, CASE WHEN len(ss) < 2 THEN [] ELSE ss[-1] END AS a FROM sentences WHERE len(ss) > 0),
items AS (SELECT pos, item_id, q, a, len(q) + len(a) AS n, {{GRAMS}}(q) AS qs, {{GRAMS}}(a) AS an FROM halves),
every AS (SELECT count(*)::DOUBLE AS items, avg(n) AS mean, greatest({decontaminate.LEAST_WORDS}, 2 * max(n)) AS passage FROM items),
tf AS (SELECT pos, n, w, count(*) AS tf FROM (SELECT pos, n, unnest(list_concat(q, a)) AS w FROM items) GROUP BY ALL),
df AS (SELECT w, count(*)::DOUBLE AS df FROM tf GROUP BY w),
weights AS (SELECT pos, w, ln(1 + (items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({decontaminate.K1}::DOUBLE + 1) / (tf + {decontaminate.K1}::DOUBLE * (1 - {decontaminate.B}::DOUBLE + {decontaminate.B}::DOUBLE * n / mean)) AS x FROM tf JOIN df USING (w), every),
impacts AS (SELECT pos, w, x / sum(x) OVER (PARTITION BY pos) AS x FROM weights),
texts AS (SELECT row_number() OVER () AS row, doc_id, {{TERMS}}(text) AS ts FROM documents),
passages AS (SELECT row, doc_id, first, ts[first + 1:first + passage] AS ts FROM (SELECT *, unnest(range(0, greatest(1, len(ts)), passage // 2)) AS first FROM texts, every)),
terms AS (SELECT DISTINCT row, first, unnest(ts) AS w FROM passages),
scores AS (SELECT row, first, pos, fsum(x) AS score FROM terms JOIN impacts USING (w) GROUP BY ALL HAVING fsum(x) >= {decontaminate.THRESHOLD} - 1e-9),
own AS (SELECT row, first, list_distinct(flatten([list_transform(range(1, len(ts) - k + 2), lambda i: array_to_string(ts[i:i + k - 1], ' ')) for k in range(1, 6)])) AS gs, list_distinct(ts) AS ts FROM passages SEMI JOIN scores USING (row, first)),
met AS (SELECT scores.row, scores.first, items.*, score, len(list_intersect(qs, gs)) AS nq, len(list_intersect(an, gs)) AS na, own.ts FROM scores JOIN items USING (pos) JOIN own ON own.row = scores.row AND own.first = scores.first),
good AS (SELECT row, pos, item_id, first, score, CASE WHEN len(qs) > 0 THEN nq / len(qs) ELSE 1 END AS question_overlap, CASE WHEN len(an) > 0 THEN na / len(an) ELSE 1 END AS answer_overlap FROM met
WHERE nq + na >= {decontaminate.OVERLAP} * (len(qs) + len(an)) AND 2 * len(list_intersect(list_distinct(q), ts)) >= len(list_distinct(q)) AND 2 * len(list_intersect(list_distinct(a), ts)) >= len(list_distinct(a)))
SELECT doc_id, item_id, first::BIGINT AS first_word, round(score, 8) AS bm25, question_overlap::DOUBLE AS question_overlap, answer_overlap::DOUBLE AS answer_overlap FROM good JOIN texts USING (row) QUALIFY row_number() OVER (PARTITION BY row, pos ORDER BY round(score, 12) DESC, first) = 1""",
}
ORACLES["op7_bm25_leaks"] = with_terms(ORACLES["op7_bm25_leaks"])
