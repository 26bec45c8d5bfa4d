"""Each operator against a brute-force version on a small fixture with nulls, ties, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from pyspark.sql import functions as F

from lexaline.llm import classifier, ctw, decontaminate, lines, mixing, passages, quality, secrets, simhash, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, size long, taken string, kept int, held_out string, row int, component_id long"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def texts():
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "été", "Straße", "naïve", *("w" + str(i) for i in range(300))]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, line = prose(70), "A line that many of the documents share."
    out = [None, "", "   \n\t ", "one", "short text here", "x" * 5000, line, f"{line}\n  {line.upper()} \n{line}", "日本語 の 文 😀 " * 20]
    out += [prose(rng.randint(1, 200)) for _ in range(25)]
    out += [f"{prose(30)}\n{line}\n{shared} {prose(20)}" for _ in range(5)]
    out += [out[12], out[12], out[13], out[13] + " tail", shared, prose(3000)]
    out += [f'{prose(20)} password = "hunter{i}secret" AKIA{"ABCDEFGH12345678"} {hashlib.sha1(bytes([i])).hexdigest()} é' for i in range(5)]
    return out


@pytest.fixture(scope="module")
def rows():
    got = [(i, t) for i, t in enumerate(texts())]
    rng = random.Random(1)
    rng.shuffle(got)
    return got


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en", None if i % 7 == 3 else f"s{i % 5}", 0, "c", 1, "t", 0, "h", 9, 8) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def odd(spark, docs):
    """The documents with a repeated row and one without an id."""
    return docs.unionByName(docs.where("doc_id = 20")).unionByName(docs.where("doc_id = 21").selectExpr("cast(null as long) doc_id", *docs.columns[1:])).cache()


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


# 1


def kt_tree(train, depth):
    """Context-tree weighting the slow way: counts by (bits so far, context)."""
    counts = defaultdict(lambda: [0, 0])
    for data in train:
        padded = b"\n" * depth + data
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                for bit in range(8):
                    counts[(padded[i] >> (8 - bit), bit, padded[i - d : i])][(padded[i] >> (7 - bit)) & 1] += 1
    kids = defaultdict(list)
    for p, bit, ctx in counts:
        if ctx:
            kids[p, bit, ctx[1:]].append((p, bit, ctx))

    def pe(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    known = {}

    def pw(node):
        if node not in known:
            own = pe(node)
            known[node] = own if len(node[2]) == depth else np.logaddexp(own, sum(pw(k) for k in kids[node])) - math.log(2)
        return known[node]

    def log10(data):
        padded, total = b"\n" * depth + data, 0.0
        for i in range(depth, len(padded)):
            for bit in range(8):
                q, below = 0.5, False
                for d in range(depth, -1, -1):
                    node = (padded[i] >> (8 - bit), bit, padded[i - d : i])
                    if node in counts:
                        a, b = counts[node]
                        kt = (b + 0.5) / (a + b + 1)
                        w = math.exp(pe(node) - math.log(2) - pw(node))
                        q, below = (w * kt + (1 - w) * q if below else kt), True
                total += math.log10(q if (padded[i] >> (7 - bit)) & 1 else 1 - q)
        return total

    return log10


def test_ctw_equals_the_slow_tree(spark):
    rng = random.Random(2)
    some = [(i, " ".join(rng.choice(["ab", "Abc", "é", "ba", "cab"]) for _ in range(rng.randint(0, 12))) or None) for i in range(40)]
    got = by_id(ctw.score_texts(spark.createDataFrame(some, "doc_id long, text string")))
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in some}
    assert 0 < sum(held.values()) < 40
    log10 = kt_tree([ctw.stream((t or "").encode()) for i, t in some if not held[i]], ctw.DEPTH)
    words = {i: [*lower(t or "").split(), "\n"] for i, t in some}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, t in some:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(words[i]), sum(count[w] > 0 for w in words[i]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words[i]), abs=1e-9)
        assert r["score"] == pytest.approx(log10(ctw.stream((t or "").encode())), abs=1e-7)


def test_ctw_probabilities_of_a_byte_sum_to_one():
    keys = np.array([(7 << 40) | (5 << 32) | x for x in range(256)], np.int64)
    counts = np.array([x % 3 for x in range(256)], np.int64)
    top = ctw.top_tree(ctw.tops(ctw.pa.table({"keys": [ctw.pack(keys, True)], "counts": [ctw.pack(counts)]})))
    assert (10 ** ctw.log10_probability(keys, counts, top)).sum() == pytest.approx(1)


def test_ctw_odd_rows(odd, empty):
    out = ctw.score_texts(odd)
    assert out.count() == odd.count() and out.where("score is null or isnan(score)").count() == 0
    assert ctw.score_texts(empty).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 10.0, 1e6 + 0.5])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-10)


# 2


def test_buckets_of_words_and_pairs():
    """Hashes from their definition: CRC-32 of a word, odd multipliers for words and for pairs, the highest bits."""
    words, mask = [b"one", "zwei\u00e9".encode(), b"one"], (1 << 64) - 1
    h = [zlib.crc32(w) for w in words]
    for bits in (16, 20):
        want = [(x * 0xD6E8FEB86659FD93 & mask) >> (64 - bits) for x in h]
        want += [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) * 0xFF51AFD7ED558CCD & mask) >> (64 - bits) for a, b in zip(h, h[1:], strict=False)]
        assert quality.grams(words, quality.Hashes(), 1 << bits).tolist() == want


def measures(t):
    ws = WORDS.findall(t or "")
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    seen, again = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            again |= {i, i + 1, i + 2}
    ls = [x for x in (t or "").split("\n") if WORDS.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(again)


def test_quality_measures_and_verdicts(spark, rows, odd, empty):
    trusted = spark.createDataFrame([(i,) for i in range(9, 20)] + [(9,), (None,)], "doc_id long")
    out = quality.judge_texts(odd, trusted)
    got = by_id(out)
    raw, good = Counter(), Counter()
    h = quality.Hashes()
    source = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    for i, t in source:
        g = quality.grams((t or "").encode().split(), h).tolist()
        raw.update(g)
        if i is not None and 9 <= i < 20:
            good.update(g)
    scale, k = sum(good.values()) / sum(raw.values()), quality.SMOOTHING
    for i, t in rows:
        m, r = measures(t), got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        g = quality.grams((t or "").encode().split(), h).tolist()
        ratio = sum(math.log((good[b] + k) / (raw[b] * scale + k)) for b in g) / len(g) if g else 0
        assert r["base_failed"] == failed and r["llr"] == pytest.approx(ratio, abs=1e-9)
        assert r["kept"] == (not failed and r["llr"] >= quality.THRESHOLD)
    assert out.count() == len(source) and quality.judge_texts(empty, trusted).count() == 0
    more = by_id(quality.judge_texts(odd, trusted, buckets=1 << 20))
    assert any(more[i]["llr"] != got[i]["llr"] for i in more) and all(abs(more[i]["llr"] - got[i]["llr"]) < 0.2 for i in more)
    kept = quality.keep_texts(odd, trusted)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in out.where("kept").collect())


# 3


def line_brute(rows):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holds = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holds[key(x)].add(i)
    out = {}
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= 20 and len(holds[key(x)]) >= 3 and i != max(holds[key(x)]))]
        out[i] = (len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def line_result(df):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()}


def test_lines(rows, docs, odd, empty):
    assert line_result(lines.dedup_lines(docs)) == line_brute(rows)
    assert sum(x[1] for x in line_brute(rows).values()) > 3
    assert lines.dedup_lines(odd).count() == odd.count() and lines.dedup_lines(empty).count() == 0
    out = lines.dedup_rows(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts_, want = {r["doc_id"]: r for r in out.collect()}, line_brute(rows)
    assert all(hashlib.sha256((texts_[i]["text"] or "").encode()).hexdigest() == want[i][2] and texts_[i]["n_chars"] == (len(texts_[i]["text"]) if t is not None else None) for i, t in rows)


def test_line_index_goes_back(spark, rows, docs):
    index = lines.LineIndex(spark, 3, 2).insert(docs.where("doc_id % 2 = 0")).insert(docs.where("doc_id % 3 = 0")).insert(docs)
    assert line_result(index.apply(docs)) == line_brute(rows)
    index.delete(docs.where("doc_id % 4 = 1").select("doc_id")).delete(docs.where("doc_id = 999").select("doc_id"))
    left = [(i, t) for i, t in rows if i % 4 != 1]
    assert line_result(index.apply(docs.where("doc_id % 4 <> 1"))) == line_brute(left)


def test_filters_spare_the_exact_tables(spark, monkeypatch):
    monkeypatch.setattr(lines, "COMPACT", 4)
    line = lambda i, n: "\n".join(f"line {k} of document number {i}" for k in range(n))
    of = lambda *ids: spark.createDataFrame([(i, line(i, 6) + "\nand one line that all of these have") for i in ids], "doc_id long, text string")
    index = lines.LineIndex(spark, 2, 16).insert(of(60, 61, 62))
    assert index.looked_up == 0  # all keys are new
    index.insert(spark.createDataFrame([(50, line(50, 1))], "doc_id long, text string"))
    assert index.looked_up <= 1  # one new key, which a filter may admit by chance
    index.insert(of(63))
    assert 1 <= index.looked_up < 16  # one key is held already
    assert line_result(index.apply(of(60, 61, 62, 63))) == line_brute([(r["doc_id"], r["text"]) for r in of(60, 61, 62, 63).collect()])
    index.delete(of(62, 63).select("doc_id"))  # all is written together
    assert index.generation == lines.COMPACT and {r["n_dropped"] for r in index.apply(of(60, 61)).collect()} == {0}
    index.insert(of(62))
    assert line_result(index.apply(of(60, 61, 62))) == line_brute([(r["doc_id"], r["text"]) for r in of(60, 61, 62).collect()])


def test_cuckoo_filter():
    from lexaline.llm.cuckoo import CuckooFilter

    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 50_000).astype(np.uint64))
    made = CuckooFilter.of(keys[:40_000])
    assert made.contains(keys[:40_000]).all() and made.contains(keys[40_000:]).mean() < 0.01
    again = CuckooFilter.from_bytes(made.to_bytes())
    again.delete(keys[:1000])
    assert again.contains(keys[1000:40_000]).all() and again.contains(keys[:1000]).mean() < 0.05
    assert not CuckooFilter(1).insert(keys[:100])


# 4


def test_classifier(spark, empty, odd):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "of", "lorem", "ipsum", "dolor,", "amet."]) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW***", "$$$", "CLICK|", "1234"]) for _ in range(80))
    some = [(i, good() if i % 3 else bad(), int(bool(i % 3))) for i in range(400)]
    d, labels = spark.createDataFrame(some, "doc_id long, text string, quality int"), spark.createDataFrame([(i, y) for i, _, y in some], "doc_id long, quality int")
    got = by_id(classifier.score_quality(d, labels))
    held = [(got[i]["predicted"], y) for i, _, y in some if got[i]["held_out"]]
    assert len(held) > 40 and np.mean([p == y for p, y in held]) > 0.95
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1 for i, _, _ in some)
    # labels of held-out rows aren't learnt from
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    assert by_id(classifier.score_quality(d, flipped))[5]["score"] == pytest.approx(got[5]["score"], abs=1e-9)
    assert classifier.score_quality(odd, labels).where("score between 0 and 1").count() == odd.count()
    assert classifier.score_quality(odd, labels.limit(0)).count() == odd.count() and classifier.score_quality(empty, labels).count() == 0


def test_classifier_against_numpy(spark):
    """The whole fit at once, in NumPy, over statistics that are counted by hand for some of them."""
    rng = random.Random(6)
    some = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma.", "1234", "x!"]) for _ in range(rng.randint(1, 60))) if i % 9 else None) for i in range(300)]
    marks = [(i, int(len(t or "") % 3 > 0)) for i, t in some if i % 4]
    got = by_id(classifier.score_quality(spark.createDataFrame(some, "doc_id long, text string").repartition(5), spark.createDataFrame(marks, "doc_id long, quality int")))
    x = np.array([classifier.statistics((t or "").encode(), classifier.classes()) for _, t in some])
    for (_, t), row in zip(some, x, strict=True):
        if t:
            ws = t.split()
            own = dict(zip(classifier.STATS, row.tolist(), strict=True))
            assert own["log_words"] == pytest.approx(math.log(1 + len(ws))) and own["digits"] == pytest.approx(sum(c.isdigit() for c in t) / len(t)) and own["distinct_words"] == pytest.approx(len(set(ws)) / len(ws)) and own["top_word"] == pytest.approx(max(Counter(ws).values()) / len(ws))
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i, _ in some])
    y = np.array([dict(marks).get(i, -1) for i, _ in some])
    scale = x.std(0)
    r = np.random.default_rng(classifier.SEED)
    w, b = r.standard_normal((x.shape[1], 256)) / classifier.WIDTH, r.uniform(0, 2 * np.pi, 256)
    z = np.column_stack((np.cos(np.clip((x - x.mean(0)) / np.where(scale > 1e-12, scale, 1), -8, 8) @ w + b) * np.sqrt(2 / 256), np.ones(len(x))))
    a = (fold > 1) & (y >= 0)
    ridge = z @ np.linalg.solve(z[a].T @ z[a] + np.eye(257), z[a].T @ y[a])
    assert all(got[i]["ridge"] == pytest.approx(v, abs=1e-6) for (i, _), v in zip(some, ridge.tolist(), strict=True))
    c = (fold == 1) & (y >= 0)
    at = np.clip((ridge + 0.5) * 512, 0, 1023).astype(int)
    rates = classifier.isotonic(np.bincount(at[c], minlength=1024), np.bincount(at[c], y[c], 1024))
    near = sum(abs(got[i]["score"] - (0.999 * rates[k] + 0.001 / (1 + math.exp(-v)))) < 1e-6 for (i, _), k, v in zip(some, at, ridge, strict=True))
    assert near >= len(some) - 2  # a score that falls on the edge of two bins may go either way


def test_matrices_are_summed_in_levels(spark):
    from lexaline.llm.common import pack, unpack

    rows = [(i, bytearray(pack(np.full(4, float(i))))) for i in range(100)]
    got = classifier.summed(spark.createDataFrame(rows, "slot int, sums binary"), slots=3)
    assert 1 <= len(got) <= 3 and sum(unpack(g, float)[0] for g in got) == sum(range(100))


def test_isotonic():
    rates = classifier.isotonic(np.array([4, 0, 2, 4]), np.array([2, 0, 0, 4]))
    assert (np.diff(rates) >= 0).all() and len(rates) == 4 and rates[0] == rates[2] == 2.5 / 7


# 5


def fingerprint_brute(t, width=3):
    ws = [lower(w) for w in WORDS.findall(t or "")]
    grams = [" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)] if len(ws) > width else [" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_brute(prints, bits):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(rows, docs, odd, empty):
    prints = {i: fingerprint_brute(t) for i, t in rows}
    want = groups_brute(prints, 2)
    got = by_id(simhash.near_duplicates(docs))
    assert {i: (f"{prints[i]:016x}", want[i]) for i in prints} == {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()}
    assert len(set(want.values())) < len(want)
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("bits", "hot", "few"), [(2, 1 << 14, 256), (2, 3, 2), (5, 1 << 14, 2), (7, 8, 4)])
def test_simhash_links_within_hot_keys(spark, monkeypatch, bits, hot, few):
    monkeypatch.setattr(simhash, "FEW", few)
    rng = random.Random(bits)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(30):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits + 1))))
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    got = {r["node"]: r["root"] for r in simhash.components(simhash.link(spark.createDataFrame([(p,) for p in signed], "print long"), bits, hot)).collect()}
    want = groups_brute(signed, bits)
    assert all(got.get(i, i) == want[i] for i in signed)


def test_one_of_each(spark, odd):
    base = " ".join(f"w{i}" for i in range(200))
    some = spark.createDataFrame([(3, base), (1, base), (2, base.replace("w100 ", "x ")), (4, " ".join(f"v{i}" for i in range(200))), (None, base), (5, None), (6, "")], "doc_id long, text string")
    assert sorted((r["doc_id"] for r in simhash.one_of_each(some).collect()), key=str) == [1, 4, 5, None]
    out = simhash.one_of_each(odd)
    assert out.columns == odd.columns and out.where("doc_id is null").count() == 1


def alike_brute(texts, similarity=0.8):
    """What stays if, in order of id, a text goes that is alike to one that stays."""
    sets, stay = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})(t.split()) for i, t in texts.items()}, []
    for i in sorted(texts):
        if all(len(sets[i] & sets[j]) < similarity * len(sets[i] | sets[j]) for j in stay):
            stay.append(i)
    return stay


def stays(spark, texts):
    rows = list(texts.items())
    random.Random(4).shuffle(rows)
    return sorted(r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())


def test_one_of_each_in_chains(spark):
    words, texts = [f"w{i}" for i in range(400)], {}
    for i in range(14):  # each has three words more changed than the one before it, so that the ends are unlike; and a copy
        texts[i] = texts[40 + i] = " ".join(words)
        for k in range(3):
            words[(i * 3 + k) * 9] = f"x{i}-{k}"
    want = alike_brute(texts)
    assert 1 < len(want) < 14 and stays(spark, texts) == want


def test_one_of_each_finds_all_pairs(spark):
    rng, texts = random.Random(9), {}
    for i in range(80):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts[i] = " ".join(words)
        for k in range(i % 20):
            words[7 + 13 * k] = "other"
        texts[100 + i] = " ".join(words)
    want = alike_brute(texts)
    assert 100 < len(want) < 140 and stays(spark, texts) == want


def test_one_of_each_is_exact_for_long_texts(spark):
    texts = {}
    for i in range(24):
        words = [f"w{i}-{k}" for k in range(5004)]
        texts[i] = " ".join(words)
        for k in range((107 if i % 2 else 116)):  # each takes five of 5,000 shingles: similarity 0.807 or 0.792
            words[20 + 30 * k] = "other"
        texts[100 + i] = " ".join(words)
    want = alike_brute(texts)
    assert len(want) == 36 and stays(spark, texts) == want


def test_one_of_each_takes_batches_by_bytes(spark, monkeypatch):
    """A batch of 10,000 whole texts or pairs of sets took more memory than two workers have beside an executor's heap."""
    most, before = 5 << 20, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def small_only(make):
        def made(*args):
            inner = make(*args)

            def small(batches):
                for x in batches:
                    if x.nbytes > most:
                        raise ValueError(f"a batch of {x.num_rows} rows and {x.nbytes} bytes")
                    yield x

            return lambda batches: inner(small(batches))

        return made

    for name in ("repeated", "signatures", "fingerprints", "whole_sets", "too_alike"):
        monkeypatch.setattr(simhash, name, small_only(getattr(simhash, name)))
    # document 2n + 1 is 2n with one word more, and 12 MB of text are in one partition
    words = "concat_ws(' ', transform(sequence(1, 400), i -> concat('w', i + 1000 * (id div 2))), if(id % 2 = 1, 'more', null))"
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", f"{words} AS text")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).select("doc_id").collect()) == list(range(0, 3000, 2))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_one_of_each_goes_by_simhash_first(spark, monkeypatch):
    """With prefix filtering off, near copies go if their fingerprints link them to the least of a class that surely stays."""
    rng, texts, other = random.Random(6), {}, {}
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(1500)]
        texts[100 + i] = " ".join(words)
        words[9 : 9 + 90 * (i % 9) : 90] = ["other"] * (i % 9)
        texts[200 + i] = " ".join(words) + " end"
    for i in range(0, 40, 3):  # a lesser one, alike and not linked, so that this class is not settled by its least
        words = texts[100 + i].split()
        words[5:1500:70] = ["x"] * len(words[5:1500:70])
        other[i] = " ".join(words)
    prints = {i: simhash.fingerprint(simhash.text_hashes(t.encode(), 5)) for i, t in (texts | other).items()}
    far = lambda i, j: (prints[i] ^ prints[j]).bit_count()
    assert all(far(i, 100 + i) > 2 and far(i, 200 + i) > 2 for i in other)
    linked = {200 + i for i in range(40) if far(100 + i, 200 + i) <= 2}
    assert 10 < len(linked) < 40 and any(i - 200 in other for i in linked)
    want = alike_brute(texts | other)
    assert len(want) == 40 and stays(spark, texts | other) == want

    def none(leads, similarity):
        def run(batches):
            for x in batches:
                yield pa.RecordBatch.from_arrays([x.column(1).slice(0, 0), x.column(1).slice(0, 0)], ["a", "b"])

        return run

    monkeypatch.setattr(simhash, "met", none)
    assert stays(spark, texts | other) == sorted({*texts, *other} - {i for i in linked if i - 200 not in other})


def test_met_rows_go_on_over_batches():
    rng = random.Random(2)
    rows = sorted((rng.randrange(9), i, rng.randrange(70, 130)) for i in range(120))
    for leads, step in ((2, 7), (4, 1), (4, 120)):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.int32())], ["key", "doc_id", "size"]) for some in (rows[i : i + step] for i in range(0, 120, step))]
        got = sorted(((a, b) for x in simhash.met(leads, 0.8)(iter(batches)) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)), key=str)
        groups = defaultdict(list)
        for k, d, n in rows:
            groups[k].append((d, n))
        want = [(a, b) for g in groups.values() for i, (b, m) in enumerate(g) for a, n in g[: min(i, leads)] if min(n, m) >= 0.8 * max(n, m)] + [(None, b) for g in groups.values() for b, _ in g[leads:]]
        assert got == sorted(want, key=str) and len(want) < 120 * leads


def test_similarity_of_sets():
    a, b = (np.arange(*r, dtype=np.uint64).tobytes() for r in ((0, 100), (50, 150)))
    assert simhash.alike(a, b) == pytest.approx(50 / 150) and simhash.alike(b"", b"") == 1 and simhash.alike(a, b"") == 0


def test_bitmaps_never_deny_alike_sets():
    rng = np.random.default_rng(7)
    told = 0
    for _ in range(400):
        n = int(rng.integers(0, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((rng.permutation(a)[: int(len(a) * rng.uniform(0.3, 1))], rng.integers(0, 1 << 63, int(rng.integers(0, 30))).astype(np.uint64))))
        really = simhash.alike(a.tobytes(), b.tobytes()) >= 0.8
        for x, y in ((a, b), (b, a)):
            may = simhash.may_be_alike(simhash.bitmap(x), simhash.bitmap(y), len(x), len(y), 0.8)
            assert may or not really
            told += not may
    assert told > 400  # most that aren't alike are denied


def test_prefixes_of_alike_sets_share_a_shingle():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        b = np.unique(np.concatenate((rng.permutation(a)[: len(a) - int(rng.integers(0, 1 + len(a) // 5))], rng.integers(0, 1 << 40, int(rng.integers(0, 3))).astype(np.uint64))))
        keys = np.sort(rng.permutation(a)[: int(rng.integers(0, len(a) + 1))])  # some are frequent
        powers = rng.integers(5, 20, len(keys)).astype(np.uint8)
        if simhash.alike(a.tobytes(), b.tobytes()) >= 0.8:
            assert np.isin(simhash.prefix(a, keys, powers, 0.8), simhash.prefix(b, keys, powers, 0.8)).any()


def test_shingles_of_texts():
    texts_ = ["One two", "one  TWO three four five", "", "a b c d e f a b c d e", "x " * 9]
    (first, sets), *rest = simhash.shingle_sets([t.encode() for t in texts_], 5)
    assert first == 0 and not rest and [len(s) for s in sets] == [1, 1, 0, 6, 1]
    again = [s for _, sets in simhash.shingle_sets([t.lower().encode() for t in texts_[::-1]], 5) for s in sets][::-1]
    assert all((a == b).all() for a, b in zip(sets, again, strict=True))


def test_frequent_shingles_go_last(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    passage = prose(60)
    df = spark.createDataFrame([(i, f"{prose(25)} {passage} {prose(15)}" if i % 2 else prose(90)) for i in range(200)], "doc_id long, text string").repartition(2)
    keys, powers = simhash.frequent(df, 5)
    (_, sets), = simhash.shingle_sets([passage.encode()], 5)
    assert set(keys.tolist()) == set(sets[0].tolist()) and set(powers.tolist()) == {6}
    assert len(simhash.frequent(df, 5, 10)[0]) == 0  # more than are told apart: no order but by hash
    (_, some), = simhash.shingle_sets([(passage + " " + prose(40)).encode()], 5)
    assert not np.isin(simhash.prefix(some[0], keys, powers, 0.8), sets[0]).any()
    assert simhash.one_of_each(df).count() == 200


# 6


@pytest.mark.parametrize(("segment", "chunk"), [(32 << 10, 8 << 10), (200, 64)])
def test_warc_round_trip(spark, segment, chunk):
    long = "é日" * 400 + "WARC/1.1\r\n\r\n0\r\n\r\n"
    pages = [(1, "http://a/ b", long), (9, None, long), (4, "x", long), (2, "y", "short"), (3, "y", "short"), (5, "z", None), (6, "z", ""), (None, "n", long), (7, "q", "z" * 70_000), (8, "q", "z" * 999), (10, "q", "z" * 999)]
    df = spark.createDataFrame([(*p, "t", 3) for p in pages], "page_id long, url string, html string, record_type string, digest int")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in warc.archive(df, segment=segment, chunk=chunk).collect()), key=str)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        of = 9 if h == long and i != 9 else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if of else "response", of, None if of else b))
    assert got == sorted(want, key=str)
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_damage():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.framed(b"hello", 2)
    assert warc.body_of(block) == b"hello" and warc.body_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    parts = [{"number": n, "total": t, "kind": "response", "page_id": 1, "refers_to": None, "digest": None, "block": b} for n, t, b in ((2, len(block), block[9:]), (1, None, block[:9]))]
    assert [p["payload"] for p in warc.decoded("a", parts, False)] == [b"hello"] and len(warc.decoded("a", parts * 3, False)) == 3
    for broken in ({"number": 3}, {"total": 5}, {"total": None}):
        with pytest.raises(ValueError):
            warc.decoded("a", [parts[0] | broken, parts[1]], False)
    with pytest.raises(ValueError):
        list(warc.parsed(b"WARC/1.1\r\nContent-Length: 99\r\nWARC-Type: response\r\n\r\nabc"))


def test_warc_files_and_references(spark, tmp_path):
    import glob
    import gzip

    same = "the same payload " * 100
    pages = spark.createDataFrame([(1, "u1", same), (2, "u2", same), (3, "u3", "x"), (3, "u3", "x"), (4, "u", "y" * 500), (4, "u", "y" * 500)], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_path}/a", segment=200)
    data = b"".join(open(f, "rb").read() for f in glob.glob(f"{tmp_path}/a/*.txt*"))
    heads = [h for h, _ in warc.parsed(gzip.decompress(data))]
    names = {h["warc-record-id"]: h.get("x-page-id") for h in heads}
    assert [names[h["warc-refers-to"]] for h in heads if h["warc-type"] == "revisit"] == ["2"]  # an identifier that a record has
    members = data.split(b"\x1f\x8b\x08")  # each record in a member of its own, each followed by an empty one
    assert len(members) >= 1 + 2 * len(heads)
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, f"{tmp_path}/a").collect())
    assert got == [(1, len(same), "revisit", 2), (2, len(same), "response", None), (3, 1, "response", None), (3, 1, "response", None), (4, 500, "response", None), (4, 500, "response", None)]
    lone = gzip.compress(warc.record("revisit", "urn:a", b"", {"WARC-Refers-To": "<urn:gone>", "WARC-Payload-Digest": "sha1:" + "A" * 32}))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part-0.txt").write_bytes(lone)
    with pytest.raises(Exception, match="refers to no record"):
        warc.read_archives(spark, f"{tmp_path}/b").collect()


def test_ids_of_other_types_are_refused(spark):
    for call in (lambda: passages.drop_passages(spark.createDataFrame([("a", "b")], "doc_id string, text string")), lambda: lines.dedup_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string")), lambda: warc.archive(spark.createDataFrame([("a", "b", "c")], "page_id string, url string, html string"))):
        with pytest.raises(TypeError, match="integer type"):
            call()


# 7


def test_leaks(spark, rows, odd, empty):
    clean = dict(rows)[20]
    items = [(1, "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu."), (2, "one"), (3, None), (4, ""), (5, " ".join(clean.split()[:30])), (5, " ".join(clean.split()[:30])), (None, "solo words never seen anywhere else.")]
    leak = "alpha, BETA gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = odd.unionByName(spark.createDataFrame([(900, " ".join(f"q{i}" for i in range(150)) + " " + leak + " end", *[None] * 10), (901, leak.replace("kappa", "other"), *[None] * 10), (902, "alpha beta gamma", *[None] * 10)], SCHEMA))
    df = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.leaks(docs, df)
    got = Counter((r["doc_id"], r["item_id"]) for r in out.collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        terms = decontaminate.terms_of((r["text"] or "").encode())
        for i, t in items:
            q, a = decontaminate.question_and_answer((t or "").encode(), None)
            sets = [decontaminate.shingles(q), decontaminate.shingles(a)]
            own = {b" ".join(terms[k : k + w]) for w in range(1, 6) for k in range(len(terms))}
            half = all(2 * len(set(x) & set(terms)) >= len(set(x)) for x in (q, a))
            if (q or a) and half and sum(len(s & own) for s in sets) >= 0.8 * sum(map(len, sets)):
                want[r["doc_id"], i] += 1
    assert got == want and want[900, 1] == 1 and want[20, 5] == 4 and not want[901, 1]
    # however the items are divided, all values are the same
    whole = sorted(map(str, out.collect()))
    for n in (2, 3):
        assert sorted(map(str, decontaminate.leaks(docs, df, part_items=n).collect())) == whole
    left = decontaminate.without_leaks(docs, df)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}
    assert decontaminate.leaks(empty, df).count() == 0 and decontaminate.leaks(docs, df.limit(0)).count() == 0


def bm25_brute(items, words):
    """An item's share of its own BM25 score in a passage, by the textbook."""
    terms = {i: decontaminate.terms_of(t) for i, t in items}
    n, mean = len(terms), sum(map(len, terms.values())) / len(terms)
    df = Counter(w for ws in terms.values() for w in set(ws))

    def weight(i, w):
        tf, ws = terms[i].count(w), terms[i]
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))

    return {i: sum(weight(i, w) for w in set(terms[i]) & set(words)) / sum(weight(i, w) for w in set(terms[i])) for i in terms}


def test_bm25_of_single_passages(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.6))}" for _ in range(30))) for i in range(60)]
    docs = [(i, " ".join(["no", *t.split(), "no"])) for i, t in items]
    docs += [(100 + i, t.replace(t.split()[3], "other", 1)) for i, t in items]
    out = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), part_items=30).collect()
    assert {(i, i) for i, _ in items} <= {(r["doc_id"], r["item_id"]) for r in out} and any(r["doc_id"] >= 100 for r in out)
    texts_ = dict(docs)
    for r in out:  # these texts are one passage
        want = bm25_brute([(i, t.encode()) for i, t in items], decontaminate.terms_of(texts_[r["doc_id"]].encode()))
        assert r["bm25"] == pytest.approx(want[r["item_id"]], abs=1e-9) and r["bm25"] >= 0.6


def test_a_changed_word_is_still_a_leak(spark):
    item = "What is the name of the river that flows through the old town of the north, past seven mills and under nine stone bridges, and comes after two days and a night into the grey sea beyond? It is the Ember."
    words = item.split()
    docs = [(k, "some text before " + " ".join([*words[:k], "changed", *words[k + 1 :]]) + " and after") for k in range(len(words))]
    found = {r["doc_id"] for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert len(found) >= 0.6 * len(words)


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(3)
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.7))}" for _ in range(20)).encode(), None) for i in range(100)]
    index = decontaminate.Index(items)
    impact = defaultdict(dict)
    for t in index.terms.values():
        for p in range(index.start[t], index.start[t + 1]):
            impact[t][int(index.item[p])] = float(index.impact[p])
    for _ in range(50):
        ids = np.array(sorted(rng.sample(list(index.terms.values()), 30)) + [])
        want = {i for i in range(100) if sum(impact[t].get(i, 0) for t in ids.tolist()) >= 0.3}
        got = {i for _, at in index.candidates(ids, np.zeros(len(ids), np.int64), 1, 0.3) for i, _ in index.wand(at, 0.3)}
        assert got == want


# 8


@pytest.mark.parametrize(("window", "phrase"), [(50, 20), (7, 3), (4, 4)])
def test_passages(rows, docs, odd, empty, window, phrase):
    low, own = {}, {i: WORDS.findall(t or "") for i, t in rows}
    for i in sorted(own):
        for k in range(len(own[i]) - window + 1):
            low.setdefault(tuple(own[i][k : k + window]), i)
    want = {}
    for i, ws in own.items():
        gone = set()
        for k in range(len(ws) - window + 1):
            if low[tuple(ws[k : k + window])] < i:
                gone |= set(range(k, k + window))
        want[i] = (len(ws), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passages.drop_passages(docs, window=window, phrase=phrase).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 100
    if window == 50:
        assert passages.drop_passages(odd).count() == odd.count() and passages.drop_passages(empty).count() == 0


def passes(rows, window=50, phrase=20, chunks=3):
    """The operator's own functions over chunks, without Spark: words removed by doc_id."""
    tables = [pa.table({"doc_id": pa.array([i for i, _ in rows if i % chunks == c], pa.int64()), "text": pa.array([t for i, t in rows if i % chunks == c], pa.string()), "chunk": pa.array([c for i, _ in rows if i % chunks == c], pa.int32())}) for c in range(chunks)]

    def by(column, parts):
        whole = pa.concat_tables(parts)
        return lambda v: whole.filter(pa.compute.equal(whole[column], v))

    size = {"shards": chunks, "window": window, "phrase": phrase}
    sent = by("shard", [passages.send_anchors(t, **size) for t in tables])
    known = by("chunk", [passages.recurring(sent(s)) for s in range(chunks) if sent(s).num_rows])
    sent2 = by("shard", [passages.send_windows(t, known(c), **size) for c, t in enumerate(tables)])
    owned = by("chunk", [passages.owned(sent2(s)) for s in range(chunks) if sent2(s).num_rows])
    found = by("chunk", [passages.send_passages(t, owned(c), window) for c, t in enumerate(tables)])
    return {r["doc_id"]: r["n_removed"] for c, t in enumerate(tables) for r in passages.drop(t, found(c), window, phrase).to_pylist()}


def test_only_the_automata_locate(rows, monkeypatch):
    want = passes(rows)
    assert sum(want.values()) > 300
    found = passages.Automata.hits
    monkeypatch.setattr(passages.Automata, "hits", lambda self, *args: iter(()))
    assert not any(passes(rows).values())
    # several small ones find as much as one
    monkeypatch.setattr(passages.Automata, "hits", found)
    monkeypatch.setattr(passages, "PATTERNS", 2)
    assert passes(rows) == want


def test_passages_of_repeating_words():
    some = [(1, "a " * 300 + "b"), (2, "a " * 120), (3, "x " + "a b " * 60), (4, "b a " * 40 + "c"), (5, "a " * 49 + "b"), (6, "a " * 50)]
    own = {i: t.split() for i, t in some}
    low = {}
    for i in sorted(own):
        for k in range(len(own[i]) - 49):
            low.setdefault(tuple(own[i][k : k + 50]), i)
    want = {i: len({k + d for k in range(len(ws) - 49) if low[tuple(ws[k : k + 50])] < i for d in range(50)}) for i, ws in own.items()}
    assert passes(some) == want and want[2] == 120 and want[4] > 0


# 9


def test_secrets(spark, rows, docs, odd, empty):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = by_id(secrets.find_secrets(docs))
    for i, t in rows:
        t = t or ""
        found = sorted([(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(f[1] == k for f in found) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(r["spans"].split(","))
    assert any(r["n_copied"] for r in got.values())  # one access key in several sources
    key = "ghp_" + "a1B2c3D4e5F6g7H8i9J0" * 2
    some = spark.createDataFrame([(1, f"é {key}", "a"), (2, key.replace("a1", "z9"), "a"), (3, key.replace("a1", "z9"), "b"), (4, key.replace("a1", "z9"), "c"), (5, None, None), (6, "tOKEN: 'abc123'", None), (7, "pass ſecret = abcdef1", "d")], "doc_id long, text string, source string")
    got = by_id(secrets.find_secrets(some))
    assert got[1]["spans"] == f"github:2:{2 + len(key)}" and got[1]["n_live"] == 1 and got[4]["spans"] == "" and got[6]["n_assign"] == 1 and got[7]["n_assign"] == 0
    assert secrets.find_secrets(odd).count() == odd.count() and secrets.find_secrets(empty).count() == 0


def test_secrets_by_repositories_and_owners(spark):
    """Values that only owners, only repositories, both or neither tell to be copies, against counts by hand."""
    key = lambda k: "ghp_" + hashlib.sha256(str(k).encode()).hexdigest().upper()[:38]
    held = {0: [(r, "a") for r in range(6)], 1: [(r, f"o{r}") for r in range(3)], 2: [(r, "a") for r in range(5)], 3: [(r, f"o{r % 2}") for r in range(5)], 4: [(9, None), (8, None)]}
    some = [(100 * k + n, f"see {key(k)}", r, o) for k, at in held.items() for n, (r, o) in enumerate(at)]
    some += [(1000, f"{key(0)} and {key(2)}", 0, "a")]
    df = spark.createDataFrame(some, "doc_id long, text string, repo long, source string")
    got = by_id(secrets.find_secrets(df, repo="repo", spread=6))
    repos, owners = ({k: len({x[j] for x in at} - {None}) for k, at in held.items()} for j in (0, 1))
    for i, t, _, _ in some:
        own = [k for k in held if key(k) in t]
        copied = [k for k in own if owners[k] >= 3 or repos[k] >= 6]
        r = got[i]
        assert (r["n_copied"], r["n_live"]) == (0, len(own) - len(copied)) and (r["most_repos"], r["most_owners"]) == (max(repos[k] for k in own), max(owners[k] for k in own))
    assert got[0]["spans"] == "" and got[100]["spans"] == "" and got[200]["spans"] and got[300]["spans"] and got[400]["spans"]
    # repositories alone decide for the first value
    assert by_id(secrets.find_secrets(df, repo="repo", spread=7))[0]["spans"]


@pytest.mark.parametrize("raw", [b"", b"a" * 24, b"x" + b"0" * 23, b"0" * 23 + b"g" + b"f" * 30, ("é" + "ab12" * 6 + "日" + "c" * 25).encode()])
def test_hex_runs(raw):
    assert secrets.hex_runs(raw) == [m.span() for m in re.finditer(rb"[0-9a-f]+", raw) if len(m[0]) >= 24]


# 10


def test_mix(spark, rows, docs, odd, empty):
    out = mixing.mix(docs)
    got = by_id(out)
    size = {i: len(WORDS.findall(t or "")) for i, t in rows}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    per = defaultdict(int)
    for i, n in size.items():
        per[source[i]] += n
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = sum(size.values())
    while open_:
        full = {s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) > 3 * per[s] + 1e-9}
        for s in full or open_:
            target[s] = 3 * per[s] if full else left * weights[s] / sum(weights[x] for x in open_)
        left -= sum(3 * per[s] for s in full)
        open_ = open_ - full if full else set()
    for i in size:
        r = got[i]
        assert (r["size"], r["source_size"]) == (size[i], per[source[i]]) and r["target"] == pytest.approx(target[source[i]]) and 0 <= r["taken"] <= 3 * size[i]
    for s in names:
        assert abs(sum(got[i]["taken"] for i in size if source[i] == s) - target[s]) <= 2 * mixing.BLOCK
    again = by_id(mixing.mix(docs.repartition(7)))
    assert {i: r["taken"] for i, r in again.items()} == {i: r["taken"] for i, r in got.items()}
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    kept = mixing.mix(odd, keep_columns=True)
    assert kept.count() == odd.count() and set(kept.columns) == {*odd.columns, "source_size", "target"} and kept.where("taken > 3 * size").count() == 0


def test_mix_of_rows_that_share_an_id(spark):
    """Rows of one doc_id and size, of equal and of other texts: the same rows get the same words in whatever order they come."""
    rng = random.Random(3)
    some = [(i % 20, " ".join(f"w{rng.randrange(99)}" for _ in range(30)), f"s{i % 2}", i) for i in range(120)]
    some += [(None, "no id at all", "s0", 1), (None, "no id at all", "s0", 2), *[(3, "the very same text", "s1", 5)] * 4, (7, None, "s0", 9)]
    df = spark.createDataFrame(some, "doc_id long, text string, source string, size long")
    first = [tuple(r) for r in mixing.mix(df, keep_columns=True, shard_docs=20).collect()]
    rng.shuffle(some)
    again = spark.createDataFrame(some, df.schema).repartition(5)
    assert sorted(map(str, first)) == sorted(str(tuple(r)) for r in mixing.mix(again, keep_columns=True, shard_docs=20).collect()) and len(first) == len(some)
    plain = mixing.mix(df, shard_docs=20).agg({"taken": "sum"}).first()[0]
    assert sum(r[-1] for r in first) == plain


def test_mix_comes_near_over_many_shards(spark):
    """The short last blocks of very many shards don't add up, and no source's blocks go to another."""
    text = F.array_join(F.array_repeat(F.lit("w"), (F.col("doc_id") * F.col("doc_id") % 37).cast("int")), " ")
    df = spark.range(12_000).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"), F.concat(F.lit("s"), F.col("doc_id") % 7 % 5).alias("source"))
    out = mixing.mix(df, shard_docs=5)
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.countDistinct("shard").alias("shards")).collect():
        assert abs(r["taken"] - r["target"]) <= mixing.BLOCK / 2 and r["shards"] > 300
    assert out.where("taken > 3 * size").count() == 0


def test_texts_of_a_megabyte(spark):
    """Operators on two near copies of over a megabyte, in few words of a large vocabulary and in one single word."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(50_000)}" for _ in range(180_000)]
    long = " ".join(words)
    near = " ".join(words[:1000] + ["changed"] * 40 + words[1000:])
    some = [(1, long, "a"), (2, near, "b"), (3, "x" * 1_200_000, "a"), (4, "short", "b"), (5, "\n".join(["a line that comes again and again"] * 30_000), "c")]
    df = spark.createDataFrame(some, "doc_id long, text string, source string").repartition(2)
    assert len(long) > 1_000_000
    judged = by_id(quality.judge_texts(df, spark.createDataFrame([(1,)], "doc_id long")))
    assert [judged[i]["n_words"] for i in range(1, 6)] == [180_000, 180_040, 1, 1, 7 * 30_000] and judged[5]["n_dup_lines"] == 29_999 and judged[5]["base_failed"]
    cut = by_id(passages.drop_passages(df))
    assert cut[2]["n_removed"] >= 180_000 - 2 and cut[1]["n_removed"] == 0 and cut[5]["n_removed"] == 0
    assert by_id(lines.dedup_lines(df))[5]["n_lines"] == 30_000
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == [1, 3, 4, 5]
    assert by_id(simhash.near_duplicates(df))[2]["fingerprint"] == f"{fingerprint_brute(near):016x}"
    item = spark.createDataFrame([(1, " ".join(words[150_000:150_050]))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(df, item).collect()} == {1, 2}
    assert by_id(secrets.find_secrets(df))[3]["n_hex"] == 0 and by_id(mixing.mix(df))[1]["size"] == 180_000
    assert by_id(classifier.score_quality(df, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")))[3]["score"] <= 1
    assert by_id(ctw.score_texts(df))[3]["n_tokens"] == 2


def test_apportionment():
    rng = random.Random(9)
    for _ in range(100):
        votes, seats = [rng.choice([0, 1, 5, 5, rng.random() * 50]) for _ in range(8)], rng.randint(0, 60)
        want = [0] * 8
        for _ in range(seats if sum(votes) else 0):
            want[max(range(8), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(np.array(votes), seats).tolist() == want
    assert mixing.sainte_lague(np.array([9.0, 1.0]), 10, np.array([3, 4])).tolist() == [3, 4]
    assert mixing.targets([10, 1000], [5, 2]) == [30, 980]
