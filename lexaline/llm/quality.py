"""Quality rules: hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Words and pairs of neighbouring words are hashed to BUCKETS buckets.  Two multinomials are counted over
whole tables: one of the trusted documents, one of all documents.  A document's ratio is the mean over its
n-grams of log(trusted share / raw share), and every document is kept or rejected by one fixed threshold;
nothing is drawn at random.  Both shares are smoothed by SMOOTHING trusted occurrences in proportion, so that
a rare n-gram says little: it must not count against a document that nobody has labelled.  The base rules come first: too
few words, or too many words in repeated three-word windows.

One pass counts (a row per bucket, partly summed in each task), one pass scores.  Only the table of
BUCKETS ratios goes to every task, and its size does not depend on the corpus; a larger one, a power of two, is a
parameter for corpora whose vocabulary is larger.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

BUCKETS, SMOOTHING, THRESHOLD, MIN_WORDS, MAX_REPEATED = 1 << 16, 5.0, -0.13, 50, 50
#: Hashes of words that a task remembers before it starts anew.
MEMORY = 1 << 18
SYMBOLS = re.compile(rb"[#*$%&|<>]+")
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


class Hashes(dict):
    """Word to 32-bit hash, computed once for each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


def grams(words: list[bytes], hashes: Hashes, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets, a power of two of them, of a text's words and pairs of neighbouring words."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    every = np.concatenate((h * np.uint64(0xD6E8FEB86659FD93), pairs * np.uint64(0xFF51AFD7ED558CCD)))
    return (every >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def count(buckets: int):
    """Counts of buckets in a task's texts, of all and of the trusted ones."""

    def run(batches):
        raw, trusted, hashes = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), Hashes()
        for x in batches:
            for text, is_trusted in zip(texts_of(x.column(0)), x.column(1).to_pylist(), strict=True):
                at, n = np.unique(grams(text.split(), hashes, buckets), return_counts=True)
                raw[at] += n
                if is_trusted:
                    trusted[at] += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], ["bucket", "raw", "trusted"])

    return run


def repeated(words: list[bytes]) -> int:
    """Words in three-word windows that come twice or more in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    again = np.zeros(len(words), bool)
    hit = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    again[:-2] |= hit
    again[1:-1] |= hit
    again[2:] |= hit
    return int(again.sum())


def code_points(text: bytes) -> int:
    a = np.frombuffer(text, np.uint8)
    return int(np.count_nonzero((a & 0xC0) != 0x80))


def measures(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words, code points in them, symbols, repeated lines, words in repeated windows."""
    words = text.split()
    chars = code_points(text.translate(None, SPACE))
    symbols = sum(map(len, SYMBOLS.findall(text)))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)] if b"\n" in text else []
    return words, chars, symbols, len(lines) - len(set(lines)), repeated(words)


def judge(ratios, threshold: float):
    def run(batches):
        hashes, table = Hashes(), ratios.value
        for x in batches:
            rows = []
            for text in texts_of(x.column(1)):
                words, chars, symbols, lines, again = measures(text)
                n = len(words)
                ratio = float(table[grams(words, hashes, len(table))].sum() / (2 * n - 1)) if n else 0.0
                failed = n < MIN_WORDS or 100 * again > MAX_REPEATED * n
                rows.append((n, chars, symbols, lines, again, failed, not failed and ratio >= threshold, ratio))
            own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(KINDS), KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), *own], ["doc_id", *NAMES])

    return run


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]


def ratio_table(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """log(trusted share / raw share) of each bucket; all zero where one of the two has no words.

    trusted has the ids of trusted documents in its first column; nulls and repeats there do no harm.
    They grow with the corpus, so the join is by shuffle at every size.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("id")).where("id is not null").distinct().withColumn("trusted", F.lit(True)).hint("merge")
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(ids, "id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    rows = own.mapInArrow(count(buckets), "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[rows["bucket"].to_numpy()] = rows["raw"].to_numpy()
    good[rows["bucket"].to_numpy()] = rows["trusted"].to_numpy()
    if not raw.sum() or not good.sum():
        return np.zeros(buckets)
    expected = raw * (good.sum() / raw.sum())
    return np.log((good + SMOOTHING) / (expected + SMOOTHING))


def judge_texts(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Measures, base rules and the ratio's verdict for every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.
    A null or empty text has no words and fails the base rules.  A null doc_id is never trusted.
    Repeated rows are each counted and each judged.  Without trusted words the ratio is 0, and the base
    rules alone decide.  A ratio equal to the threshold is kept.  An empty table gives no rows.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(ratio_table(docs, trusted, doc_id, text, buckets))
    id_type = docs.schema[doc_id].dataType.simpleString()
    out = f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(judge(ratios, threshold), out)


def passing(ratios, column: int, threshold: float):
    def run(batches):
        judged = judge(ratios, threshold)
        for x in batches:
            verdict = next(judged([pa.RecordBatch.from_arrays([x.column(column), x.column(column)], ["doc_id", "text"])]))
            yield x.filter(verdict.column(NAMES.index("kept") + 1))

    return run


def keep_texts(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The documents, with all their columns, that judge_texts() keeps."""
    ratios = docs.sparkSession.sparkContext.broadcast(ratio_table(docs, trusted, doc_id, text, buckets))
    return docs.mapInArrow(passing(ratios, docs.columns.index(text), threshold), docs.schema)
