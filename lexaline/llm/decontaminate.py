"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, verified overlap.

The test items are the collection and every training passage is a query.  An item's impacts are its terms'
BM25 weights over the sum of them all, so an item scores 1 against a passage that has all its terms and
one THRESHOLD serves all items.  Postings are in item order and in blocks of BLOCK items, each with the
largest impact of each term.  A passage looks into a block only if the block's maxima for the passage's terms
reach the threshold, and there it moves by WAND from pivot to pivot; every item at or above the
threshold is retrieved.  Retrieved pairs are verified: at least OVERLAP of the five-word shingles of the
question, and of the answer, must stand in the passage.  Where the answer is only the item's last sentence, and may be
a word or two, question and answer are judged together, and of either half the words must stand there too.

Passages are twice as long as the longest item and start every half of that, so that each place where an item may
stand lies whole in a passage.  Numbers of documents per term, of items and mean length are counted once over all
items.  Items go in index parts of at most PART_ITEMS, a bound on what is sent to the tasks; each part scans the
documents once, without a shuffle, and what it finds doesn't depend on the division.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, texts_of

BLOCK, PART_ITEMS, THRESHOLD, OVERLAP, WIDTH, LEAST_WORDS = 4, 20_000, 0.6, 0.8, 5, 32
K1, B = 1.2, 0.75
BATCH_WORDS = 1 << 16
_from = bytes(c for c in range(128) if not chr(c).isalnum()) + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TABLE = bytes.maketrans(_from, b" " * (len(_from) - 26) + b"abcdefghijklmnopqrstuvwxyz")
SENTENCE = re.compile(rb"(?<=[.?!\n])\s+")


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters; A-Z lower-cased."""
    return text.translate(TABLE).split()


def question_and_answer(text: bytes, answer: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """Terms of both; an item that has no answer of its own ends with it, as its last sentence."""
    if answer is not None:
        return terms_of(text), terms_of(answer)
    sentences = [s for s in SENTENCE.split(text) if terms_of(s)]
    if len(sentences) < 2:
        return terms_of(text), []
    return terms_of(b" ".join(sentences[:-1])), terms_of(sentences[-1])


def shingles(words: list[bytes]) -> set[bytes]:
    """Shingles of WIDTH words, or all words if there are fewer."""
    return {b" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))} if words else set()


@dataclass
class Collection:
    """What BM25 knows of all items: how many there are, their mean and largest length, and in how many a term stands."""

    items: int = 0
    mean: float = 1.0
    longest: int = 0
    df: dict[bytes, int] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple]) -> Collection:
        words = [w for w in (sum(question_and_answer(text or b"", answer), []) for _, text, answer in items) if w]
        df: dict[bytes, int] = {}
        for ws in words:
            for w in set(ws):
                df[w] = df.get(w, 0) + 1
        return cls(len(words), sum(map(len, words)) / max(1, len(words)), max(map(len, words), default=0), df)


class Index:
    """Inverted index of one part of the items."""

    def __init__(self, items: list[tuple], of: Collection | None = None):
        """items: (item_id, text, answer or None); those without terms are left out."""
        of = of or Collection.of(items)
        self.items, words = [], []
        for item_id, text, answer in items:
            q, a = question_and_answer(text or b"", answer)
            if q or a:
                self.items.append((item_id, [shingles(q), shingles(a)], None if answer is not None else [set(q), set(a)]))
                words.append(q + a)
        n = len(words)
        self.terms: dict[bytes, int] = {}
        counts = [{w: ws.count(w) for w in sorted(set(ws))} for ws in words]
        item = np.repeat(np.arange(n), [len(c) for c in counts])
        term = np.array([self.terms.setdefault(w, len(self.terms)) for c in counts for w in c], np.int64)
        tf = np.array([k for c in counts for k in c.values()], float)
        length = np.array([len(w) for w in words], float)
        df = np.array([of.df[w] for w in self.terms], float)
        idf = np.log1p((of.items - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / of.mean))
        impact = weight / np.bincount(item, weight, n)[item] if n else weight
        order = np.lexsort((item, term))
        self.item, self.impact = item[order], impact[order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.terms)))))
        # the largest impact of each term in each block of items
        block, term = self.item // BLOCK, term[order]
        new = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (term[1:] != term[:-1])))) if n else np.empty(0, np.int64)
        self.blocks = -(-n // BLOCK)
        self.block, self.block_max = block[new], np.maximum.reduceat(self.impact, new) if n else np.empty(0)
        self.block_at, self.block_end = new, np.append(new[1:], len(block)) if n else new
        self.block_start = np.concatenate(([0], np.cumsum(np.bincount(term[new], minlength=len(self.terms)))))
        self.cell = term[new] * self.blocks + self.block
        self.term_max = np.maximum.reduceat(self.impact, self.start[:-1]) if n else np.empty(0)
        self.passage = max(LEAST_WORDS, 2 * of.longest)

    def candidates(self, ids: np.ndarray, passage: np.ndarray, passages: int, threshold: float):
        """(passage, block, rows of the block table) where the maxima reach the threshold; ids and passage: distinct pairs, by passage.

        The terms of least impact, up to a quarter of the threshold together, can't make a candidate: they
        count with their largest impact at all, and only blocks of the other terms are looked at.
        """
        order = np.lexsort((self.term_max[ids], passage))
        ids, passage = ids[order], passage[order]
        most, begin = self.term_max[ids], np.searchsorted(passage, np.arange(passages + 1))
        total = np.concatenate(([0.0], np.cumsum(most)))
        lesser = total[1:] - total[begin[passage]] <= threshold / 4
        base = np.bincount(passage[lesser], most[lesser], passages)
        own, place = ids[~lesser], passage[~lesser]
        first, n = self.block_start[own], self.block_start[own + 1] - self.block_start[own]
        at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        cell = np.repeat(place, n) * self.blocks + self.block[at]
        order = np.argsort(cell, kind="stable")
        cell, at = cell[order], at[order]
        new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.empty(0, np.int64)
        cell = cell[new]
        bound = np.add.reduceat(self.block_max[at], new) + base[cell // self.blocks] if len(new) else np.empty(0)
        for c in cell[bound >= threshold - 1e-9].tolist():
            p, block = divmod(c, self.blocks)
            want = ids[begin[p] : begin[p + 1]] * self.blocks + block
            at = np.searchsorted(self.cell, want)
            yield p, at[self.cell[np.minimum(at, len(self.cell) - 1)] == want]

    def wand(self, at: np.ndarray, threshold: float):
        """(item, score) of all items of a block that reach the threshold; at: rows of the block table, a term each."""
        lists = []  # of a term's items still ahead, its impacts, its place, its largest impact
        for a, b, most in zip(self.block_at[at].tolist(), self.block_end[at].tolist(), self.block_max[at].tolist(), strict=True):
            lists.append([self.item[a:b].tolist(), self.impact[a:b].tolist(), 0, most])
        while lists:
            lists.sort(key=lambda x: x[0][x[2]])
            bound = 0.0
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= threshold - 1e-9:
                    break
            else:
                return
            pivot = lists[k][0][lists[k][2]]
            if lists[0][0][lists[0][2]] == pivot:
                impacts = []
                for x in lists:
                    if x[0][x[2]] != pivot:
                        break
                    impacts.append(x[1][x[2]])
                    x[2] += 1
                score = math.fsum(impacts)  # the same in whatever order they come
                if score >= threshold - 1e-9:
                    yield pivot, score
            else:
                for x in lists[:k]:
                    x[2] = bisect_left(x[0], pivot, x[2])
            lists = [x for x in lists if x[2] < len(x[0])]

    def verified(self, item: int, words: list[bytes], overlap: float) -> tuple[float, float] | None:
        """Shares of the question's and the answer's shingles in a passage, if both are enough."""
        _, sets, guessed = self.items[item]
        widths = {len(next(iter(s)).split()) for s in sets if s}
        own = {b" ".join(words[i : i + w]) for w in widths for i in range(len(words) - w + 1)}
        shares = [len(s & own) / len(s) if s else 1.0 for s in sets]
        if guessed is None:
            enough = min(shares) >= overlap
        else:
            here = set(words)
            enough = sum(len(s & own) for s in sets) >= overlap * sum(map(len, sets)) and all(2 * len(g & here) >= len(g) for g in guessed)
        return (shares[0], shares[1]) if enough else None

    def find(self, texts: list[bytes], threshold: float, overlap: float):
        """(text, item, first word of the passage, score, question overlap, answer overlap): each pair of text and item once, at its best passage."""
        words = [terms_of(t) for t in texts]
        stride, best = self.passage // 2, {}
        get, ids, where, base = self.terms.get, [], [], [0]
        for ws in words:
            own = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
            hit = np.flatnonzero(own >= 0)
            ids.append(own[hit])
            where.append(hit // stride + base[-1])
            base.append(base[-1] + max(1, -(-len(ws) // stride)))
        ids, where, base = np.concatenate(ids), np.concatenate(where), np.array(base)
        # passage p has strides p and p + 1 of the same text
        begins = np.zeros(base[-1], bool)
        begins[base[:-1]] = True
        earlier = ~begins[where]
        pairs = np.unique(np.concatenate((where, where[earlier] - 1)) * len(self.terms) + np.concatenate((ids, ids[earlier]))) if len(ids) else np.empty(0, np.int64)
        for p, at in self.candidates(pairs % max(1, len(self.terms)), pairs // max(1, len(self.terms)), int(base[-1]), threshold):
            t = int(np.searchsorted(base, p, "right")) - 1
            first = (p - int(base[t])) * stride
            for item, score in self.wand(at, threshold):
                if shares := self.verified(item, words[t][first : first + self.passage], overlap):
                    found = (score, first, *shares)
                    best[t, item] = max(best.get((t, item), found), found, key=lambda f: (f[0], -f[1]))
        for (t, item), (score, first, q, a) in sorted(best.items()):
            yield t, item, first, score, q, a


def counted(batches):
    """(item, length, term) of each distinct term of each item; an item without terms gives nothing."""
    for x in batches:
        rows = []
        for n, (text, answer) in enumerate(zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)):
            words = sum(question_and_answer(text or b"", answer), [])
            rows += [(n, len(words) if i == 0 else None, w) for i, w in enumerate(sorted(set(words)))]
        part, length, term = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(part, pa.int64())), pa.array(length, pa.int64()), pa.array(term, pa.binary())], ["part", "length", "term"])


def parts_of(items: DataFrame, item_id: str, text: str, answer: str | None, part_items: int):
    """Broadcast indexes of at most part_items items each, nearly, in order of a hash of the item."""
    rows = items.select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("text"), (F.col(answer) if answer else F.lit(None)).cast("binary").alias("answer"))
    n = -(-rows.count() // max(1, part_items * 3 // 4)) or 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    terms = df = None
    if n > 1:  # else the one part is the collection
        terms = keep(rows.select("part", "text", "answer").mapInArrow(counted, "part long, length long, term binary"))
        total, mean, longest = terms.agg(F.count("length"), F.avg("length"), F.max("length")).first()
        df = keep(terms.groupBy("term").agg(F.count("*").alias("n")))
    for i in range(n):
        own = [(r["item"], bytes(r["text"] or b""), bytes(r["answer"]) if r["answer"] is not None else None) for r in rows.where(F.col("part") == i).collect()]
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        of = Collection(total, mean or 1.0, longest or 0, {bytes(r["term"]): r["n"] for r in df.join(terms.where(F.col("part") == i).select("term").distinct(), "term").collect()}) if n > 1 else None
        yield items.sparkSession.sparkContext.broadcast(Index(own, of))


def in_batches(texts: list[bytes]):
    """(first text, texts) of about BATCH_WORDS words."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t) // 6
        if size >= BATCH_WORDS or i == len(texts) - 1:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def matched(batches, index, threshold: float, overlap: float, item_type):
    for x in batches:
        rows = []
        for first, texts in in_batches(texts_of(x.column(1))):
            rows += [(first + t, index.value.items[item][0], *rest) for t, item, *rest in index.value.find(texts, threshold, overlap)]
        doc = x.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
        kinds = (item_type, pa.int64(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[1:] if rows else [[]] * 5, kinds, strict=True))], ["doc_id", "item_id", "first_word", "bm25", "question_overlap", "answer_overlap"])


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP, part_items: int = PART_ITEMS) -> DataFrame:
    """A row for each pair of a document and a test item that it holds.

    Returns doc_id, item_id, first_word (of the best passage, in terms), bm25 (share of the item's own
    score), question_overlap, answer_overlap.  A null or empty text holds nothing and an item without terms
    is held by none.  Ids may be null or repeated: each row is searched, each item row is found.  Without
    items or documents there are no rows.  Other columns are ignored.
    """
    out, id_type, item_type = None, docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType
    schema = f"doc_id {id_type}, item_id {item_type.simpleString()}, first_word long, bm25 double, question_overlap double, answer_overlap double"
    from pyspark.sql.pandas.types import to_arrow_type

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    for index in parts_of(items, item_id, item_text, answer, part_items):
        found = own.mapInArrow(partial(matched, index=index, threshold=threshold, overlap=overlap, item_type=to_arrow_type(item_type)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(batches, index, column: int, threshold: float, overlap: float):
    for x in batches:
        bad = {first + found[0] for first, texts in in_batches(texts_of(x.column(column))) for found in index.value.find(texts, threshold, overlap)}
        yield x.filter(pa.array([i not in bad for i in range(x.num_rows)], pa.bool_()))


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP, part_items: int = PART_ITEMS) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    for index in parts_of(items, item_id, item_text, answer, part_items):
        docs = docs.mapInArrow(partial(clean, index=index, column=docs.columns.index(text), threshold=threshold, overlap=overlap), docs.schema)
    return docs
