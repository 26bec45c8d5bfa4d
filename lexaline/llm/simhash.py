"""SimHash near-dedup by deletion-variant signatures.

A text's words, A-Z lower-cased, give shingles of SHINGLE words; a fingerprint has 64 bits, each set if it
is set in over half of the shingles' XXH64 values.  Fingerprints link at `bits` or fewer differing bits.

Cut 64 bits into bits // 2 + 1 segments: among `bits` differing bits one segment has at most one.  Each
distinct fingerprint is indexed under each segment with each one of its bits left out, so that two
fingerprints whose segment differs in at most one bit meet under an equal key.  All meetings are
verified on the whole fingerprint.  Only distinct fingerprints enter, so copies cost nothing here.

A key's fingerprints are linked by a spanning forest and never by all pairs: few are compared directly,
many by looking up the neighbours of each one within the key.  A key with more than `hot` of them is
indexed once more, by the bits outside its segment cut in the same way; with two segments of 32 bits
what meets then agrees on all but 18 bits, so no group exceeds 2**18, whatever the corpus.

one_of_each() goes by the similarity of the shingle sets.  The classes above come first: a document that is alike to the
least of its class, by whole sets, is gone for good if that one can have no lesser candidate.  One fingerprint is too coarse
to find the others: at 0.8 two of them differ in about 10 bits.  The exact way for these is prefix filtering, which misses none: put
all shingles in one order, and two sets of similarity s share one of the first n - ceil(s n) + 1 of either (Chaudhuri, Ganti,
Kaushik: A primitive operator for similarity joins, 2006).  The order has frequent shingles last, so that texts do not meet for a passage
that very many hold, and texts that meet at a shingle after which too few are left are no candidates.  Which are frequent is counted in each task and summed; at most FREQUENT of them are told apart,
by powers of two, and any order whatever gives the same answer.  Candidates are told apart by bitmaps first, in which
each shingle turns one bit: two sets differ in as many shingles at least as their bitmaps in bits.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, forest, hashed_words, in_batches, keep, mixed, parts, rolled, texts_of

SHINGLE, BITS, SEED, FEW, HOT = 3, 2, 42, 256, 1 << 14
LEADS, MORE, HELD, FREQUENT, BLOCK = 4, 16, 32, 1 << 20, 2 << 20


def text_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each shingle, repeats included; of all words if there are fewer than width; none without words."""
    words = text.lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    h = xxhash.xxh64_intdigest
    return [h(line[a:b], SEED) for a, b in zip([0, *ends[: -width].tolist()], (ends[width - 1 :] - 1).tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        a = np.array(hashes[i : i + (1 << 16)], ">u8")
        total += np.unpackbits(a.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(width: int):
    def run(batches):
        for x in batches:
            prints = np.array([fingerprint(text_hashes(t, width)) for t in texts_of(x.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return run


def segments(bits: int) -> list[tuple[int, int]]:
    """(shift, length) of bits // 2 + 1 segments that cover 64 bits."""
    n = bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(bits: int):
    """Rows (key, place, print) for each segment and left-out bit of each fingerprint."""

    def run(batches):
        for x in batches:
            p = x.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (shift, length) in enumerate(segments(bits)):
                value = (p >> np.uint64(shift)) & np.uint64((1 << length) - 1)
                for out in range(length):
                    key = value & ~np.uint64(1 << out)
                    place = np.full(len(p), i * 64 + out, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place), pa.array(p.view(np.int64))], ["key", "place", "print"])

    return run


def linked(p: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of distinct fingerprints within `bits` of each other."""
    if len(p) <= FEW:
        i, j = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p[None, :]) <= bits, 1))
        return p[i], p[j]
    p = np.sort(p)
    if bits > 2:  # too many neighbours to look up: compare, some rows at a time
        a, b = [p[:0]], [p[:0]]
        for at in range(0, len(p), FEW):
            i, j = np.nonzero(np.bitwise_count(p[at : at + FEW, None] ^ p[None, at:]) <= bits)
            i, j = i[i < j] + at, j[i < j] + at
            u, v = forest(np.concatenate((*a, p[i])), np.concatenate((*b, p[j])))
            a, b = [u], [v]
        return a[0], b[0]
    free = int(np.bitwise_or.reduce(p ^ p[0]))  # only bits that differ in the group can be turned
    turns = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
    a, b = [], []
    for n in range(1, bits + 1):
        for some in combinations(turns, n):
            q = p ^ np.bitwise_or.reduce(np.array(some, np.uint64))
            at = np.searchsorted(p, q)
            hit = (at < len(p)) & (q > p)
            hit[hit] = p[at[hit]] == q[hit]
            a.append(p[hit])
            b.append(q[hit])
        if sum(map(len, a)) > 4 * len(p):  # keep only a forest of what was found
            u, v = forest(np.concatenate(a), np.concatenate(b))
            a, b = [u], [v]
    return np.concatenate(a), np.concatenate(b)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("place", pa.int32())])


def meet(bits: int, hot: int):
    """Over rows in order of (place, key): edges within each key; the rows of a key with more than hot go on, as b null."""

    def rows(a, b, key=None, place=None):
        n = len(a)
        view = lambda x: pa.array(x.view(np.int64)) if x is not None else pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([view(a), view(b), pa.nulls(n, pa.int64()) if key is None else pa.array(key), pa.nulls(n, pa.int32()) if place is None else pa.array(place)], schema=EDGES)

    def run(batches):
        key, place, prints = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64)
        found_a, found_b, sent = [], [], None  # sent: the hot key whose first rows have gone on already

        def groups(last: bool):
            """Handle all ended groups; keep the one that may go on, unless it is hot: its rows go on as they come."""
            nonlocal key, place, prints, sent
            new = np.flatnonzero((np.diff(key, prepend=0) != 0) | (np.diff(place, prepend=-1) != 0))
            ends = np.append(new[1:], len(key))[: len(new)]
            open_at = len(key) if last or not len(key) else new[-1]
            size = ends - new
            size[:1] += len(key) > 0 and (place[0], key[0]) == sent  # what goes on is no single row
            for s, e in zip(new[size > 1].tolist(), ends[size > 1].tolist(), strict=True):
                if e - s > hot or s == 0 and (place[0], key[0]) == sent:
                    yield rows(prints[s:e], None, key[s:e], place[s:e])
                    sent = (place[s], key[s])
                    open_at = max(open_at, e)
                elif s >= open_at:
                    break
                else:
                    a, b = linked(prints[s:e], bits)
                    found_a.append(a)
                    found_b.append(b)
            key, place, prints = key[open_at:], place[open_at:], prints[open_at:]
            if sum(map(len, found_a)) >= 1 << 18 or last and found_a:
                yield rows(*forest(np.concatenate(found_a), np.concatenate(found_b)))
                found_a.clear()
                found_b.clear()

        for x in batches:
            key = np.concatenate((key, x.column(0).to_numpy(zero_copy_only=False)))
            place = np.concatenate((place, x.column(1).to_numpy(zero_copy_only=False)))
            prints = np.concatenate((prints, x.column(2).to_numpy(zero_copy_only=False).view(np.uint64)))
            yield from groups(False)
        yield from groups(True)

    return run


def again(bits: int):
    """Rows of hot keys, indexed once more by the bits outside the key's segment."""
    cut = segments(bits)

    def run(batches):
        for x in batches:
            p = x.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key, place = x.column(1).to_numpy(zero_copy_only=False), x.column(2).to_numpy(zero_copy_only=False)
            first = place // 64
            shift, length = (np.array(c, np.uint64)[first] for c in zip(*cut, strict=True))
            low = p & ((np.uint64(1) << shift) - np.uint64(1))
            rest = low | ((p >> shift) >> length) << shift  # the other bits, closed up
            n = bits // 2 + 1
            total = 64 - int(length.min()) if len(length) else 0
            for i in range(n):
                a, b = total * i // n, total * (i + 1) // n
                value = (rest >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
                for out in range(b - a):
                    second = value & ~np.uint64(1 << out)
                    mark = np.full(len(p), i * 64 + out, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(second.view(np.int64)), pa.array(mark), pa.array(p.view(np.int64))], ["key", "place", "second", "mark", "print"])

    return run


def link(prints: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column print) within `bits` of each other."""
    n = parts(prints.sparkSession)
    rows = prints.select("print").mapInArrow(variants(bits), "key long, place int, print long")
    met = rows.repartition(n, "place", "key").sortWithinPartitions("place", "key").mapInArrow(meet(bits, hot), "a long, b long, key long, place int")
    met = keep(met)
    edges = met.where("b is not null").select("a", "b")
    hots = met.where("b is null").select(F.col("a").alias("print"), "key", "place")
    if not hots.isEmpty():
        more = hots.select("print", "key", "place").mapInArrow(again(bits), "key long, place int, second long, mark int, print long")
        more = more.repartition(n, "place", "key", "mark", "second").sortWithinPartitions("place", "key", "mark", "second")
        packed = more.select(F.xxhash64("place", "key", "second").alias("key"), "mark", "print")  # equal keys stay side by side
        edges = edges.unionByName(packed.mapInArrow(meet(bits, 1 << 62), "a long, b long, key long, place int").select("a", "b"))
    return edges


def classes(own: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """doc_id, print, component_id for rows of doc_id and print, which are written already."""
    distinct = keep(own.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(link(distinct, bits, hot))
    classed = distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = keep(classed.join(least, "root").select("print", "component_id"))
    return own.join(answer, "print").select("doc_id", "print", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, width: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """The class of near copies of every document.

    Returns doc_id, fingerprint (16 hex digits), component_id (the least doc_id that is reachable over
    links of `bits` or fewer differing bits, itself included).
    A null or empty text, or one without words, has fingerprint zero and links like any other.  A null
    doc_id is never the least one unless its class has no other, and then component_id is null.
    Repeated rows are returned as often.  Other columns are ignored.  An empty table gives no rows.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    own = keep(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(fingerprints(width), f"doc_id {id_type}, print long"))
    return classes(own, bits, hot).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(texts: list[bytes], width: int):
    """(first text, sets) for about BLOCK bytes of texts at a time: each text's distinct shingles as hashes, in order.

    Words are A-Z lower-cased; a text of fewer words has one shingle of all of them, one without words has none.
    """
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK or i == len(texts) - 1:
            h, at, *_ = hashed_words([x.lower() for x in texts[first : i + 1]])
            every, at = mixed(rolled(h, width, 0x9E3779B97F4A7C15)), at.tolist()
            yield first, [np.unique(every[a : b - width + 1]) if b - a >= width else mixed(rolled(h[a:b], b - a, 0xD6E8FEB86659FD93)) if b > a else every[:0] for a, b in zip(at, at[1:], strict=False)]
            first, size = i + 1, 0


def whole_sets(width: int):
    def run(batches):
        for x in batches:
            for first, sets in shingle_sets(texts_of(x.column(1)), width):
                own = [s.tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([x.column(0).slice(first, len(own)), pa.array(own, pa.binary())], ["doc_id", "hashes"])

    return run


def alike(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of hashes in order; empty ones are alike."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def repeated(width: int):
    """(key, n) of the shingles that come in two or more texts of the same block, as a number of texts."""

    def run(batches):
        for x in batches:
            for _, sets in shingle_sets(texts_of(x.column(0)), width):
                key, n = np.unique(np.concatenate(sets), return_counts=True)
                some = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["key", "n"])

    return run


def frequent(texts: DataFrame, width: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that HELD or more texts seem to have, in order, and the power of two of their number: at most `most`, the most frequent."""
    power = F.floor(F.log2("n")).cast("int").alias("power")
    counts = texts.select("text").mapInArrow(repeated(width), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = keep(counts.where(F.col("n") >= HELD).select("key", power))
    least, total = 64, 0
    for r in sorted(counts.groupBy("power").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["power"]):
        total += r["n"]
        if total > most:
            break
        least = r["power"]
    rows = counts.where(F.col("power") >= least).toArrow()
    keys, powers = rows["key"].to_numpy().view(np.uint64), rows["power"].to_numpy().astype(np.uint8)
    order = np.argsort(keys)
    return keys[order], powers[order]


def prefix(own: np.ndarray, keys: np.ndarray, powers: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set by one of which any set that is alike to it can be found."""
    n = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1
    if len(own) and len(keys):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        power = np.where(keys[at] == own, powers[at], 0)
        if power.any():
            return own[np.argsort(power, kind="stable")[:n]]
    return own[:n]


def bitmap(own: np.ndarray) -> bytes:
    """A bit, turned by each shingle that falls on it, for about each half of a shingle; a power of two of bits."""
    bits = max(64, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 64
    turned = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").tobytes()


def may_be_alike(a: bytes, b: bytes, n: int, m: int, similarity: float) -> bool:
    """Whether sets of n and m shingles with these bitmaps can have that similarity."""
    if min(n, m) < similarity * max(n, m):
        return False
    x, y = sorted((int.from_bytes(a, "little"), int.from_bytes(b, "little")), key=int.bit_length) if len(a) == len(b) else (int.from_bytes(min(a, b, key=len), "little"), int.from_bytes(max(a, b, key=len), "little"))
    bits, less = 8 * max(len(a), len(b)), 8 * min(len(a), len(b))
    while bits > less:  # the longer one as it were if it were shorter
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (x ^ y).bit_count() <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6


def maybe(similarity: float):
    def run(batches):
        for x in batches:
            hit = pa.array([may_be_alike(*row, similarity) for row in zip(*(x.column(i).to_pylist() for i in (2, 4, 3, 5)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0).filter(hit), x.column(1).filter(hit)], ["a", "b"])

    return run


def signatures(width: int, similarity: float, common):
    """Of each text the hash of its shingle set, in two halves, its prefix, its size and its bitmap."""

    def run(batches):
        keys, powers = common.value
        for x in batches:
            for first, sets in shingle_sets(texts_of(x.column(1)), width):
                halves = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), SEED), np.int64) for s in sets])
                own = [prefix(s, keys, powers, similarity).view(np.int64) for s in sets]
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32)), pa.array(np.concatenate(own)))
                yield pa.RecordBatch.from_arrays([x.column(0).slice(first, len(sets)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), flat, pa.array([len(x) for x in sets], pa.int32()), pa.array(map(bitmap, sets), pa.binary())], ["doc_id", "half", "other", "keys", "size", "bits"])

    return run


def too_alike(similarity: float):
    def run(batches):
        for x in batches:
            hit = pa.array([min(len(a), len(b)) >= similarity * max(len(a), len(b)) and alike(a, b) >= similarity for a, b in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0).filter(hit), x.column(1).filter(hit)], ["a", "b"])

    return run


def met(leads: int, similarity: float):
    """Over rows (key, doc_id, size) in order of the first two: (a, b) for each row b and each a of the first `leads` of its
    key that come before it, unless their sizes alone keep them from being alike; b with a null if it is itself none of
    those first ones.

    A fourth column says how many shingles of the set are left from this one on, in the order of all.  If two sets share none
    before it they have at most as many in common as either has left; where that is too few nothing is lost, since sets that
    share one before it meet there.
    """

    def run(batches):
        key, ids, n, left, done = np.empty(0, np.int64), None, np.empty(0, np.int32), np.empty(0, np.int32), 0  # the first rows of the key that may go on, and how many
        for x in batches:
            if not x.num_rows:
                continue
            key = np.concatenate((key, x.column(0).to_numpy(zero_copy_only=False)))
            ids = x.column(1) if ids is None else pa.concat_arrays([ids, x.column(1)])
            n = np.concatenate((n, x.column(2).to_numpy(zero_copy_only=False)))
            left = np.concatenate((left, x.column(min(3, x.num_columns - 1)).to_numpy(zero_copy_only=False)))
            at = np.arange(len(key))
            start = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
            at, first = at[done:], start[done:]
            for j in range(leads):
                more = at - first > j
                at, first = at[more], first[more]
                if not len(at):
                    break
                near = np.minimum(n[first + j], n[at]) >= similarity * np.maximum(n[first + j], n[at])
                near &= np.minimum(left[first + j], left[at]) >= (n[first + j] + n[at]) * (similarity / (1 + similarity)) - 1e-6
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first[near] + j)), ids.take(pa.array(at[near]))], ["a", "b"])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), ids.type), ids.take(pa.array(at))], ["a", "b"])
            done = min(leads, len(key) - int(start[-1]))
            key, ids, n, left = key[start[-1] : start[-1] + done], ids.slice(int(start[-1]), done), n[start[-1] : start[-1] + done], left[start[-1] : start[-1] + done]

    return run


def settle(edges: DataFrame, unmet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gone, undecided) among documents, given the pairs a < b that are alike and those that others may not have met.

    A document that has met all others stays if no lesser one that is alike to it is left; what is alike to one
    that stays is gone.
    """
    gone = edges.select(F.col("b").alias("doc_id")).limit(0)
    while True:
        tops = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti").join(unmet.withColumnRenamed("doc_id", "a"), "a", "left_anti")
        new = keep(edges.join(tops, "a", "left_semi").select(F.col("b").alias("doc_id")).distinct())
        if new.isEmpty():
            break
        gone = gone.unionByName(new)
        edges = keep(edges.join(new.withColumnRenamed("doc_id", "a"), "a", "left_anti").join(new.withColumnRenamed("doc_id", "b"), "b", "left_anti").select("a", "b"))
    gone = keep(gone)
    return gone, keep(unmet.unionByName(edges.select(F.col("b").alias("doc_id"))).distinct().join(gone, "doc_id", "left_anti"))


@in_batches
def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, bits: int = BITS) -> DataFrame:
    """Documents, with all their columns, without those that are near copies of one that stays.

    In order of doc_id, a document goes if the similarity of its shingles of `width` words to those of a lesser one that
    stays is `similarity` or more: no two that stay are alike, and each that goes is alike to one that stays.
    Texts without words are alike.  A document without an id stays.  Rows that share a doc_id are one document and
    stay or go together.

    Of equal shingle sets only the least doc_id is looked at.  SimHash links of `bits` or fewer bits give their classes.  The
    least of a class stays for sure if it is the least under every shingle of its prefix; then all of its class that are alike to
    it, by their whole sets, go.  The rest are compared where their prefixes share a shingle (see above), by their whole
    sets.  Each round compares all members of a key with its first LEADS, not all with all; those first ones are decided, and the
    others go on among themselves with MORE times as many.
    """
    id_type, n = docs.schema[doc_id].dataType.simpleString(), parts(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    common = docs.sparkSession.sparkContext.broadcast(frequent(texts, width))
    own = keep(texts.mapInArrow(signatures(width, similarity, common), f"doc_id {id_type}, half long, other long, keys array<long>, size int, bits binary"))
    firsts = keep(own.groupBy("half", "other").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    lost = own.select("doc_id").join(firsts, "doc_id", "left_anti").distinct()
    of = lambda ids: own.join(ids, "doc_id", "left_semi").select(F.posexplode("keys").alias("pos", "key"), "doc_id", "size").select("key", "doc_id", "size", (F.col("size") - F.col("pos")).alias("left"))
    side = lambda table, name, *columns: table.select(F.col("doc_id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))
    pair = f"a {id_type}, b {id_type}"

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are alike."""
        # each half is written, so that the join on a reads both sides plainly and adaptive execution can split a large group
        half = keep(pairs.join(side(own, "b", "bits", "size"), "b"))
        near = half.join(side(own, "a", "bits", "size"), "a").select("a", "b", "bits_a", "size_a", "bits_b", "size_b")
        pairs = keep(near.mapInArrow(maybe(similarity), pair).distinct())
        members = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        drawn = keep(texts.join(members, "doc_id").mapInArrow(whole_sets(width), f"doc_id {id_type}, hashes binary"))
        discard(half)
        half = keep(pairs.join(side(drawn, "b", "hashes"), "b"))
        whole = half.join(side(drawn, "a", "hashes"), "a").select("a", "b", "hashes_a", "hashes_b")
        edges = keep(whole.mapInArrow(too_alike(similarity), pair).distinct())
        discard(half, drawn)
        return edges

    prints = keep(texts.mapInArrow(fingerprints(width), f"doc_id {id_type}, print long").where("print <> 0"))  # 0: without words
    prints = keep(prints.join(firsts, "doc_id", "left_semi"))
    pairs = keep(classes(prints, bits).where("component_id < doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct())
    heads = of(pairs.select(F.col("a").alias("doc_id")).distinct()).select("key", F.col("doc_id").alias("a"))
    behind = heads.join(of(firsts).groupBy("key").agg(F.min("doc_id").alias("least")), "key").where("least < a").select("a").distinct()
    near = verified(keep(pairs.join(behind, "a", "left_anti"))).select(F.col("b").alias("doc_id")).distinct()
    lost = lost.unionByName(near)
    live, leads = of(keep(firsts.join(near, "doc_id", "left_anti"))), LEADS
    while True:
        pairs = live.repartition(n, "key").sortWithinPartitions("key", "doc_id").mapInArrow(met(leads, similarity), pair)
        pairs = keep(pairs.distinct())
        unmet = pairs.where("a is null").select(F.col("b").alias("doc_id"))
        gone, undecided = settle(verified(pairs.where("a < b")), unmet)
        lost = lost.unionByName(gone)
        if undecided.isEmpty():
            break
        live, leads = of(undecided), leads * MORE
    return docs.join(keep(lost).withColumnRenamed("doc_id", doc_id), doc_id, "left_anti")
