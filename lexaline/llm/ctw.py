"""LM scoring by context-tree weighting over binary-decomposed bytes.

A text is its lower-cased words, each followed by a space, then one end byte.  Each byte is eight
binary decisions, highest bit first.  Every decision has a tree of contexts: the bits of this byte so
far, with 0 to DEPTH bytes before it.  A node keeps how often 0 and 1 came in the training texts.

    Pe(node) = Krichevsky-Trofimov probability of its 0s and 1s
    Pw(node) = Pe                                  at DEPTH
             = 1/2 Pe + 1/2 product of children Pw  above

The probability of a bit mixes the KT estimates of all nodes on its path: a node counts with
Pe / 2 Pw, and leaves the rest to its child.  A child never seen in training says nothing, and its
parent's estimate stands.  The model is frozen: it is what the training texts taught.

How it runs: chunks of documents send their distinct (DEPTH + 1)-byte strings with training counts to
shards by the three nearest context bytes.  A shard has whole subtrees from depth 3 down.  Depths 0 to 2
have at most 255 * (1 + 256 + 65,536) nodes whatever the corpus, so their sums go to every task.  Each
shard answers each chunk with one log-probability per distinct string, and the chunk scores its texts.
All counts are exact and cover all training texts; nothing is sampled, pruned or hashed away.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_count, chunk_of, held, keep, merged, pack, texts_of, unpack

DEPTH, TOP, END, BLOCK = 5, 2, b"\n", 4 << 20
LN10, PAD = float(np.log(10)), b"\n" * 5


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def stream(text: bytes) -> bytes:
    """The bytes that the model codes: lower-cased words, a space after each, and the end."""
    words = words_of(text)
    return b" ".join(words) + (b" " + END if words else END)


def blocks(texts: list[bytes]):
    """(strings, document of each) for about BLOCK bytes of texts at a time; a string is nearest context byte first, coded byte last."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK or i == len(texts) - 1:
            yield strings(texts[at : i + 1], at)
            at, size = i + 1, 0


def strings(texts: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    a = np.frombuffer(PAD + PAD.join(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts)), lengths)
    where = np.arange(len(doc)) + (doc + 1) * DEPTH
    a = a.astype(np.int64)
    g = np.zeros(len(a), np.int64)
    for back in range(1, DEPTH + 1):
        g[DEPTH:] <<= 8
        g[DEPTH:] |= a[DEPTH - back : len(a) - back]
    return ((g << 8) | a)[where], doc + first


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    near = (keys >> (8 * (DEPTH - 2))).astype(np.uint64)
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % shards


def gather(shards: int):
    """A chunk's documents to rows (chunk, kind, shard, keys, counts) for its distinct strings and words."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        texts, train = [stream(t) for t in texts_of(table["text"])], ~table["held_out"].to_numpy()
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for g, doc in blocks(texts):
            g = np.sort((g << 1) | train[doc])
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            n = np.diff(first, append=len(g))
            keys.append(g[first] >> 1)
            counts.append(n * (g[first] & 1))
        key, count = merged(np.concatenate(keys), np.concatenate(counts))
        rows = []
        at = shard_of(key, shards)
        order = np.argsort(at, kind="stable")
        for s, i in split(at[order], order):
            rows.append((chunk, "bytes", s, pack(key[i], True), pack(count[i])))
        seen, learnt = Counter(), Counter()
        for t, is_train in zip(texts, train, strict=True):
            (learnt if is_train else seen).update(t.split())
        words = list(learnt.keys() | seen.keys())
        at = np.fromiter((hash_word(w) % shards for w in words), np.int64, len(words))
        order = np.argsort(at, kind="stable")
        for s, i in split(at[order], order):
            own = [words[k] for k in i]
            rows.append((chunk, "words", s, b" ".join(own), pack(np.array([learnt[w] for w in own], np.int64))))
        return pa.Table.from_pylist([dict(zip(("chunk", "kind", "shard", "keys", "counts"), r, strict=True)) for r in rows], schema=PARTS)

    return run


PARTS = pa.schema([("chunk", pa.int32()), ("kind", pa.string()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def hash_word(w: bytes) -> int:
    import zlib

    return zlib.crc32(w)


def split(labels: np.ndarray, values: np.ndarray):
    """(label, its values) for sorted labels."""
    if len(labels):
        first = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
        for i, own in zip(first, np.split(values, first[1:]), strict=True):
            yield int(labels[i]), own


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x >= 0.5: Stirling's series eight above, then stepped back down."""
    y = x + 8
    r = 1 / (y * y)
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    steps = x * (x + 1) * (x + 2) * (x + 3)
    return series - np.log(steps) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def bit_nodes(keys: np.ndarray, counts: np.ndarray, bit: int):
    """For (context, byte) keys in order: node of each key, and each node's id and numbers of 0 and 1 at a bit of the byte."""
    ids = keys >> (8 - bit)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    one = (keys >> (7 - bit)) & 1
    of = np.cumsum(np.concatenate(([False], ids[1:] != ids[:-1])))
    n1 = np.add.reduceat(counts * one, first)
    return of, ids[first], np.add.reduceat(counts, first) - n1, n1


def up(ids: np.ndarray, bit: int) -> np.ndarray:
    """A node's parent: the farthest context byte goes, the bits of the coded byte stay."""
    return ((ids >> (8 + bit)) << bit) | (ids & ((1 << bit) - 1))


def levels(keys: np.ndarray, counts: np.ndarray, lowest: int):
    """By depth, from DEPTH to lowest: rows of the keys, and by bit (node of each row, ids, n0, n1, log Pe, log Pw)."""
    out, rows = {}, np.arange(len(keys))
    for depth in range(DEPTH, lowest - 1, -1):
        if depth < DEPTH:
            shorter = ((keys >> 16) << 8) | (keys & 255)
            order = np.argsort(shorter, kind="stable")
            s, c = shorter[order], counts[order]
            fresh = np.concatenate(([True], s[1:] != s[:-1]))
            first, at = np.flatnonzero(fresh), np.empty(len(s), np.int64)
            at[order] = np.cumsum(fresh) - 1
            keys, counts, rows = s[first], np.add.reduceat(c, first), at[rows]
        bits = []
        for bit in range(8):
            of, ids, n0, n1 = bit_nodes(keys, counts, bit)
            pe = log_kt(n0, n1)
            if depth == DEPTH:
                pw = pe
            else:
                _, below, _, _, _, below_pw = out[depth + 1][1][bit]
                parent = np.searchsorted(ids, up(below, bit))
                pw = np.logaddexp(pe, np.bincount(parent, below_pw, len(ids))) - np.log(2)
            bits.append((of, ids, n0, n1, pe, pw))
        out[depth] = (rows, bits)
    return out


def shard_counts(table: pa.Table):
    """A shard's distinct strings with their training counts over all chunks, and each chunk's own strings."""
    own = [unpack(k, np.int64, True) for k in table["keys"].to_pylist()]
    counts = [unpack(k, np.int64) for k in table["counts"].to_pylist()]
    keys, n = merged(np.concatenate(own), np.concatenate(counts))
    return keys, n, own


def tops(table: pa.Table) -> pa.Table:
    """What a shard adds to the nodes of depth TOP: 0s, 1s and the log Pw of its children."""
    keys, n, _ = shard_counts(table)
    bits, nodes, sums = [], [], []
    for bit, (_, ids, n0, n1, _, pw) in enumerate(levels(keys, n, TOP + 1)[TOP + 1][1]):
        node, a, b, c = merged(up(ids, bit), n0, n1, pw)
        bits.append(np.full(len(node), bit))
        nodes.append(node)
        sums.append((a, b, c))
    return pa.table({"bit": np.concatenate(bits).astype(np.int32), "node": np.concatenate(nodes), "n0": np.concatenate([s[0] for s in sums]), "n1": np.concatenate([s[1] for s in sums]), "pw": np.concatenate([s[2] for s in sums])})


def top_tree(rows: pa.Table) -> list:
    """[bit][depth] = (ids, seen, share of the node's own estimate, KT estimate of 1), for depths 0 to TOP."""
    out = []
    for bit in range(8):
        own, by_depth = rows.filter(pa.compute.equal(rows["bit"], bit)), [None] * (TOP + 1)
        ids, n0, n1, below = merged(*(own[c].to_numpy() for c in ("node", "n0", "n1", "pw")))
        for depth in range(TOP, -1, -1):
            pe = log_kt(n0, n1)
            pw = np.logaddexp(pe, below) - np.log(2)
            by_depth[depth] = (ids, n0 + n1 > 0, np.exp(pe - np.log(2) - pw), (n1 + 0.5) / (n0 + n1 + 1.0))
            ids, n0, n1, below = merged(up(ids, bit), n0, n1, pw)
        out.append(by_depth)
    return out


def log10_probability(keys: np.ndarray, counts: np.ndarray, top: list) -> np.ndarray:
    """log10 probability of each key's last byte after the bytes before it."""
    total, tree = np.zeros(len(keys)), levels(keys, counts, TOP + 1)
    for bit in range(8):
        q, below = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        ids = None
        for depth in range(DEPTH, -1, -1):
            if depth > TOP:
                rows, bits = tree[depth]
                of, ids, n0, n1, pe, pw = bits[bit]
                seen, share, kt = n0 + n1 > 0, np.exp(pe - np.log(2) - pw), (n1 + 0.5) / (n0 + n1 + 1.0)
                if depth == DEPTH:
                    share = np.ones(len(ids))
                at, node = of[rows], ids
            else:
                node = up(node, bit)
                found, seen, share, kt = top[bit][depth]
                # node is an array over the deepest nodes of this shard; at maps keys to it
                spot = np.searchsorted(found, node)
                seen, share, kt = seen[spot], share[spot], kt[spot]
            s, w, k = seen[at], share[at], kt[at]
            q = np.where(s, np.where(below, w * k + (1 - w) * q, k), q)
            below = below | s
        one = ((keys >> (7 - bit)) & 1).astype(bool)
        total += np.log10(np.where(one, q, 1 - q))
    return total


def byte_answers(top):
    def run(table: pa.Table) -> pa.Table:
        keys, n, own = shard_counts(table)
        logs = log10_probability(keys, n, top.value)
        blobs = [pack(logs[np.searchsorted(keys, k)]) for k in own]
        return pa.table([table["chunk"], table["kind"], table["keys"], pa.array(blobs, pa.binary())], ["chunk", "kind", "keys", "values"])

    return run


def word_answers(table: pa.Table) -> pa.Table:
    total, own = Counter(), []
    for words, counts in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True):
        own.append(words.split(b" "))
        for w, n in zip(own[-1], unpack(counts, np.int64).tolist(), strict=True):
            total[w] += n
    blobs = [pack(np.array([total[w] for w in ws], np.int64)) for ws in own]
    return pa.table([table["chunk"], table["kind"], table["keys"], pa.array(blobs, pa.binary())], ["chunk", "kind", "keys", "values"])


def vocabulary(table: pa.Table) -> pa.Table:
    """A shard's training tokens and distinct training words."""
    total = Counter()
    for words, counts in zip(table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True):
        for w, n in zip(words.split(b" "), unpack(counts, np.int64).tolist(), strict=True):
            total[w] += n
    return pa.table({"tokens": [sum(total.values())], "types": [sum(n > 0 for n in total.values())]})


def rate(ends: int, tokens: int, types: int):
    """A chunk's documents with the answers for its strings and words, to scores."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = [stream(t) for t in texts_of(docs["text"])]
        keys, logs, count = [np.empty(0, np.int64)], [np.empty(0)], {}
        for kind, k, v in zip(answers["kind"].to_pylist(), answers["keys"].to_pylist(), answers["values"].to_pylist(), strict=True):
            if kind == "bytes":
                keys.append(unpack(k, np.int64, True))
                logs.append(unpack(v, np.float64))
            else:
                count.update(zip(k.split(b" "), unpack(v, np.int64).tolist(), strict=True))
        key, log = np.concatenate(keys), np.concatenate(logs)
        order = np.argsort(key)
        key, log = key[order], log[order]
        score = np.zeros(len(texts))
        for g, doc in blocks(texts):
            score += np.bincount(doc, log[np.searchsorted(key, g)], len(texts))
        n = tokens + ends
        low = n + 0.5 * (types + bool(ends) + 1)
        base, n_tokens, n_known = [], [], []
        logs_of = {w: (np.log10((c + 0.5) / low), c > 0) for w, c in count.items()}
        end = (np.log10((ends + 0.5) / low), ends > 0)
        for t in texts:
            got = [logs_of[w] for w in t.split()]
            got.append(end)
            n_tokens.append(len(got))
            n_known.append(sum(x[1] for x in got))
            base.append(float(sum(x[0] for x in got)))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        return pa.table([docs["doc_id"], docs["held_out"], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([n] * len(texts), pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(size), pa.array(-score * LN10 / np.log(2) / size)],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    return run


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_remainder: int = 1) -> DataFrame:
    """Score every text under the model of all texts whose crc32(doc_id as text) mod 5 is not held_remainder.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram words with add-half
    smoothing), score (log10 probability under context-tree weighting), n_bytes, bits_per_byte.
    A null text is empty: one end token, one end byte.  A null doc_id trains.  Repeated rows count and
    are scored once each.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    chunks = shards = chunk_count(docs, text)
    id_type = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held(doc_id, held_remainder).alias("held_out"), chunk_of(doc_id, text, chunks).alias("chunk"))
    ends = own.where(~F.col("held_out")).count()
    sent = keep(own.groupBy("chunk").applyInArrow(gather(shards), "chunk int, kind string, shard long, keys binary, counts binary"))
    strings_, words = sent.where("kind = 'bytes'"), sent.where("kind = 'words'")
    top = strings_.groupBy("shard").applyInArrow(tops, "bit int, node long, n0 long, n1 long, pw double").groupBy("bit", "node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "pw")))
    tree = spark.sparkContext.broadcast(top_tree(top.toArrow()))
    tokens, types = words.groupBy("shard").applyInArrow(vocabulary, "tokens long, types long").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    reply = "chunk int, kind string, keys binary, values binary"
    answers = keep(strings_.groupBy("shard").applyInArrow(byte_answers(tree), reply).unionByName(words.groupBy("shard").applyInArrow(word_answers, reply)))
    out = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(rate(ends, tokens, types), out)
