"""Substring dedup by repeated-phrase automata.

A window is WINDOW consecutive words of one document.  Each word that lies in a window whose word sequence also
starts in a document with a smaller doc_id goes.

1. Recurring passages are confirmed.  Among the PHRASE-word phrases that start in each stretch of WINDOW - PHRASE + 1
   words, the one with the least hash is an anchor (winnowing), so equal windows hold equal anchors.  Chunks of
   documents send their distinct anchors to shards and learn which of them two or more documents hold; then the
   96-bit hashes of the windows around those go the same way.  The smallest document of a window that recurs
   owns it, and its chunk learns which chunks hold it besides.
2. Automata are compiled, a shard for each chunk.  The owner's recurring windows, run together to passages, go as
   words to the chunks that hold them.  There, of every passage each phrase of PHRASE words at a multiple of
   WINDOW - PHRASE + 1 becomes a pattern, so that every window of a passage has one whole; PATTERNS go to each
   Aho-Corasick automaton.
3. All documents of the chunk are streamed through its automata.  From each occurrence the equal words of document
   and passage are followed both ways, and runs of a window or more go if the owner is smaller.

Only what the automata locate is removed, and words decide, not hashes.  A chunk has the passages that its own
documents hold, so a document is streamed once, however many passages the corpus has.  What is sent is distinct per
chunk: a passage that a third of all documents hold goes to each chunk once.  Nothing is capped.
"""

from __future__ import annotations

import hashlib
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Vocabulary, chunk_count, chunk_of, discard, hashed_words, integer_id, keep, mixed, numbered, pack, rolled, texts_of, unpack

WINDOW, PHRASE, PATTERNS, BLOCK = 50, 20, 20_000, 2 << 20
#: A word is DIGITS symbols of BASE in an automaton, whose nodes then have few children; OTHER stands in words of no phrase.
BASE, DIGITS, OTHER = 128, 3, 1000


def in_blocks(docs: pa.Table):
    """(ids, words' hashes, begins, joined texts, places of the words in them) of the documents that have an id, about BLOCK
    bytes of text at a time."""
    docs = docs.filter(pa.compute.is_valid(docs["doc_id"]))
    texts, ids = texts_of(docs["text"]), docs["doc_id"].to_numpy().astype(np.int64)
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK or i == len(texts) - 1:
            h, at, *places = hashed_words(texts[first : i + 1])
            yield ids[first : i + 1], h, at, b"\n".join(texts[first : i + 1]), *places
            first, size = i + 1, 0


def phrases(h: np.ndarray, width: int = PHRASE) -> np.ndarray:
    return mixed(rolled(h, width, 0x9E3779B97F4A7C15))


def windows(h: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """(windows, 2) hashes, of 64 and of 32 bits for each window."""
    return np.stack((mixed(rolled(h, width, 0xC2B2AE3D27D4EB4F)), mixed(rolled(h, width, 0xFF51AFD7ED558CCD)) >> np.uint64(32)), 1)


def fits(at: np.ndarray, width: int) -> np.ndarray:
    """Which places have width words of their own text ahead, their own included."""
    return np.arange(at[-1]) + width <= np.repeat(at[1:], np.diff(at))


def sliding(f, a: np.ndarray, n: int) -> np.ndarray:
    """f over each n neighbours, by doubling."""
    if len(a) < n:
        return a[:0]
    out, m = a, 1
    while 2 * m <= n:
        out, m = f(out[: len(out) - m], out[m:]), 2 * m
    rest = n - m
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(p: np.ndarray, at: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Starts of the phrases that are the least of some stretch within a text."""
    stretch = window - phrase + 1
    low = sliding(np.minimum, p, stretch)
    low = np.where(fits(at, window)[: len(low)], low, np.uint64(0))
    # no stretch's least exceeds a phrase in it, so a phrase is chosen if it is the greatest of them
    edge = np.zeros(stretch - 1, np.uint64)
    top = sliding(np.maximum, np.concatenate((edge, low, edge)), stretch)[: len(p)]
    return np.flatnonzero((top == p[: len(top)]) & (top > 0))


def in_order(keys: np.ndarray) -> np.ndarray:
    """What sorts keys, or rows of keys."""
    if keys.ndim == 1:
        return np.argsort(keys, kind="stable")
    order = np.argsort(keys[:, 0], kind="stable")
    a, b = keys[order, 0], keys[order, 1]
    if ((a[1:] == a[:-1]) & (b[1:] < b[:-1])).any():  # equal first halves are nearly always equal keys
        order = np.lexsort((keys[:, 1], keys[:, 0]))
    return order


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where new keys begin among sorted ones."""
    if not len(keys):
        return np.empty(0, np.int64)
    differ = (keys[1:] != keys[:-1]).any(1) if keys.ndim == 2 else keys[1:] != keys[:-1]
    return np.flatnonzero(np.concatenate(([True], differ)))


def least(keys: np.ndarray, docs: np.ndarray, last: np.ndarray | None = None):
    """Distinct keys in order, with the least and largest doc of each."""
    if not len(keys):
        return keys, docs, docs
    order = in_order(keys)
    keys, docs, last = keys[order], docs[order], (docs if last is None else last)[order]
    first = firsts(keys)
    return keys[first], np.minimum.reduceat(docs, first), np.maximum.reduceat(last, first)


def found_at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted row stands among sorted rows of keys; -1 where it doesn't."""
    at = np.searchsorted(keys[:, 0], wanted[:, 0])
    while True:  # first halves are distinct but for rare collisions
        here = at < len(keys)
        here[here] = keys[at[here], 0] == wanted[here, 0]
        less = here.copy()
        less[here] = keys[at[here], 1] < wanted[here, 1]
        if not less.any():
            break
        at[less] += 1
    here[here] = keys[at[here], 1] == wanted[here, 1]
    return np.where(here, at, -1)


SENT = pa.schema([("chunk", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("low", pa.binary()), ("more", pa.binary())])
SENT_ROW = "chunk int, shard long, keys binary, low binary, more binary"
OWNED = pa.schema([("chunk", pa.int32()), ("keys", pa.binary()), ("low", pa.binary()), ("many", pa.binary()), ("chunks", pa.binary())])
OWNED_ROW = "chunk int, keys binary, low binary, many binary, chunks binary"
PASSAGES = pa.schema([("chunk", pa.int32()), ("owners", pa.binary()), ("texts", pa.binary())])
PASSAGES_ROW = "chunk int, owners binary, texts binary"


def packed(keys: np.ndarray) -> bytes:
    """Keys in order; of pairs the first ones as differences."""
    return pack(keys, True) if keys.ndim == 1 else pack(np.concatenate((np.diff(keys[:, 0], prepend=np.uint64(0)), keys[:, 1])))


def keys_of(blob: bytes, pairs: bool) -> np.ndarray:
    if not pairs:
        return unpack(blob, np.uint64, True)
    both = unpack(blob, np.uint64).reshape(2, -1)
    return np.stack((np.cumsum(both[0], dtype=np.uint64), both[1]), 1)


def by_shard(chunk: int, keys: np.ndarray, low: np.ndarray, high: np.ndarray, shards: int) -> pa.Table:
    lead = keys[:, 0] if keys.ndim == 2 else keys
    at = ((lead >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    rows = [{"chunk": chunk, "shard": int(at[i[0]]), "keys": packed(keys[i]), "low": pack(low[i]), "more": pack(high[i] - low[i])} for i in np.split(order, firsts(at[order])[1:]) if len(i)]
    return pa.Table.from_pylist(rows, schema=SENT)


def send_anchors(docs: pa.Table, shards: int, window: int, phrase: int) -> pa.Table:
    """A chunk's distinct anchors with the least and largest doc_id that holds them."""
    keys, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for ids, h, at, *_ in in_blocks(docs):
        p = phrases(h, phrase)
        spots = anchors(p, at, window, phrase)
        keys.append(p[spots])
        of.append(ids[np.searchsorted(at, spots, "right") - 1])
    return by_shard(docs["chunk"][0].as_py(), *least(np.concatenate(keys), np.concatenate(of)), shards)


def recurring(table: pa.Table) -> pa.Table:
    """For each chunk its anchors that two or more documents hold."""
    own = [keys_of(b, False) for b in table["keys"].to_pylist()]
    low, more = (np.concatenate([unpack(b, np.int64) for b in table[c].to_pylist()]) for c in ("low", "more"))
    keys, least_of, last = least(np.concatenate(own), low, low + more)
    keys = keys[least_of != last]
    rows = [{"chunk": chunk, "keys": packed(hit)} for chunk, k in zip(table["chunk"].to_pylist(), own, strict=True) if len(hit := k[np.isin(k, keys, assume_unique=True)])]
    return pa.Table.from_pylist(rows, schema=pa.schema([("chunk", pa.int32()), ("keys", pa.binary())]))


def covered(starts: np.ndarray, n: int, before: int, after: int) -> np.ndarray:
    """Which of n places lie within [start - before, start + after] of some start."""
    up = np.bincount(np.maximum(starts - before, 0), minlength=n + 1)
    return np.cumsum(up - np.bincount(np.minimum(starts + after + 1, n), minlength=n + 1))[:n] > 0


def send_windows(docs: pa.Table, found: pa.Table, shards: int, window: int, phrase: int) -> pa.Table:
    """A chunk's distinct windows around recurring anchors, with the least and largest doc_id that holds them."""
    if not docs.num_rows or not found.num_rows:
        return SENT.empty_table()
    known = np.sort(np.concatenate([keys_of(b, False) for b in found["keys"].to_pylist()]))
    keys, of = [np.empty((0, 2), np.uint64)], [np.empty(0, np.int64)]
    for ids, h, at, *_ in in_blocks(docs):
        p = phrases(h, phrase)
        spots = anchors(p, at, window, phrase)
        spots = spots[known[np.minimum(np.searchsorted(known, p[spots]), len(known) - 1)] == p[spots]]
        near = np.flatnonzero(covered(spots, len(h), window - phrase, 0) & fits(at, window))
        if len(near):
            keys.append(windows(h, window)[near])
            of.append(ids[np.searchsorted(at, near, "right") - 1])
    return by_shard(docs["chunk"][0].as_py(), *least(np.concatenate(keys), np.concatenate(of)), shards)


def owned(table: pa.Table) -> pa.Table:
    """For each chunk the recurring windows whose least document it has, and the chunks where larger documents hold them."""
    own = [keys_of(b, True) for b in table["keys"].to_pylist()]
    low, more = (np.concatenate([unpack(b, np.int64) for b in table[c].to_pylist()]) for c in ("low", "more"))
    keys, chunk = np.concatenate(own), np.repeat(table["chunk"].to_numpy(), [len(k) for k in own])
    order = in_order(keys)
    keys, chunk, low, high = keys[order], chunk[order], low[order], (low + more)[order]
    first = firsts(keys)
    size = np.diff(first, append=len(keys))
    smallest = np.repeat(np.minimum.reduceat(low, first), size)
    owner = np.repeat(chunk[low == smallest], size)  # rows of a doc_id are all in one chunk
    wanted = high > smallest
    keys, chunk, low, owner = keys[wanted], chunk[wanted], smallest[wanted], owner[wanted]
    order = np.argsort(owner, kind="stable")
    rows = []
    for i in np.split(order, firsts(owner[order])[1:]):
        if len(i):
            one = firsts(keys[i])
            rows.append({"chunk": int(owner[i[0]]), "keys": packed(keys[i][one]), "low": pack(low[i][one]), "many": pack(np.diff(one, append=len(i)).astype(np.int32)), "chunks": pack(chunk[i].astype(np.int32))})
    return pa.Table.from_pylist(rows, schema=OWNED)


def send_passages(docs: pa.Table, found: pa.Table, window: int) -> pa.Table:
    """The passages that a chunk's documents own, for each chunk that holds some of them."""
    if not docs.num_rows or not found.num_rows:
        return PASSAGES.empty_table()
    keys = np.concatenate([keys_of(b, True) for b in found["keys"].to_pylist()])
    low, many, chunks = (np.concatenate([unpack(b, kind) for b in found[c].to_pylist()]) for c, kind in (("low", np.int64), ("many", np.int32), ("chunks", np.int32)))
    begin, order = np.cumsum(many) - many, in_order(keys)
    keys, low, many, begin = keys[order], low[order], many[order], begin[order]
    out: dict[int, set] = {}
    for ids, h, at, joined, start, stop in in_blocks(docs):
        w = windows(h, window)
        place = np.flatnonzero(fits(at, window)[: len(w)])
        row = found_at(keys, w[place])
        doc = np.searchsorted(at, place, "right") - 1
        hit = row >= 0
        hit[hit] = low[row[hit]] == ids[doc[hit]]
        place, row, doc = place[hit], row[hit], doc[hit]
        if not len(place):
            continue
        n = many[row]
        target = chunks[np.repeat(begin[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        place, doc = np.repeat(place, n), np.repeat(doc, n)
        order = np.lexsort((place, target))
        target, place, doc = target[order], place[order], doc[order]
        # windows whose words touch make one passage
        new = np.flatnonzero(np.concatenate(([True], (np.diff(target) != 0) | (np.diff(doc) != 0) | (np.diff(place) > window))))
        made: dict[tuple[int, int], bytes] = {}
        for t, i, a, b in zip(target[new].tolist(), ids[doc[new]].tolist(), place[new].tolist(), (np.append(place[new[1:] - 1], place[-1]) + window).tolist(), strict=True):
            if (a, b) not in made:
                made[a, b] = b" ".join(joined[start[a] : stop[b - 1]].split())
            out.setdefault(t, set()).add((i, made[a, b]))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    rows = [{"chunk": t, "owners": pack(np.array([i for i, _ in some], np.int64)), "texts": squeeze(b"\n".join([x for _, x in some]))} for t, some in ((t, sorted(s)) for t, s in out.items())]
    return pa.Table.from_pylist(rows, schema=PASSAGES)


class Automata:
    """Aho-Corasick automata of phrases, PATTERNS of them in each, compiled one after the other."""

    def __init__(self, patterns: list[np.ndarray], words: int):
        """patterns: phrases of one length, as numbers below `words`."""
        self.patterns, self.words = patterns, words

    def hits(self, numbers: np.ndarray, at: np.ndarray, rows: list[int]):
        """(row, place in its text, pattern) of every occurrence in the texts of these rows."""
        for first in range(0, len(self.patterns), PATTERNS):
            some = np.stack(self.patterns[first : first + PATTERNS])
            used = np.unique(some)
            code = np.full((self.words, DIGITS), OTHER, "<u4")
            code[used] = np.arange(len(used))[:, None] // BASE ** np.arange(DIGITS - 1, -1, -1) % BASE
            machine, width = ahocorasick.Automaton(ahocorasick.STORE_INTS), some.shape[1]
            for n, p in enumerate(code[some], first):
                machine.add_word(symbols(p), n)
            machine.make_automaton()
            for row in rows:
                for end, n in machine.iter(symbols(code[numbers[at[row] : at[row + 1]]])):
                    if (end + 1) % DIGITS == 0:  # else it begins within a word
                        yield row, (end + 1) // DIGITS - width, n


def symbols(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


def equal_runs(a: np.ndarray, b: np.ndarray, ahead: int, length: int):
    """(start, end) in a of each run of `length` or more words that equal those of b, b's first word standing at a[ahead]."""
    at = max(0, ahead)
    n = min(len(a) - at, len(b) + ahead - at)
    edges = np.concatenate(([-1], np.flatnonzero(a[at : at + n] != b[at - ahead : at - ahead + n]), [n]))
    for i in np.flatnonzero(np.diff(edges) > length).tolist():
        yield at + int(edges[i]) + 1, at + int(edges[i + 1])


def gone_words(docs: pa.Table, sent: pa.Table, window: int, phrase: int) -> dict[int, np.ndarray]:
    """By row, which words lie in a window that a passage of a smaller document has, as the automata find it."""
    if not sent.num_rows:
        return {}
    unpacked = zstandard.ZstdDecompressor().decompress
    owners = np.concatenate([unpack(b, np.int64) for b in sent["owners"].to_pylist()]).tolist()
    words, ids = Vocabulary(), docs["doc_id"].to_pylist()
    bodies, begins = numbered([t for b in sent["texts"].to_pylist() for t in unpacked(b).split(b"\n")], words)
    places: dict[bytes, list[tuple[int, int]]] = {}
    patterns: list[np.ndarray] = []
    for q, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
        for o in range(0, b - a - phrase + 1, window - phrase + 1):
            some = bodies[a + o : a + o + phrase]
            own = places.setdefault(some.tobytes(), [])
            if not own:
                patterns.append(some)
            own.append((q, o))
    by_number = list(places.values())
    numbers, at = numbered(texts_of(docs["text"]), words)
    rows = [r for r in range(docs.num_rows) if ids[r] is not None and at[r + 1] - at[r] >= window]
    dead: dict[int, np.ndarray] = {}  # by row, windows that a smaller document holds
    seen: dict[int, set[tuple[int, int]]] = {}
    for row, x, pattern in Automata(patterns, len(words)).hits(numbers, at, rows):
        own = numbers[at[row] : at[row + 1]]
        if row not in dead:
            dead[row], seen[row] = np.zeros(len(own) - window + 1, bool), set()
        around = dead[row][max(0, x - window + phrase) : x + 1]
        for q, o in by_number[pattern]:
            if around.all():
                break
            if owners[q] < ids[row] and (q, x - o) not in seen[row]:
                seen[row].add((q, x - o))
                for a, b in equal_runs(own, bodies[begins[q] : begins[q + 1]], x - o, window):
                    dead[row][a : b - window + 1] = True
    return {row: covered(np.flatnonzero(d), len(d) + window - 1, 0, window - 1) for row, d in dead.items() if d.any()}


def drop(docs: pa.Table, sent: pa.Table, window: int, phrase: int) -> pa.Table:
    """The chunk's documents without the words that are gone."""
    gone = gone_words(docs, sent, window, phrase)
    kept, n_words, n_removed = [], [], []
    for row, text in enumerate(texts_of(docs["text"])):
        own, out = text.split(), gone.get(row)
        n_words.append(len(own))
        n_removed.append(0 if out is None else int(out.sum()))
        kept.append(b" ".join(own if out is None else [w for w, x in zip(own, out.tolist(), strict=True) if not x]))
    return pa.table([docs["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in kept])], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def drop_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Every document without the passages that an earlier document holds.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256.  doc_id is of an
    integer type; others raise TypeError.  Null and empty texts, and those without words, are kept as empty.  A text of
    fewer words than a window loses nothing.  A document without an id loses nothing and takes nothing from others.
    Rows with the same doc_id are one document to others, and each is returned; they take nothing from each other.
    Other columns are ignored.  An empty table gives no rows.
    """
    integer_id(docs, doc_id)
    chunks = chunk_count(docs, text)
    id_type = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), chunk_of(doc_id, text, chunks).alias("chunk"))
    size = {"shards": chunks, "window": window, "phrase": phrase}
    first = keep(own.groupBy("chunk").applyInArrow(named(send_anchors, **size), SENT_ROW))
    known = first.groupBy("shard").applyInArrow(named(recurring), "chunk int, keys binary")
    second = keep(own.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(paired(send_windows, **size), SENT_ROW))
    discard(first)
    confirmed = second.groupBy("shard").applyInArrow(named(owned), OWNED_ROW)
    passages = keep(own.groupBy("chunk").cogroup(confirmed.groupBy("chunk")).applyInArrow(paired(send_passages, window=window), PASSAGES_ROW))
    discard(second)
    return own.groupBy("chunk").cogroup(passages.groupBy("chunk")).applyInArrow(paired(drop, window=window, phrase=phrase), f"doc_id {id_type}, n_words long, n_removed long, kept_text string, kept_sha256 string")


def named(f, **options):
    call = partial(f, **options)
    return lambda table: call(table)


def paired(f, **options):
    call = partial(f, **options)
    return lambda left, right: call(left, right)
