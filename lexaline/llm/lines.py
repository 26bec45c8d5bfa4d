"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without white space at its ends, A-Z lower-cased.  A key of at least MIN_CHARS
code points that at least MIN_DOCS documents hold loses all its lines but those of the largest doc_id.

The index can be taken back: documents come in with insert() and go out with delete(), and the
decisions are always those of the documents then in it.  Its state, in the shared folder:

* postings, by chunk of documents: the (key, doc_id) pairs of that chunk.
* references, by shard of keys: (key, chunk, documents that hold it, largest doc_id of them), exact, in one or more segments.
* filters, by shard: a cuckoo filter of the keys that the references hold.

An update asks the filters first.  Keys that a shard's filter denies are new: they are written as one more segment, and
the shard's references are neither read nor written.  Only shards where the filter admits some key, or has no room,
are looked up in their exact table and written anew, and only chunks with documents of the update get new postings.
Filters are small: two bytes for a key, beside about 24 in its references.

A key that a third of all documents hold is one row per chunk in its shard.  Each update writes new files beside
the old ones, so a failed update leaves the index as it was; every COMPACT updates all is written together.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_count, chunk_of, integer_id, keep, pack, texts_of, unpack, work_dir
from .cuckoo import CuckooFilter

MIN_CHARS, MIN_DOCS, COMPACT = 20, 3, 8
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
KEY = np.dtype([("high", "<u8"), ("low", "<u8")])
REF = np.dtype([("high", "<u8"), ("low", "<u8"), ("chunk", "<i4"), ("docs", "<i4"), ("last", "<i8")])


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The 16-byte key of each line; None for lines that are too short to be judged."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE).lower()
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def pairs(texts: list[bytes], ids: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, doc_id) in order of both."""
    keys, docs = [], []
    for text, i in zip(texts, ids.tolist(), strict=True):
        own = set(line_keys(text, min_chars))
        own.discard(None)
        keys.extend(own)
        docs.extend([i] * len(own))
    k, d = np.frombuffer(b"".join(keys), KEY), np.array(docs, np.int64)
    order = np.lexsort((d, k["low"], k["high"]))
    k, d = k[order], d[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return k[fresh], d[fresh]


def summed(k: np.ndarray, d: np.ndarray, chunk: int) -> np.ndarray:
    """References of one chunk from its ordered pairs."""
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    out = np.empty(len(first), REF)
    out["high"], out["low"], out["chunk"] = k["high"][first], k["low"][first], chunk
    out["docs"] = np.diff(first, append=len(k))
    out["last"] = np.maximum.reduceat(d, first) if len(first) else 0
    return out


def shard_of(k: np.ndarray, shards: int) -> np.ndarray:
    return (k["high"] % np.uint64(shards)).astype(np.int64)


def blob(a: np.ndarray) -> bytes:
    return pack(a.view(np.uint8).reshape(len(a), -1) if len(a) else np.empty((0, a.dtype.itemsize), np.uint8)) if len(a) else b""


def array(b: bytes | None, dtype) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.dtype(f"V{dtype.itemsize}"))).view(dtype) if b else np.empty(0, dtype)


PAIR = np.dtype([("high", "<u8"), ("low", "<u8"), ("doc", "<i8")])
CHANGE = "chunk int, shard long, kind string, rows binary"


def change(docs: pa.Table, old: pa.Table, shards: int, min_chars: int, remove: bool) -> pa.Table:
    """A chunk's new postings, and the new references of the keys that the documents touch, by shard.

    The two kinds of row: (chunk, null, 'postings', pairs), (chunk, shard, 'references', references); a
    reference with no documents takes one away.
    """
    chunk = (docs if docs.num_rows else old)["chunk"][0].as_py()
    k, d = pairs(texts_of(docs["text"]), docs["doc_id"].to_numpy().astype(np.int64), min_chars)
    was = array(old["rows"][0].as_py() if old.num_rows else None, PAIR)
    before = np.empty(len(was), KEY)
    before["high"], before["low"] = was["high"], was["low"]
    gone = np.unique(docs["doc_id"].to_numpy().astype(np.int64))
    if remove:
        k = np.unique(before[np.isin(was["doc"], gone)])
    touched = np.unique(k)
    stay = ~np.isin(was["doc"], gone)  # an inserted document replaces itself
    if not remove:
        touched = np.unique(np.concatenate((touched, before[~stay])))
    now_k, now_d = before[stay], was["doc"][stay]
    if not remove:
        now_k, now_d = np.concatenate((now_k, k)), np.concatenate((now_d, d))
        order = np.lexsort((now_d, now_k["low"], now_k["high"]))
        now_k, now_d = now_k[order], now_d[order]
    now = np.empty(len(now_k), PAIR)
    now["high"], now["low"], now["doc"] = now_k["high"], now_k["low"], now_d
    refs = summed(now_k, now_d, chunk)
    ref_keys = np.empty(len(refs), KEY)
    ref_keys["high"], ref_keys["low"] = refs["high"], refs["low"]
    refs = refs[np.isin(ref_keys, touched)] if len(was) else refs
    lost = touched[~np.isin(touched, ref_keys)]
    if len(lost):
        empty = np.zeros(len(lost), REF)
        empty["high"], empty["low"], empty["chunk"] = lost["high"], lost["low"], chunk
        refs = np.concatenate((refs, empty))
    at = shard_of(refs, shards)
    rows = [{"chunk": chunk, "shard": None, "kind": "postings", "rows": blob(now)}]
    rows += [{"chunk": chunk, "shard": int(s), "kind": "references", "rows": blob(refs[at == s])} for s in np.unique(at)]
    return pa.Table.from_pylist(rows, schema=pa.schema([("chunk", pa.int32()), ("shard", pa.int64()), ("kind", pa.string()), ("rows", pa.binary())]))


TOLD = pa.schema([("shard", pa.int64()), ("filter", pa.binary()), ("fresh", pa.binary()), ("known", pa.binary()), ("look", pa.bool_())])
TOLD_ROW = "shard long, filter binary, fresh binary, known binary, look boolean"


def ask(new: pa.Table, old: pa.Table) -> pa.Table:
    """A shard's changed references, told apart by its filter: those of new keys, which the filter then has, and those to be looked up."""
    if not new.num_rows:
        return TOLD.empty_table()
    rows = np.concatenate([np.empty(0, REF), *(array(b, REF) for b in new["rows"].to_pylist())])
    held = CuckooFilter.from_bytes(old["filter"][0].as_py()) if old.num_rows else None
    maybe = held.contains(rows["low"]) if held else np.zeros(len(rows), bool)
    fresh, known = rows[~maybe & (rows["docs"] > 0)], rows[maybe]
    keys = np.unique(fresh["low"])
    if held is None:
        held = CuckooFilter.of(keys)
    elif not held.insert(keys):
        held = None
    one = {"shard": new["shard"][0].as_py(), "filter": held.to_bytes() if held else None, "fresh": blob(fresh), "known": blob(known), "look": held is None or len(known) > 0}
    return pa.Table.from_pylist([one], schema=TOLD)


def revise(told: pa.Table, old: pa.Table) -> pa.Table:
    """A shard's filter and exact table after a change that needs the table."""
    if not told.num_rows:
        return pa.table({"shard": pa.array([], pa.int64()), "filter": pa.array([], pa.binary()), "rows": pa.array([], pa.binary())})
    one = told.to_pylist()[0]
    table = np.concatenate([np.empty(0, REF), *(array(b, REF) for b in old["rows"].to_pylist())])
    fresh, known = array(one["fresh"], REF), array(one["known"], REF)
    before = np.unique(table["low"])
    name = np.dtype([("high", "<u8"), ("low", "<u8"), ("chunk", "<i4")])
    ids = lambda a: np.ascontiguousarray(a[["high", "low", "chunk"]]).astype(name)
    table = np.concatenate((table[~np.isin(ids(table), ids(known))], known[known["docs"] > 0]))
    held = CuckooFilter.from_bytes(one["filter"]) if one["filter"] is not None else None
    if held:
        held.delete(np.setdiff1d(before, table["low"]))
    table = np.concatenate((table, fresh))
    if held is None or not held.insert(np.setdiff1d(np.setdiff1d(known["low"][known["docs"] > 0], before), fresh["low"])):
        held = CuckooFilter.of(np.unique(table["low"]))
    return pa.table({"shard": pa.array([one["shard"]], pa.int64()), "filter": pa.array([held.to_bytes()], pa.binary()), "rows": pa.array([blob(table)], pa.binary())})


def decide(table: pa.Table, min_docs: int) -> pa.Table:
    """For each chunk the keys that lose lines in it, with the doc_id that keeps them."""
    refs = np.concatenate([np.empty(0, REF), *(array(b, REF) for b in table["rows"].to_pylist())])
    refs = refs[np.lexsort((refs["low"], refs["high"]))]
    if not len(refs):
        return pa.table({"chunk": pa.array([], pa.int32()), "rows": pa.array([], pa.binary())})
    fresh = np.concatenate(([True], (refs["high"][1:] != refs["high"][:-1]) | (refs["low"][1:] != refs["low"][:-1])))
    first = np.flatnonzero(fresh)
    of = np.cumsum(fresh) - 1
    n, last = np.add.reduceat(refs["docs"].astype(np.int64), first), np.maximum.reduceat(refs["last"], first)
    hit = n[of] >= min_docs
    out = np.empty(int(hit.sum()), PAIR)
    out["high"], out["low"], out["doc"] = refs["high"][hit], refs["low"][hit], last[of][hit]
    chunk = refs["chunk"][hit]
    order = np.argsort(chunk, kind="stable")
    out, chunk = out[order], chunk[order]
    cut = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))) if len(chunk) else []
    blobs = [blob(x) for x in np.split(out, cut[1:])] if len(cut) else []
    return pa.table({"chunk": pa.array(chunk[cut] if len(cut) else [], pa.int32()), "rows": pa.array(blobs, pa.binary())})


def rewrite(docs: pa.Table, decisions: pa.Table, min_chars: int) -> pa.Table:
    """The chunk's documents without the lines that they lose."""
    drop = {}
    for b in decisions["rows"].to_pylist():
        a = array(b, PAIR)
        raw = np.ascontiguousarray(a[["high", "low"]]).astype(KEY).tobytes()
        drop.update(zip((raw[i : i + 16] for i in range(0, len(raw), 16)), a["doc"].tolist(), strict=True))
    texts, n_lines, n_dropped = [], [], []
    for i, text in zip(docs["doc_id"].to_pylist(), texts_of(docs["text"]), strict=True):
        lines = text.split(b"\n")
        keys = line_keys(text, min_chars) if drop else [None] * len(lines)
        left = [x for x, k in zip(lines, keys, strict=True) if i is None or drop.get(k, i) == i]
        texts.append(b"\n".join(left))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(left))
    return pa.table([docs["doc_id"], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], ["doc_id", "n_lines", "n_dropped", "kept_text", "kept_sha256"])


def rewrite_rows(docs: pa.Table, decisions: pa.Table, min_chars: int, text: str, length: str | None) -> pa.Table:
    """The chunk's rows with the text that is left, and its code points in the column `length`."""
    left = rewrite(docs, decisions, min_chars)["kept_text"]
    out = docs.drop_columns(["chunk", "doc_id", "text"])
    out = out.set_column(out.column_names.index(text), text, pa.compute.if_else(pa.compute.is_null(docs["text"]), docs["text"], left))
    return out.set_column(out.column_names.index(length), length, pa.compute.utf8_length(out[text]).cast(pa.int64())) if length else out


class LineIndex:
    """An index of the lines of documents that can grow and shrink."""

    def __init__(self, spark, chunks: int, shards: int, folder: str | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.chunks, self.shards, self.min_chars, self.min_docs = spark, chunks, shards, min_chars, min_docs
        self.folder, self.generation = folder or work_dir(spark), 0
        self.postings = spark.createDataFrame([], "chunk int, rows binary")
        self.references = spark.createDataFrame([], "shard long, rows binary")
        self.filters = spark.createDataFrame([], "shard long, filter binary")
        self.looked_up = 0  # shards whose exact table the last update read

    @classmethod
    def for_table(cls, docs: DataFrame, text: str, min_chars: int, min_docs: int) -> LineIndex:
        """An empty index with as many chunks and shards as the documents' size asks for."""
        n = chunk_count(docs, text)
        return cls(docs.sparkSession, n, n, min_chars=min_chars, min_docs=min_docs)

    def _chunked(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id"), F.col("text"), chunk_of("doc_id", "text", self.chunks).alias("chunk"))

    def _apply(self, docs: DataFrame, remove: bool) -> None:
        own = self._chunked(docs.where("doc_id is not null"))
        make = partial(change, shards=self.shards, min_chars=self.min_chars, remove=remove)
        self.generation += 1
        at = f"{self.folder}/{self.generation}"
        old = self.postings.join(own.select("chunk").distinct(), "chunk", "left_semi") if self.generation > 1 else self.postings
        changed = keep(own.groupBy("chunk").cogroup(old.groupBy("chunk")).applyInArrow(lambda a, b: make(a, b), CHANGE), f"{at}/changes")
        postings = changed.where("kind = 'postings'").select("chunk", "rows")
        told = keep(changed.where("kind = 'references'").groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(ask, TOLD_ROW), f"{at}/told")
        look, plain = told.where("look"), told.where("not look")
        new = [(plain.select("shard", F.col("fresh").alias("rows")), plain.select("shard", "filter"))]
        self.looked_up = look.count()
        references = self.references
        if self.looked_up:
            of = references.join(look.select("shard"), "shard", "left_semi")
            revised = keep(look.groupBy("shard").cogroup(of.groupBy("shard")).applyInArrow(revise, "shard long, filter binary, rows binary"), f"{at}/revised")
            references = references.join(look.select("shard"), "shard", "left_anti")
            new.append((revised.select("shard", "rows"), revised.select("shard", "filter")))
        first = self.generation == 1
        self.filters = None if first else self.filters.join(told.select("shard"), "shard", "left_anti")
        self.postings = postings if first else self.postings.join(postings.select("chunk"), "chunk", "left_anti").unionByName(postings)
        self.references = None if first else references
        for rows, filters in new:
            self.references = rows if self.references is None else self.references.unionByName(rows)
            self.filters = filters if self.filters is None else self.filters.unionByName(filters)
        if self.generation % COMPACT == 0:
            self.postings, self.references, self.filters = (keep(x, f"{at}/{n}") for x, n in ((self.postings, "postings"), (self.references, "references"), (self.filters, "filters")))

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents; one whose doc_id is already in takes the place of the former."""
        self._apply(docs, False)
        return self

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take documents out by their doc_id; ids that are not in do nothing."""
        self._apply(docs if "text" in docs.columns else docs.withColumn("text", F.lit(None).cast("string")), True)
        return self

    def decisions(self) -> DataFrame:
        """By chunk: the keys that lose lines, with the doc_id that keeps them."""
        return self.references.groupBy("shard").applyInArrow(partial_of(decide, self.min_docs), "chunk int, rows binary")

    def apply(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_text, kept_sha256 of documents under the index as it is."""
        decisions = self.decisions()
        id_type = docs.schema["doc_id"].dataType.simpleString()
        out = f"doc_id {id_type}, n_lines long, n_dropped long, kept_text string, kept_sha256 string"
        min_chars = self.min_chars
        return self._chunked(docs).groupBy("chunk").cogroup(decisions.groupBy("chunk")).applyInArrow(lambda a, b: rewrite(a, b, min_chars), out)


def dedup_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, with all their columns, without the lines that other documents keep.

    A null text stays null; the column `length`, if there is one, gets the code points that are left.
    """
    integer_id(docs, doc_id)
    length = length if length in docs.columns else None
    index = LineIndex.for_table(docs, text, min_chars, min_docs)
    index.insert(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    # the operator's own columns go beside the table's, whose names stay as they are
    names = docs.columns
    inner = docs.toDF(*(f"c_{i}" for i in range(len(names)))).withColumns({"doc_id": F.col(f"c_{names.index(doc_id)}"), "text": F.col(f"c_{names.index(text)}")})
    own = inner.withColumn("chunk", chunk_of("doc_id", "text", index.chunks))
    schema = docs.toDF(*(f"c_{i}" for i in range(len(names)))).schema
    at, size = f"c_{names.index(text)}", f"c_{names.index(length)}" if length else None
    return own.groupBy("chunk").cogroup(index.decisions().groupBy("chunk")).applyInArrow(lambda a, b: rewrite_rows(a, b, min_chars, at, size), schema).toDF(*names)


def partial_of(f, value):
    return lambda table: f(table, value)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every document without the lines that other documents keep.

    Returns doc_id, n_lines, n_dropped, kept_text, kept_sha256.  doc_id is of an integer type; others raise TypeError.  A
    null or empty text is one empty line.
    A null doc_id is not counted among a key's documents and loses no line.  Rows with the same doc_id count
    as one document, and each is returned.  Other columns are ignored.  An empty table gives no rows.
    """
    integer_id(docs, doc_id)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    index = LineIndex.for_table(docs, text, min_chars, min_docs)
    return index.insert(own).apply(own)
