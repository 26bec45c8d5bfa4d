"""What the corpus operators share: folders, chunks of documents, packed arrays, components.

A *chunk* is a group of documents chosen by a hash of doc_id.  It is the unit in which corpus-wide
tables meet the texts: each chunk sends its distinct keys once, however often they repeat inside it,
and gets back one answer per distinct key.  A key that a third of all documents hold therefore costs
one row per chunk, and no task holds more than a chunk's texts or a shard's keys.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..folders import delete, work_dir

#: Stored bytes of a table for each chunk.
CHUNK_BYTES = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: By default a batch for Python has 10,000 rows or 64 MB, and a worker holds several times that.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def discard(*tables: DataFrame) -> None:
    """Delete tables that keep() wrote, once all that is made from them is written itself."""
    for table in tables:
        delete(table.sparkSession, table._kept_at)


def keep(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: later plans start from files, not from df's lineage.

    The write's shuffle files go when it ends, since nothing reads them again; the setting for that is read when the
    write is planned, and is put back.
    """
    spark = df.sparkSession
    path = folder or work_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def in_batches(operator):
    """What an operator writes, by keep(), sends its rows to Python in batches of about BATCH bytes, so that a worker's memory
    goes by neither the number of rows nor their size; the setting is put back."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs):
        conf = docs.sparkSession.conf
        before = conf.get(BATCH_BYTES)
        conf.set(BATCH_BYTES, str(BATCH))
        try:
            return operator(docs, *args, **kwargs)
        finally:
            conf.set(BATCH_BYTES, before)

    return run


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(table: DataFrame, text: str = "text", stored: int = CHUNK_BYTES) -> int:
    """Chunks for a table, from the size that the planner has of it; from its texts where the planner has none."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 50:
        size = table.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(parts(table.sparkSession), math.ceil(size / stored))


def integer_id(table: DataFrame, name: str) -> None:
    """TypeError unless a table's ids are of an integer type."""
    if not isinstance(table.schema[name].dataType, T.IntegralType):
        raise TypeError(f"{name} must be of an integer type, not {table.schema[name].dataType.simpleString()}")


def chunk_of(doc_id: str, text: str, chunks: int):
    """The chunk of a document, by its id; by its text where it has none, so that equal texts without an id share one."""
    return F.pmod(F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.lit("chunk"), doc_id)), F.lit(chunks)).cast("int")


def held(doc_id: str, remainder: int, modulus: int = 5):
    """crc32(doc_id as text) mod modulus = remainder; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def pack(a: np.ndarray, sorted_keys: bool = False) -> bytes:
    """An array's bytes, plane by plane and compressed; increasing keys go as differences."""
    if sorted_keys and len(a):
        a = np.diff(a, prepend=a.dtype.type(0))
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, dtype, sorted_keys: bool = False) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    a = np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel() if len(planes) else np.empty(0, dtype)
    return np.cumsum(a, dtype=dtype) if sorted_keys and len(a) else a


def texts_of(column: pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Vocabulary(dict):
    """Word to its number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(texts: list[bytes], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words as numbers, end to end, and where each text begins, with the end of the last."""
    own = [np.fromiter(map(words.__getitem__, ws), np.int32, len(ws)) for ws in (t.split() for t in texts)]
    at = np.zeros(len(own) + 1, np.int64)
    np.cumsum([len(a) for a in own], out=at[1:])
    return np.concatenate([np.empty(0, np.int32), *own]), at


def rolled(h: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Hash of each run of width words, by doubling: a run is two shorter runs, or such and a word."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    f = lambda n: np.uint64(pow(factor, n, 1 << 64))
    out, n = h, 1
    for bit in bin(width)[3:]:
        out, n = out[: len(out) - n] * f(n) + out[n:], 2 * n
        if bit == "1":
            out, n = out[:-1] * f(1) + h[n:], n + 1
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BLANK = np.zeros(256, bool)
BLANK[[*range(9, 14), 32]] = True


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, end to end, and where each text begins among them, with the end of the last;
    where each word begins and ends in the texts joined by a line end."""
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = BLANK[a]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    begin, end = edge[::2], edge[1::2]
    size = end - begin
    at = np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    if not len(begin):
        return np.empty(0, np.uint64), at, begin, end
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max()), 0x9FB21C651E98DF25, np.uint64))
    h = np.add.reduceat((a[~blank].astype(np.uint64) + np.uint64(1)) * powers[place], first)
    return mixed(mixed(h) + size.astype(np.uint64)), at, begin, end


def merged(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys and each column's sum over equal keys."""
    if not len(keys):
        return (keys, *columns)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first], *(np.add.reduceat(c[order], first) for c in columns))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges a-b: (member, least member), the least itself left out."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (up := root[root]).tolist() != root.tolist() if len(root) < 64 else not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(before, root):
            break
    away = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[away], nodes[root[away]]


def _local_forest(batches):
    """Edges of a partition, BLOCK at a time, replaced by their spanning stars."""
    block, held_a, held_b = 1 << 20, [], []

    def out():
        a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for x in batches:
        held_a.append(x.column(0).to_numpy(zero_copy_only=False))
        held_b.append(x.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, held_a)) >= block:
            yield out()
            held_a, held_b = [], []
    if held_a:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge; edges has long columns a and b, root is the component's least node.

    Rounds of: link each node to its least neighbour, follow the links to their end, contract the
    edges.  Each round leaves at most half of the nodes that still have edges; what a round found is
    written to the shared folder, so that a lost executor repeats one round at most.  Nothing goes
    to the driver but the number of edges left.
    """
    edges = keep(edges.select("a", "b").where("a <> b").mapInArrow(_local_forest, "a long, b long").distinct())
    found = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        link = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
        while True:  # links go to lesser nodes, so following them ends
            up = link.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = keep(link.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            link = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        found = link if found is None else keep(
            found.join(link.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        a = link.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = link.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = keep(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
