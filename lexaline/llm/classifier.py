"""Quality classifier: random Fourier features, ridge from partition-summed normal equations, isotonic calibration.

Each text gives a row of statistics.  They are standardised over all documents, and FEATURES random cosines
of them approximate a Gaussian kernel of width WIDTH.  Every task adds up the normal equations of its
labelled rows, a matrix whose size does not depend on the rows; the tasks' matrices are summed SLOTS at a time, level
by level, until so few are left, and the ridge solution is found on the driver.  Calibration is by pool-adjacent-violators over BINS
bins of the ridge score, counted over labelled rows that the ridge did not see.

Folds are crc32(doc_id as text) mod 5: 0 is held out and never learnt from, 1 calibrates, 2 to 4 train.
All labelled rows of a fold are used.  doc_id, labels, lang and source are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pack, texts_of, unpack

FEATURES, WIDTH, RIDGE, SEED, SLOTS, BINS, CUT = 256, 6.0, 1.0, 7, 32, 1024, 0.3
STATS = ("log_words", "mean_word", "symbols", "upper", "digits", "bangs", "bars", "stops", "distinct_words", "distinct_pairs", "top_word", "repeated_lines", "line_words", "entropy", "long_words", "short_words", "ended", "letters", "high_bytes", "log_lines", "spaces", "capital_words")


def classes() -> np.ndarray:
    """Rows of 0 and 1: which byte values count for which statistic."""
    out = np.zeros((9, 256))
    for i, some in enumerate((b"#*$%&<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b".,;:?", b"abcdefghijklmnopqrstuvwxyz", bytes(range(128, 256)), b" \t\n\r\x0b\x0c")):
        out[i, list(some)] = 1
    return out


def statistics(text: bytes, table: np.ndarray) -> list[float]:
    words, n_bytes = text.split(), len(text)
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    symbols, upper, digits, bangs, bars, stops, lower, high, spaces = (table @ bytes_ / n_bytes).tolist()
    p = bytes_[bytes_ > 0] / n_bytes
    count = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [np.log1p(n), lengths.mean(), symbols, upper, digits, bangs, bars, stops, len(count) / n, (pairs + 1) / n, max(count.values()) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), -float(p @ np.log(p)), float((lengths > 15).mean()), float((lengths < 3).mean()),
            sum(w[-1] in b".,;:?" for w in words) / n, lower, high, np.log1p(len(lines)), spaces, sum(w[:1].isupper() for w in words) / n]


def measured(batches):
    table = classes()
    for x in batches:
        rows = [statistics(t, table) for t in texts_of(x.column(2))]
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "fold", "x"])


def matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, len(STATS))


class Kernel:
    """Standardised statistics to random cosines and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 0, scale, 1.0)
        self.w = rng.standard_normal((len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b
        return np.hstack((np.cos(z) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))))


def equations(kernel: Kernel):
    """A task's Z'Z and Z'y in one matrix."""

    def run(batches):
        total = np.zeros((len(kernel.b) + 1, len(kernel.b) + 2))
        slot = 0
        for x in batches:
            if x.num_rows:
                z, y = kernel(matrix(x.column(0))), x.column(1).to_numpy(zero_copy_only=False).astype(float)
                total += z.T @ np.column_stack((z, y))
                slot = x.column(2)[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([pack(total.ravel())], pa.binary())], ["slot", "sums"])

    return run


def added(table: pa.Table) -> pa.Table:
    total = 0.0
    for b in table["sums"]:
        total = total + unpack(b.as_py(), float)
    return pa.table({"slot": table["slot"][:1], "sums": pa.array([pack(total)], pa.binary())})


def summed(sums: DataFrame, slots: int = SLOTS) -> list[bytes]:
    """At most `slots` matrices that add up to all of them: no task adds more, however many tasks there were."""
    tasks = sums.agg(F.count("*")).first()[0]
    while tasks > slots:
        tasks = -(-tasks // slots)
        sums = keep(sums.withColumn("slot", F.pmod("slot", F.lit(tasks)).cast("int")).groupBy("slot").applyInArrow(added, "slot int, sums binary"))
    return [bytes(r["sums"]) for r in sums.select("sums").collect()]


def isotonic(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing rates of the bins by pooling adjacent violators; each pool's rate is (ones + 1/2) / (n + 1)."""
    pools: list[list[float]] = []  # ones, n, bins
    for k, m in zip(ones.tolist(), n.tolist(), strict=True):
        pools.append([k, m, 1])
        while len(pools) > 1 and (not pools[-1][1] or not pools[-2][1] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            k2, m2, b2 = pools.pop()
            pools[-1] = [pools[-1][0] + k2, pools[-1][1] + m2, pools[-1][2] + b2]
    rates = np.maximum.accumulate([(k + 0.5) / (m + 1) for k, m, _ in pools])
    return np.repeat(rates, [int(b) for _, _, b in pools])


def bin_of(raw: np.ndarray) -> np.ndarray:
    """Bins of the ridge score from -0.5 to 1.5."""
    return np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int64)


def binned(kernel: Kernel, beta: np.ndarray):
    def run(batches):
        n, ones = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for x in batches:
            at, y = bin_of(kernel(matrix(x.column(0))) @ beta), x.column(1).to_numpy(zero_copy_only=False)
            n += np.bincount(at, minlength=BINS)
            ones += np.bincount(at, y, BINS).astype(np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(ones[at])], ["bin", "n", "ones"])

    return run


def scored(kernel: Kernel, beta: np.ndarray, rates: np.ndarray):
    def run(batches):
        for x in batches:
            raw = kernel(matrix(x.column(2))) @ beta
            # the last thousandth keeps the order of the ridge scores within a pool
            score = 0.999 * rates[bin_of(raw)] + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30)))
            held = [f == 0 for f in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(raw)], ["doc_id", "held_out", "score", "predicted", "ridge"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """A calibrated score of every document.

    Returns doc_id, held_out, score (0 to 1), predicted (score >= CUT), ridge.  A null or empty text has
    statistics of zero and a score like any other.  A null doc_id is in no fold: it is scored, not
    learnt from.  A label other than 0 and 1 is not learnt from; a doc_id labelled twice counts twice.
    Repeated rows are each scored.  Without labels every score is one half, nearly.  Other columns of
    either table are ignored.  An empty table gives no rows.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    fold = (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5).cast("int")
    rows = keep(docs.select(F.col(doc_id).alias("doc_id"), fold.alias("fold"), F.col(text).alias("text")).mapInArrow(measured, f"doc_id {id_type}, fold int, x array<double>"))
    width = range(len(STATS))
    sums = rows.agg(*(F.avg(F.col("x")[i]) for i in width), *(F.stddev_pop(F.col("x")[i]) for i in width)).first()
    moments = np.array([v or 0.0 for v in sums])
    kernel = Kernel(moments[: len(STATS)], moments[len(STATS) :])
    marks = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    learnt = keep(rows.where("fold > 0").join(marks, "doc_id").select("x", "y", "fold"))
    each = learnt.where("fold > 1").select("x", "y", F.spark_partition_id().alias("slot"))
    parts = summed(keep(each.mapInArrow(equations(kernel), "slot int, sums binary")))
    beta = np.zeros(len(kernel.b) + 1)
    if parts:
        total = sum(unpack(p, float) for p in parts).reshape(len(beta), -1)
        beta = np.linalg.solve(total[:, :-1] + RIDGE * np.eye(len(beta)), total[:, -1])
    n, ones = np.zeros(BINS), np.zeros(BINS)
    for r in learnt.where("fold = 1").select("x", "y").mapInArrow(binned(kernel, beta), "bin long, n long, ones long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect():
        n[r["bin"]], ones[r["bin"]] = r["n"], r["ones"]
    return rows.mapInArrow(scored(kernel, beta, isotonic(n, ones)), f"doc_id {id_type}, held_out boolean, score double, predicted int, ridge double")
