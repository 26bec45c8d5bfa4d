"""A stream of keystrokes answered against a corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine


def debounced(keystrokes: DataFrame, window: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """The last query of each user in each short window; keystrokes has user_id, ts, q, limit."""
    last = F.max_by(F.struct("q", "limit"), "ts").alias("last")
    return keystrokes.withWatermark("ts", late).groupBy("user_id", F.window("ts", window)).agg(last).select("user_id", F.col("window.end").alias("ts"), "last.q", "last.limit")


def answered(queries: DataFrame, engine: Engine, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start answering a stream of query_id, q, limit; the sink gets each micro-batch's results with its number."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(engine.search_batch(batch), epoch)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
