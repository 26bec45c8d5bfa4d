"""Results as JSON responses, and benchmark points as tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def responses(results: DataFrame, by: list[str]) -> DataFrame:
    """One JSON response for each group of ranked results."""
    row = F.struct("rank", "word", "score", "match_type", "edit_distance", "weight")
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r.dropFields("rank"))
    return results.groupBy(*by).agg(F.count("*").alias("result_count"), rows.alias("results")).select(*by, F.to_json(F.struct(*by, "result_count", "results")).alias("response"))


def with_rates(points: DataFrame) -> DataFrame:
    """Benchmark points with operations a second, and whether their error is small enough to rely on."""
    good = ~F.isnan("error_micros") & (F.col("error_micros") <= 0.25 * F.col("micros"))
    return points.withColumn("ops_per_second", 1e6 / F.col("micros")).withColumn("reliable", good)


def with_speedup(points: DataFrame, slow: str = "naive_micros", fast: str = "optimized_micros") -> DataFrame:
    """Pairs of measurements with how many times as fast the second is."""
    return points.withColumn("speedup", F.col(slow) / F.col(fast))


def write_points(points: DataFrame, folder: str) -> None:
    """Benchmark points as JSON lines, as CSV with a header and, for their readers, as one Markdown table: points are few."""
    points.coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    points.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    rows = [r.asDict() for r in points.collect()]
    points.sparkSession.createDataFrame([(markdown(rows),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")


def read_points(points: DataFrame, folder: str, kind: str) -> DataFrame:
    """What write_points() has written as "json" or "csv", by the schema of points."""
    own = points.sparkSession.read.schema(points.schema)
    return own.option("header", True).csv(f"{folder}/csv") if kind == "csv" else own.json(f"{folder}/json")


def markdown(rows: list[dict]) -> str:
    """A table of rows with equal keys."""
    if not rows:
        return ""
    head = list(rows[0])
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(r[k]) for k in head) + " |" for r in rows)]) + "\n"
