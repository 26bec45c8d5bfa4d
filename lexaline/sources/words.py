"""Loading weighted words: parsing, cleaning, weights by count or by rank, merging of spellings."""

from __future__ import annotations

from dataclasses import dataclass
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalize, strip
from ..operators.rank import ranked

#: Fixed value: a term, one or more separators, a count at the end of the line.
COUNTED = r"^(.+?)[\t,; ]+(\d+)\s*$"
MOST = 9223372036854775807


@dataclass(frozen=True)
class LoadReport:
    source: str
    lines_read: int
    skipped: int
    merged_away: int
    entries: int
    weight_source: str

    def summary(self) -> str:
        return f"loaded {self.entries:,} terms from {self.source} ({self.lines_read:,} lines, {self.skipped:,} skipped, {self.merged_away:,} merged, weights by {self.weight_source.lower()})"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of a text file; a missing one raises.

    Files are read whole, since a text split has no line numbers: word lists are small files.
    """
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")).alias("line_no", "line"))


def parse(lines: DataFrame, max_entries: int = 0) -> DataFrame:
    """line_no, line, term, count, counted, usable, kept, read of each line.

    A line is usable if it is neither blank nor a comment and its term is clean.  With max_entries > 0 only
    so many usable lines are kept, and what comes after the last of them is not read.
    """
    text = strip(F.col("line"))
    content = (text != "") & ~text.startswith("#")
    counted = content & text.rlike(COUNTED)
    term = F.when(counted, strip(F.regexp_extract(text, COUNTED, 1))).otherwise(text)
    digits = F.regexp_extract(text, COUNTED, 2)
    count = F.when(counted, F.coalesce(F.expr("try_cast(digits as bigint)"), F.lit(MOST)))
    out = lines.withColumn("content", content).withColumn("counted", counted).withColumn("term", term).withColumn("digits", digits).withColumn("count", count)
    out = out.withColumn("usable", F.col("content") & ~F.col("term").contains("\t") & ~is_blank(F.col("term")))
    read = F.lit(True)
    if max_entries > 0:  # up to the last usable line of so many
        last = out.where("usable").orderBy("line_no").limit(max_entries).agg(F.when(F.count("*") == max_entries, F.max("line_no"))).first()[0]
        read = F.lit(True) if last is None else F.col("line_no") <= last
    return out.withColumn("read", read).withColumn("kept", F.col("usable") & F.col("read")).drop("digits", "content")


def weighted(parsed: DataFrame) -> DataFrame:
    """ord, word, normalized, weight of the kept lines: the counts if any line that was read has one, else ranks."""
    by_count = parsed.where("read").agg(F.coalesce(F.bool_or("counted"), F.lit(False)).alias("by_count"))
    kept = parsed.where("kept")
    if by_count.first()[0]:
        rows, weight = kept, F.greatest(F.coalesce("count", F.lit(0)), F.lit(0))
    else:
        rows, weight = ranked(kept, [F.desc("line_no")], "rank_weight"), F.col("rank_weight")
    return rows.select(F.col("line_no").cast("long").alias("ord"), F.col("term").alias("word"), normalize(F.col("term")).alias("normalized"), weight.alias("weight"))


def deduplicate(entries: DataFrame) -> DataFrame:
    """One row per normalized: the sum of weights, the spelling of the heaviest entry (ties: the least), the first place."""
    return entries.groupBy("normalized").agg(
        F.expr("min_by(word, struct(-weight, word))").alias("word"), F.sum("weight").alias("weight"), F.min("ord").alias("ord")
    ).select("ord", "word", "normalized", "weight")


def fault() -> Column:
    """Whether an entry can't be indexed: its word is null or blank, its weight null or negative."""
    return F.col("word").isNull() | F.col("normalized").isNull() | is_blank(F.coalesce("word", F.lit("x"))) | F.coalesce(F.col("weight") < 0, F.lit(True))


def checked(entries: DataFrame) -> DataFrame:
    """Entries, failing at run time on one with a fault."""
    bad = fault()
    return entries.withColumn("weight", F.when(bad, F.raise_error(F.lit("a word must not be null or blank, nor its weight negative"))).otherwise(F.col("weight")))


def report(parsed: DataFrame, corpus: DataFrame, source: str) -> LoadReport:
    r = parsed.where("read").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.coalesce(F.bool_or("counted"), F.lit(False)).alias("counted")).first()
    n = corpus.count()
    return LoadReport(source, r["n"], r["n"] - r["kept"], r["kept"] - n, n, "COLUMN" if r["counted"] else "RANK")


def from_lines(lines: DataFrame, max_entries: int | None = None, source: str = "lines") -> tuple[DataFrame, LoadReport]:
    """Corpus and report of lines; max_entries is by default what the session's configuration says."""
    parsed = parse(lines, max_entries_of(lines.sparkSession) if max_entries is None else max_entries)
    corpus = deduplicate(checked(weighted(parsed)))
    return corpus, report(parsed, corpus, source)


def load(spark: SparkSession, path: str, max_entries: int | None = None) -> tuple[DataFrame, LoadReport]:
    """Corpus and report of a delimited word list."""
    return from_lines(lines_of(spark, path), max_entries, path)


def load_resource(spark: SparkSession, package: str, name: str, max_entries: int | None = None) -> tuple[DataFrame, LoadReport]:
    """The same for a file in a package; a missing one raises ValueError."""
    found = resources.files(package) / name
    if not found.is_file():
        raise ValueError(f"no resource {name} in {package}")
    lines = found.read_text("utf-8").splitlines()
    return from_lines(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"), max_entries, name)


#: Where a word list that comes with an installation is looked for.
BUNDLED = ("lexaline.sources", "words.txt")


def bundled(spark: SparkSession, max_entries: int | None = None) -> tuple[DataFrame, LoadReport]:
    """The list that comes with an installation, or its first entries; ValueError where there is none, as in this repository."""
    return load_resource(spark, *BUNDLED, max_entries)


def max_entries_of(spark: SparkSession) -> int:
    """The setting lexaline.dataset.max-entries; 0, for all, where it is unset."""
    return int(spark.conf.get("lexaline.dataset.max-entries", "0"))


#: Fixed value: a word is a run of letters of any script, with their marks.
LETTERS = r"[\p{L}\p{M}]+"


def tokens(documents: DataFrame, text: str = "text") -> DataFrame:
    """Entries from texts: each spelling of a run of letters with its number of occurrences."""
    words = documents.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("weight")).select(F.lit(0).cast("long").alias("ord"), "word", F.lower("word").alias("normalized"), "weight")


def from_tokens(documents: DataFrame, text: str = "text") -> DataFrame:
    return deduplicate(tokens(documents, text))


def slice_of(corpus: DataFrame, n: int) -> DataFrame:
    """The n heaviest words; all if n <= 0."""
    return corpus.orderBy(F.desc("weight"), "normalized").limit(n) if n > 0 else corpus
