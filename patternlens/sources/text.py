"""Text sources: (src, idx, content, first_line, line_numbers), a row an entry.

``src`` names a document, ``idx`` counts its entries from 0; together they are the order of
entries, and the only one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_continuation

#: Fixed value: how a line with a time stamp at its start looks.
STAMPED = r"(?U)^[\[\(]?\d{4}[-/]\d{2}[-/]\d{2}[T\s]\d{2}:\d{2}:\d{2}"

#: Lines that are numbered together.
SEGMENT = 65_536


@dataclass(frozen=True)
class Files:
    """Files or folders that Spark can read, as a source."""

    paths: tuple[str, ...]


def _numbered(found: DataFrame) -> DataFrame:
    """(path, src): the files in order of their paths; a row a file, so one task can hold them."""
    return found.select("path").distinct().withColumn("src", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(src, raw) of whole files, as a JSON document needs them; numbered in order of their paths."""
    found = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return found.join(_numbered(found), "path").select("src", "raw")


def file_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(src, line_no, line) of files that are read in splits, as long as they may be.

    Lines are numbered within each split, and each split starts after the lines of those before it
    in its file, so no task needs more than a split.
    """
    split = ["path", "start"]
    place = F.row_number().over(Window.partitionBy(*split).orderBy("at"))
    read = spark.read.option("lineSep", "\n").text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    sizes = read.groupBy(*split).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("before", before).join(_numbered(sizes), "path").select(*split, "before", "src")
    return read.withColumn("place", place).join(starts, split).select("src", (F.col("before") + F.col("place")).cast("long").alias("line_no"), F.regexp_replace("line", r"\r\z", "").alias("line"))


def from_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "src long, raw string")


def _lines(docs: DataFrame, src: str, raw: str) -> DataFrame:
    """(src, line_no, line): lines end with \\n, a \\r before it goes, the last may lack it; blank lines count."""
    text = F.col(raw)
    cut = F.when(text.endswith("\n"), F.substr(text, F.lit(1), F.char_length(text) - 1)).otherwise(text)
    rows = docs.where(text.isNotNull() & (text != "")).select(F.col(src).alias("src"), F.posexplode(F.split(cut, "\n", -1)).alias("pos", "line"))
    return rows.select("src", (F.col("pos") + 1).cast("long").alias("line_no"), F.regexp_replace("line", r"\r\z", "").alias("line"))


def lines(docs: DataFrame, src: str = "src", raw: str = "raw") -> DataFrame:
    """Every line is an entry."""
    return line_entries(_lines(docs, src, raw))


def line_entries(found: DataFrame) -> DataFrame:
    """Entries of (src, line_no, line)."""
    return found.select("src", (F.col("line_no") - 1).alias("idx"), F.col("line").alias("content"), F.col("line").alias("first_line"), F.array("line_no").alias("line_numbers"))


def blocks(docs: DataFrame, entry_pattern: str | None = None, src: str = "src", raw: str = "raw") -> DataFrame:
    """Entries of several lines; see :func:`block_entries`."""
    return block_entries(_lines(docs, src, raw), entry_pattern)


def block_entries(found: DataFrame, entry_pattern: str | None = None) -> DataFrame:
    """Entries of several lines of (src, line_no, line), one begun by each line that matches the pattern or starts with a time stamp.

    Lines before the first such line are an entry. A document that would be a single entry, or
    that has no time stamp, is split into lines. Lines are numbered by block within segments of
    SEGMENT lines, each of which starts after the blocks of those before it.
    """
    starts = F.col("line").rlike(entry_pattern if entry_pattern is not None else STAMPED)
    marked = found.withColumn("starts", F.coalesce(starts, F.lit(False)).cast("long")).withColumn("segment", F.floor((F.col("line_no") - 1) / SEGMENT))
    sums = marked.groupBy("src", "segment").agg(F.sum("starts").alias("n"), F.min(F.struct("line_no", "starts")).alias("head"))
    whole = Window.partitionBy("src")
    before = F.coalesce(F.sum("n").over(whole.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # of each document: the number of its first block, 0 or 1, and of its last
    sums = sums.withColumn("before", before).withColumn("low", F.min("head").over(whole)["starts"]).withColumn("high", F.sum("n").over(whole)).select("src", "segment", "before", "low", "high")
    inner = F.sum("starts").over(Window.partitionBy("src", "segment").orderBy("line_no"))
    marked = marked.withColumn("inner", inner).join(sums, ["src", "segment"]).withColumn("block", F.col("before") + F.col("inner"))
    single = (F.col("low") == F.col("high")) if entry_pattern is not None else (F.col("high") == 0)
    marked = marked.withColumn("block", F.when(single, F.col("line_no")).otherwise(F.col("block")))
    marked = marked.withColumn("low", F.when(single, F.lit(1)).otherwise(F.col("low")))
    grouped = marked.groupBy("src", "block", "low").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("own"))
    return grouped.select(
        "src",
        (F.col("block") - F.col("low")).alias("idx"),
        F.array_join(F.col("own.line"), "\n").alias("content"),
        F.col("own.line")[0].alias("first_line"),
        F.col("own.line_no").alias("line_numbers"),
    )


def looks_multi_line(docs: DataFrame, src: str = "src", raw: str = "raw") -> DataFrame:
    """(src, multi_line): over a tenth of the first 100 lines with time stamps and over a fifth continuing others."""
    head = _lines(docs, src, raw).where("line_no <= 100")
    share = lambda c: F.avg(c.cast("int"))
    return head.groupBy("src").agg(((share(F.col("line").rlike(STAMPED)) > 0.1) & (share(is_continuation(F.col("line"))) > 0.2)).alias("multi_line"))
