"""Template counts over a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T


def template_counts(lines: DataFrame, *, time_col: str = "ts", line_col: str = "line", window: str = "1 hour", lateness: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, pattern, n) for each window; state is dropped once a window is ``lateness`` in the past.

    Works on batches too, where nothing is late.
    """
    timed = lines.withWatermark(time_col, lateness).withColumn("signature", T.signature(F.col(line_col)))
    counted = timed.groupBy(F.window(time_col, window, slide), "signature").agg(F.count("*").alias("n"))
    return counted.select("window.start", "window.end", T.pattern(F.col("signature")).alias("pattern"), "n")
