"""Entries whose n-grams are rare."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngram_at, ngram_words
from ..tables import written
from .result import OUTLIERS, Summary


#: Frequent n-grams whose counts every task has at hand, and bytes of them.
FREQUENT, FREQUENT_BYTES = 200_000, 16 << 20


def _exploded(entries: DataFrame, n: int, *keep: str) -> DataFrame:
    """A row for each n-gram. The words are a column of their own first: inside the windows they would be split anew for each."""
    split = entries.select(*keep, ngram_words(F.col("content")).alias("words")).where("words is not null")
    placed = split.select(*keep, "words", F.posexplode_outer("words").alias("at", "word"))
    return placed.select(*keep, ngram_at(F.col("words"), F.col("at"), n).alias("ngram")).where("ngram is not null")


def ngram_counts(entries: DataFrame, n: int = 2) -> DataFrame:
    """(ngram, n): how often each occurs over all entries."""
    return _exploded(entries, n).groupBy("ngram").agg(F.count("*").alias("n"))


def top_ngrams(counts: DataFrame) -> DataFrame:
    """The ten most frequent of (ngram, n); equal counts in order of the n-gram."""
    return counts.orderBy(F.desc("n"), "ngram").limit(10)


def _frequent_from(counts: DataFrame) -> int:
    """The least power of two such that the n-grams that occur as often are few enough to be sent to every task."""
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    rows = counts.groupBy(power.alias("power")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("ngram")).alias("bytes")).collect()
    many = size = 0
    least = 63
    for r in sorted(rows, key=lambda r: -r.power):
        many, size = many + r.rows, size + r.bytes
        if many > FREQUENT or size > FREQUENT_BYTES:
            break
        least = r.power
    return max(2, 1 << least) if least < 63 else 1 << 62


def scores(entries: DataFrame, n: int = 2, counts: DataFrame | None = None) -> DataFrame:
    """(src, idx, score): the mean share that an entry's n-grams have of all n-grams.

    Counts are summed as whole numbers and divided once, so the order of the rows does not matter.
    Every n-gram counts 1, and what it occurs more often is added: of the most frequent ones where
    the entry is read, so that they are not shuffled; of the others by a join with those that occur
    twice at least. What occurs once has nothing to send back.
    """
    each = _exploded(entries, n, "src", "idx")
    counts = written(ngram_counts(entries, n), "ngrams") if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = _frequent_from(counts)
    frequent = F.broadcast(counts.where(F.col("n") >= least))  # at most FREQUENT rows
    more = (F.col("n") - 1).alias("more")
    here = each.join(frequent, "ngram", "left").select("src", "idx", F.coalesce(more, F.lit(0)).alias("more"), F.lit(1).alias("grams"))
    there = each.join(frequent, "ngram", "left_anti").join(counts.where((F.col("n") > 1) & (F.col("n") < least)), "ngram").select("src", "idx", more, F.lit(0).alias("grams"))
    own = here.unionByName(there).groupBy("src", "idx").agg(F.sum("more").alias("more"), F.sum("grams").alias("grams"))
    hits, grams = (F.col("more") + F.col("grams")).cast("double"), F.col("grams").cast("double")
    return own.select("src", "idx", (hits / F.lit(float(total)) / grams).alias("score"))


def _kth(scored: DataFrame, k: int, bins: int = 256) -> float:
    """The k-th lowest score: counts in equal bins, then in bins of the bin that holds it, until one value is left."""
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    below = 0
    while low < high:
        place = F.least(F.floor((F.col("score") - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1))
        rows = scored.where(F.col("score").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
        for r in sorted(rows, key=lambda r: r.bin):
            if below + r.n >= k:
                low, high = r.low, r.high
                break
            below += r.n
    return low


def threshold(scored: DataFrame, explicit: float = 0.0) -> float:
    """The explicit threshold if it is above 0, else just over the k-th lowest score; k is a twentieth of the entries, at least 1, at most a fifth."""
    if explicit > 0:
        return explicit
    n = scored.count()
    if not n:
        return 0.0
    k = max(1, math.ceil(min(max(0.05 * n, 1.0), 0.2 * n)))
    return _kth(scored, k) * 1.0001


def outliers(entries: DataFrame, n: int = 2, explicit: float = 0.0) -> Summary:
    """Entries that score below the threshold; equal scores in order of the entries."""
    counts = written(ngram_counts(entries, n), "ngrams")
    scored = written(scores(entries, n, counts), "scores")
    count = scored.count()
    limit = threshold(scored, explicit)
    median = _kth(scored, count // 2 + 1) if count else 0.0
    baseline = scored.agg(F.coalesce(F.min("score"), F.lit(0.0)).alias("min"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"))
    baseline = baseline.withColumn("median", F.lit(float(median))).withColumn("threshold", F.lit(float(limit))).withColumn("auto_detected", F.lit(explicit <= 0))
    rare = scored.where(F.col("score") < limit)
    found = entries.join(rare, ["src", "idx"]).select(F.struct("src", "idx").alias("first"), "content", F.coalesce(F.col("line_numbers")[0], F.lit(0)).alias("line_number"), F.lit("rare_ngrams").alias("reason"), "score")
    size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long")
    totals = entries.agg(F.count("*").alias("total_entries"), size("content").alias("original_size")).crossJoin(found.agg(F.count("*").alias("outliers"), size("content").alias("reduced_size")))
    features = top_ngrams(counts)
    return Summary(OUTLIERS, "ngram_outlier_detection", None, found, totals, baseline=baseline, features=features)
