"""Mixing sources to target weights, with DataFrame functions alone.

Each row gets a hash-random key. Rows are range-sorted by that key within their source:
a fixed number of leading key bits names a range, ranges are summed with map-side
combination, a prefix sum over the ranges of a source gives each range its offset, and a
window inside one range gives each row its own. No task needs a whole source, so a source
with a third of all rows is as good as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash

#: Hex digits of the key that name a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(s, source_size) with a row a source, plus ``target``.

    Sources in order of code points, null last, take the weights in turn. A source stops at
    ``max_epochs`` times its size; what it leaves is reshared by weight. With the sources in
    order of limit / weight the common level is the largest of (words left) / (weight left).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
        .withColumn("most", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
        .withColumn("spent", F.coalesce(F.sum("most").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", F.max((F.col("total") - F.col("spent")).cast("double") / F.col("left").cast("double")).over(everything))
        .withColumn("target", F.least(F.col("most").cast("double"), F.col("weight").cast("double") * F.col("level")))
        .select("s", "source_size", "target")
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each row the mix takes.

    Returns ``id_col``, size, source_size, target, taken and the ``carry`` columns. A source
    takes floor(target) words: whole passes over its rows, then rows in order of their key up
    to the exact word, so the last row may count in part. The order depends on the id and
    ``seed`` alone: reruns agree.

    Null text or text without words: size 0, taken 0. Null source: a source of its own, last.
    Null ids share a key; ties fall to the id, the size and the text's hash, and rows equal
    in all of these get shares that differ by the row's place among its equals. An empty table
    gives an empty result. Other columns are neither read nor clashed with.
    """
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("s"),
        word_count(F.col(text_col)).alias("size"),
        key.alias("key"),
        F.substring(key, 1, RANGE_DIGITS).alias("range"),
        F.xxhash64(text_col).alias("tie"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    if carry:
        ranges = stash(rows.groupBy("s", "range").agg(F.sum("size").alias("words"), F.first("source").alias("source")), "mix-ranges")
    else:
        rows = stash(rows, "mix-rows")
        ranges = rows.groupBy("s", "range").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    sizes = ranges.groupBy("s").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    budget = F.floor("target").cast("long")
    shares = (
        targets(sizes, weights, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long")))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    )
    offsets = (
        ranges.withColumn("offset", F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("s", "range", "offset")
        .join(shares, "s")
    )
    inside = Window.partitionBy("s", "range").orderBy("key", F.col("id").asc_nulls_last(), "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before")))
    placed = (
        rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["s", "range"])
        .withColumn("before", F.col("offset") + F.col("inner"))
    )
    return placed.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), *(["carried"] if carry else [])
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, and its last copy cut after the words that count.

    Has the columns of ``docs``; ``n_chars``, where there is one, is counted anew.
    """
    names = docs.columns
    plan = mix(docs, carry=tuple(names), **options)
    text_col = options.get("text_col", "text")
    full, rest = F.expr("cast(taken div size as int)"), F.expr("cast(taken % size as int)")
    counts = F.concat(F.array_repeat(F.col("size").cast("int"), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = plan.where("taken > 0").select("carried", "size", F.explode(counts).alias("words_kept"))
    own = lambda c: F.col("carried").getField(c)
    cut = F.array_join(F.slice(F.regexp_extract_all(own(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, F.col("words_kept")), "")
    out = out.withColumn("kept", F.when(F.col("words_kept") < F.col("size"), cut).otherwise(own(text_col)))
    columns = {c: own(c) for c in names} | {text_col: F.col("kept")}
    if "n_chars" in names:
        columns["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*(columns[c].alias(c) for c in names))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':0') AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS most FROM sizes),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sizes)
      - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
shares AS (SELECT source, source_size, least(most::DOUBLE, weight::DOUBLE * (SELECT max(level) FROM levels)) AS target FROM levels),
plan AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs, floor(target)::BIGINT AS budget FROM shares),
placed AS (
  SELECT b.*, p.source_size, p.target, p.epochs, p.budget - p.epochs * p.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed
"""
