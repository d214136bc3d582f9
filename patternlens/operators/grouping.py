"""Grouping of entries by a key they have: templates, slots, field values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from .result import GROUPED, Summary, line_ranges

SAMPLES = 3
_EMPTY_MAP = "map<string,array<string>>"


def template_counts(entries: DataFrame) -> DataFrame:
    """(signature, n): a hash aggregate with map-side combination, the whole of template extraction's grouping."""
    return entries.groupBy(T.signature(F.col("first_line")).alias("signature")).agg(F.count("*").alias("n"))


def _firsts(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` entries of each key, with their place ``pos`` from 1; Spark drops the others before the shuffle."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("src", "idx"))).where(F.col("pos") <= n)


def _size(column: Column) -> Column:
    return F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long")


def _totals(entries: DataFrame, content: str, groups: DataFrame, samples: DataFrame, per_group: int, lone: DataFrame) -> DataFrame:
    own = entries.agg(F.count("*").alias("total_entries"), _size(F.col(content)).alias("original_size"))
    shown = groups.agg(F.count("*").alias("unique_patterns"), F.coalesce(F.max("count"), F.lit(0)).alias("largest_cluster"), (_size(F.col("pattern")) + F.count("*") * per_group).alias("patterns_size"))
    sampled = samples.agg(_size(F.col("content")).alias("samples_size"))
    rest = lone.agg(F.count("*").alias("outliers"))
    return own.crossJoin(shown).crossJoin(sampled).crossJoin(rest).withColumn("reduced_size", F.col("patterns_size") + F.col("samples_size"))  # single rows


def patterns(entries: DataFrame) -> Summary:
    """Template extraction: entries whose first lines have one signature are a group."""
    rows = entries.withColumn("key", T.signature(F.coalesce("first_line", F.lit(""))))
    first = F.min(F.struct("src", "idx"))
    groups = rows.groupBy("key").agg(F.count("*").alias("count"), first.alias("first")).withColumn("name", T.template_name(F.col("key"))).withColumn("pattern", T.pattern(F.col("key")))
    head = _firsts(rows, 5)
    own = head.select("key", "pos", "content", F.col("line_numbers")[0].alias("n"), F.coalesce(T.variables(F.col("first_line")), F.array().cast("array<string>")).alias("vars"))
    five = own.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "content", "n", "vars"))).alias("own"))  # five rows at most
    slots = F.array_max(F.transform("own", lambda r: F.size(r["vars"])))
    places = F.sequence(F.lit(0), F.greatest(slots, F.lit(1)) - 1)
    of_slot = lambda j: F.transform(F.filter("own", lambda r: F.size(r["vars"]) > j), lambda r: F.get(r["vars"], j))
    maps = F.when(slots > 0, F.map_from_arrays(F.transform(places, lambda j: F.concat(F.lit("var_"), j.cast("string"))), F.transform(places, of_slot)))
    samples = five.select("key", F.lit(1).alias("pos"), F.col("own")[0]["content"].alias("content"), F.slice(F.col("own")["n"], 1, SAMPLES).alias("line_numbers"), maps.alias("variable_values"))
    lone = _alone(rows.groupBy("key").agg(F.count("*").alias("count"), F.min(F.struct("src", "idx", "content", F.col("line_numbers")[0].alias("line"))).alias("one")), entries)
    return Summary(GROUPED, "template_extraction", groups, lone, _totals(entries, "content", groups, samples, 8, lone), samples, line_ranges(rows.select("key", F.col("line_numbers")[0].alias("number"))))


def _alone(counted: DataFrame, entries: DataFrame) -> DataFrame:
    """The same out of one aggregate: (key, count, one) with the first entry of each group."""
    total = entries.agg(F.count("*").alias("total"))
    one = counted.where("count = 1").select(F.struct("one.src", "one.idx").alias("first"), "one.content", F.coalesce("one.line", F.lit(0)).alias("line_number"))
    return one.crossJoin(total).select("first", "content", "line_number", F.lit("rare_pattern").alias("reason"), (F.lit(1.0) / F.col("total")).alias("score"))


def _lone(rows: DataFrame, groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that are alone in their group; the groups stay groups."""
    total = entries.agg(F.count("*").alias("total"))
    one = groups.where("count = 1").select("key")
    return rows.join(one, "key").crossJoin(total).select(F.struct("src", "idx").alias("first"), "content", F.coalesce(F.col("line_numbers")[0], F.lit(0)).alias("line_number"), F.lit("rare_pattern").alias("reason"), (F.lit(1.0) / F.col("total")).alias("score"))


def group_by_slot(entries: DataFrame, n: int) -> Summary:
    """Groups by the n-th token that is neither blank nor punctuation; equal counts in order of the value."""
    rows = entries.withColumn("key", F.get(T.slots(F.col("first_line")), n)["text"])
    keyed = rows.where("key is not null")
    groups = keyed.groupBy("key").agg(F.count("*").alias("count"), F.min(F.struct("src", "idx")).alias("first")).withColumn("name", F.col("key")).withColumn("pattern", F.concat(F.lit(f"slot[{n}] = "), F.col("key")))
    samples = _firsts(keyed, SAMPLES).select("key", "pos", "content", "line_numbers", F.lit(None).cast(_EMPTY_MAP).alias("variable_values"))
    lone = rows.where("key is null").select(F.struct("src", "idx").alias("first"), "content", F.coalesce(F.col("line_numbers")[0], F.col("idx") + 1).alias("line_number"), F.lit(f"no token at slot[{n}]").alias("reason"), F.lit(0.0).alias("score"))
    return Summary(GROUPED, f"group_by(slot[{n}])", groups, lone, _totals(entries, "content", groups, samples, 0, lone), samples, line_ranges(keyed.select("key", F.col("line_numbers")[0].alias("number"))), outlier_prefix="ungrouped", extra={"order": ("key",)})


def group_by_value(entries: DataFrame, name: str, key: Column) -> Summary:
    """Groups of (src, idx, j) by a scalar as text; entries whose key is null are left ungrouped. Equal counts in order of the value."""
    rows = entries.withColumn("key", key)
    keyed = rows.where("key is not null")
    groups = keyed.groupBy("key").agg(F.count("*").alias("count"), F.min(F.struct("src", "idx")).alias("first")).withColumn("name", F.col("key")).withColumn("pattern", F.concat(F.lit(f".{name} = "), F.col("key")))
    samples = _firsts(keyed, SAMPLES).select("key", "pos", F.col("j").alias("content"), F.lit(None).cast("array<long>").alias("line_numbers"), F.lit(None).cast(_EMPTY_MAP).alias("variable_values"))
    lone = rows.where("key is null").select(F.struct("src", "idx").alias("first"), F.col("j").alias("content"), (F.col("idx") + 1).alias("line_number"), F.lit(f"missing field '{name}'").alias("reason"), F.lit(0.0).alias("score"))
    return Summary(GROUPED, f"group_by(.{name})", groups, lone, _totals(entries, "j", groups, samples, 0, lone), samples, outlier_prefix="ungrouped", extra={"order": ("key",)})
