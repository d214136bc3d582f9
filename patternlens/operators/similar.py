"""Edit-distance clustering: each entry joins the earliest leader within reach, or leads.

The definition is sequential; this gives its result in rounds. Entries with one content are one
item. A round takes the next items in order, no earlier leader being near any of them, compares
them with one another on the executors, settles them by the pairs found near, and then lets all
other items join the new leaders in parallel. Texts never come to the driver; numbers of items do.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import shared_folder, written
from .result import GROUPED, Summary, line_ranges

#: Items and bytes of text that a round settles: a bound on what is broadcast and on the driver's
#: lists of near items. A single longer text is a round of its own.
ROUND, ROUND_BYTES = 512, 32 << 20


def within(a: str, b: str, limit: float) -> Column:
    """Whether the distance of two columns is at most ``limit`` of the longer one's code points; it stops counting beyond."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    lengths = F.abs(F.char_length(a) - F.char_length(b)) <= F.lit(float(limit)) * longest + F.lit(1e-9)
    reach = f"cast(floor({float(limit)!r}D * greatest(char_length({a}), char_length({b}))) as int) + 1"
    steps = F.expr(f"levenshtein({a}, {b}, {reach})")
    return lengths & ((longest == 0) | ((steps >= 0) & (steps.cast("double") / longest <= F.lit(float(limit)))))


def leaders(order: list[int], near: dict[int, list[int]]) -> dict[int, int]:
    """Item to leader, out of the earlier items near each: the first of these that leads, or else the item."""
    of: dict[int, int] = {}
    for item in order:
        of[item] = next((x for x in near.get(item, ()) if of[x] == x), item)
    return of


def assign(items: DataFrame, limit: float, size: int = ROUND) -> DataFrame:
    """(item, leader) for (item, content), where ``item`` numbers contents in order of first entry.

    Settled items of all rounds are appended to one written table, so the plan does not grow.
    """
    spark = items.sparkSession
    schema, settled = "item long, leader long", shared_folder(items.sparkSession, "leaders")
    left = items
    tasks = spark.sparkContext.defaultParallelism
    while True:
        sized = left.select("item", F.octet_length("content").alias("bytes")).orderBy("item").limit(size).collect()  # at most ``size`` rows
        if not sized:
            break
        order = [r.item for r, upto in zip(sized, accumulate(r.bytes for r in sized), strict=True) if upto <= ROUND_BYTES] or [sized[0].item]
        block = left.where(F.col("item").between(order[0], order[-1]))
        earlier = F.broadcast(block.select(F.col("item").alias("before"), F.col("content").alias("other")))  # ROUND_BYTES at most
        pairs = block.repartition(tasks, "item").join(earlier, (F.col("before") < F.col("item")) & within("content", "other", limit))
        near = {r.item: r.near for r in pairs.groupBy("item").agg(F.array_sort(F.collect_list("before")).alias("near")).collect()}  # numbers alone
        of = leaders(order, near)
        spark.createDataFrame(list(of.items()), schema).coalesce(1).write.mode("append").parquet(settled)
        if len(sized) < size and len(order) == len(sized):
            break
        rest = left.where(F.col("item") > order[-1])
        first = block.where(F.col("item").isin([k for k, v in of.items() if k == v])).select(F.col("item").alias("leader"), F.col("content").alias("lead"))
        joined = written(rest.join(F.broadcast(first), within("content", "lead", limit), "left").groupBy("item", "content").agg(F.min("leader").alias("leader")), "similar")
        joined.where("leader is not null").select("item", "leader").write.mode("append").parquet(settled)
        left = joined.where("leader is null").select("item", "content")
    return spark.read.schema(schema).parquet(settled) if sized or left is not items else spark.createDataFrame([], schema)


def similar(entries: DataFrame, limit: float, size: int = ROUND) -> Summary:
    """Clusters of entries within ``limit`` of their leader, as a share of the longer text's characters."""
    distinct = entries.groupBy("content").agg(F.min(F.struct("src", "idx")).alias("first"))
    items = written(distinct.orderBy("first").select(F.monotonically_increasing_id().alias("item"), "content"), "similar")  # rising in that order
    of = written(assign(items, limit, size), "similar")
    rows = entries.join(items, "content").join(of, "item").select("src", "idx", "content", "first_line", "line_numbers", F.col("leader").alias("key"))
    lead = items.select(F.col("item").alias("key"), F.col("content").alias("lead"))
    groups = rows.groupBy("key").agg(F.count("*").alias("count"), F.min(F.struct("src", "idx")).alias("first")).join(lead, "key")
    groups = groups.select("key", "count", "first", cluster_name(F.split("lead", "\n")[0]).alias("name"), F.col("lead").alias("pattern"))
    from .grouping import SAMPLES, _EMPTY_MAP, _firsts, _lone, _totals

    samples = _firsts(rows, SAMPLES).select("key", "pos", "content", F.slice("line_numbers", 1, 1).alias("line_numbers"), F.lit(None).cast(_EMPTY_MAP).alias("variable_values"))
    lone = _lone(rows, groups, entries)
    numbers = rows.select("key", F.explode("line_numbers").alias("number"))
    return Summary(GROUPED, "edit_distance_clustering", groups, lone, _totals(entries, "content", groups, samples, 8, lone), samples, line_ranges(numbers), prefix="cluster")


def cluster_name(line):
    """What stands between the first two ``]``, less the level words it begins with, or else the line; at most 60 characters."""
    after = F.get(F.split(line, "]", -1), 1)
    words = F.filter(F.split(after, r"(?U)\s+"), lambda w: w != "")
    level = lambda w: F.upper(w).isin("ERROR", "WARN", "INFO", "DEBUG", "TRACE")
    start = F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.struct((a["n"] + (a["on"] & level(w)).cast("int")).alias("n"), (a["on"] & level(w)).alias("on")), lambda a: a["n"])
    named = F.array_join(F.slice(words, start + 1, F.greatest(F.size(words), F.lit(1))), " ")
    return F.substring(F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(line), 1, 60)
