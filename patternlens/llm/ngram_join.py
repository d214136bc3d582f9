"""An exact Jaccard self-join on word shingles: the grouped prefix join.

Shingles are put into one order, frequent ones last. Two sets can only reach the threshold if
their prefixes in that order meet, so prefixes are joined, and documents of one size and
prefix stand in the join as one group. Group pairs that meet are filtered by size and place,
expanded into their different sets, and verified on whole sets.

Only components are asked for, so links that cannot change them are not looked for: first
each group meets one other, the one that is least in most of its shared prefix shingles, then
in a few rounds one drawn anew from those in other components; what is then still in different
components and shares enough prefix shingles is compared in full. No link
between different components is missed, and thousands of near copies cost about one comparison
each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, mix64, slices, settle, small_batches, stash, unstash, utf8, word_hashes, words
from .graph import components
from .vectors import grouped

SHINGLE, PERCENT = 5, 80
#: Rounds of single partners before the rest is compared in full.
ROUNDS = 2
#: Classes apart that share a shingle from which on each shingle draws a partner of its own.
CROWD = 32
#: Classes in a block of a crowd.
BLOCK = 512
#: Counters that approximate how often a shingle occurs; they set the order and nothing else.
COUNTER_BITS, CHUNKS = 20, 64
#: Bits of a posting that hold the set's size; the other 39 hold its group. Groups that share a
#: number only share candidates, and sizes beyond the bits only pass the size filter.
N_BITS = 24
_U = np.uint64


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The rising distinct shingle hashes of each text; a text of fewer than k words is one shingle."""
    folded = lower_ascii(data)
    start, end, row = words(offsets, folded)
    h, n = word_hashes(folded, start, end), len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        acc = np.full(max(0, len(h) - k + 1), k, _U)
        for j in range(k):
            acc = mix64(acc * _U(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
        out = [np.unique(acc[a : a + c - k + 1]) if c >= k else None for a, c in zip(first.tolist(), count.tolist(), strict=True)]
        for i in np.flatnonzero(count < k).tolist():
            c = int(count[i])
            one = np.full(1, c, _U)
            for j in range(c):
                one = mix64(one * _U(0x9E3779B97F4A7C15) + h[first[i] + j : first[i] + j + 1])
            out[i] = one if c else np.zeros(0, _U)
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _counters(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """How many shingles fall to each counter, in 256 steps; of one size whatever the table's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            offsets, data = utf8(batch.column(0))
            for lo, hi in slices(offsets, 1 << 20):
                sets = shingle_sets(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]], k)
                slots = (np.concatenate(sets) >> _U(64 - COUNTER_BITS)).astype(np.int64)
                total += np.bincount(slots, minlength=len(total))
        if total.any():
            yield pa.record_batch([pa.array(range(CHUNKS), pa.int32()), pa.array([x.astype("<u4" if x.max(initial=0) < 1 << 32 else "<u8").tobytes() for x in np.split(total, CHUNKS)], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        size = (1 << COUNTER_BITS) // CHUNKS
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[i] = totals.get(i, np.zeros(size, np.int64)) + np.frombuffer(raw, f"<u{len(raw) // size}").astype(np.int64)
        if totals:
            steps = [np.minimum(255, np.log2(x + 1.0) * 6).astype(np.uint8).tobytes() for x in totals.values()]
            yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array(steps, pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    with small_batches(docs.sparkSession):
        rows = docs.select(text_col).mapInArrow(count, schema).repartition(CHUNKS, "chunk").mapInArrow(add, schema).collect()  # CHUNKS rows of a fixed size
    out = np.zeros((CHUNKS, (1 << COUNTER_BITS) // CHUNKS), np.uint8)
    for r in rows:
        out[r.chunk] = np.frombuffer(r.counts, np.uint8)
    return out.ravel()


def _signatures(docs: DataFrame, id_col: str, text_col: str, counters: np.ndarray, k: int, percent: int) -> DataFrame:
    """(id, n, cls, grp, prefix): size and digest of each set, and its prefix and group."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for lo, hi in slices(offsets, 1 << 20):
                n, cls, grp, prefix = [], [], [], []
                for s in shingle_sets(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]], k):
                    key = (counters[(s >> _U(64 - COUNTER_BITS)).astype(np.int64)].astype(_U) << _U(56)) | (s >> _U(8))
                    p = prefix_length(len(s), percent)
                    head = np.sort(np.partition(key, p - 1)[:p] if p and p < len(key) else key[:p] if p == len(key) else np.sort(key)[:p])
                    n.append(len(s))
                    cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    grp.append(int.from_bytes(hashlib.blake2b(head.tobytes() + len(s).to_bytes(8, "little"), digest_size=8).digest(), "little") >> 25 if len(s) else None)
                    prefix.append(head.view(np.int64))
                flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(flat, pa.int64()))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(grp, pa.int64()), lists], names=["id", "n", "cls", "grp", "prefix"])

    with small_batches(docs.sparkSession):
        return stash(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, "id long, n long, cls binary, grp long, prefix array<long>"), "shingle-signatures")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs of classes (a, b) whose sets reach the threshold."""

    @F.arrow_udf("boolean")
    def reach(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            at = np.searchsorted(p, q)
            at[at == len(p)] = 0
            both = int((p[at] == q).sum()) if len(p) else 0
            out.append(100 * both >= percent * (len(p) + len(q) - both) and both > 0)
        return pa.array(out, pa.bool_())

    left, right = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(reach("sa", "sb")).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(cls, shingles): the whole set of each of these classes, from one document that has it."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for lo, hi in slices(offsets, 1 << 20):
                kept: tuple[list, list] = ([], [])
                for s, cls in zip(shingle_sets(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]], k), batch.column(0).slice(lo, hi - lo).to_pylist(), strict=True):
                    if cls != last and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == cls:
                        last = cls  # rows of a class follow one another
                        kept[0].append(cls)
                        kept[1].append(s.tobytes())
                yield pa.record_batch([pa.array(c, pa.binary()) for c in kept], names=["cls", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(members.select("cls", "rep"), F.col("id").eqNullSafe(F.col("rep")))
    with small_batches(docs.sparkSession):
        return stash(texts.select("cls", "text", "id").sortWithinPartitions("id", "cls").select("cls", "text").mapInArrow(build, "cls binary, shingles binary"), "shingle-sets")


def _crowded_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes with different labels that share enough of the shingles ``own``, out of (token, cls, label, n, own, crowds).

    Each pair is looked at where the first crowded shingle that it shares is the token, so it comes
    once however many it shares; a crowd is dealt out in blocks, and no task holds more than two.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, lo, hi), part in grouped(batches, 3):
            side, cls, label = np.array(part.column(3).to_pylist()), part.column(4).to_pylist(), part.column(5).to_pylist()
            n = np.array(part.column(6).to_pylist(), np.int64)
            lists = part.column(7).combine_chunks()
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(cls)), lengths)
            names, column, often = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
            crowded = np.isin(names, part.column(8).combine_chunks().flatten().to_numpy(zero_copy_only=False))
            both = np.zeros((len(cls), len(cls)), np.float32)
            earlier = np.zeros_like(both)
            use = np.flatnonzero(often > 1)
            for at in range(0, len(use), 4_096):
                pick = use[at : at + 4_096]
                place = np.full(len(names), -1)
                place[pick] = np.arange(len(pick))
                ok = place[column] >= 0
                has = np.zeros((len(cls), len(pick)), np.float32)
                has[row[ok], place[column[ok]]] = 1
                both += has @ has.T
                has = has[:, (names[pick] < token) & crowded[pick]]
                earlier += has @ has.T
            _, mark = np.unique(np.array(label, object), return_inverse=True)
            larger, total = np.maximum(n[:, None], n[None, :]), n[:, None] + n[None, :]
            needed = -(-percent * total // (100 + percent)) - (-(-percent * larger // 100) - 1)
            fits = (mark[:, None] != mark[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * larger) & (both >= needed) & (earlier == 0)
            if lo != hi:
                fits &= (side[:, None] == lo) & (side[None, :] == hi)
            x, y = np.nonzero(np.triu(fits, 1) if lo == hi else fits)
            yield pa.record_batch([pa.array([cls[i] for i in x], pa.binary()), pa.array([cls[i] for i in y], pa.binary())], names=["a", "b"])

    sizes = rows.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "token").withColumn("side", F.pmod(F.xxhash64("cls"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["token", "lo", "hi"]
    dealt = dealt.select("token", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "cls", "label", "n", "own", "crowds")
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for every row.

    A text's set is its distinct ``shingle``-word shingles, a shorter text's its whole sequence of
    words; null texts and texts without words have the empty set and link with nothing. Rows link
    when 100 * |intersection| >= ``percent`` * |union|. ``component_id`` is the smallest id that
    links reach, the row's own included. Equal rows link; rows that share an id but not a text are
    rows of their own; a null id never is the smallest, and alone gives null. An empty table gives
    none. Only id and text are read. Nothing is capped: every pair that may join two components
    is verified.
    """
    signed = _signatures(docs, id_col, text_col, _counters(docs, text_col, shingle), shingle, percent)
    some = signed.where("n > 0")
    members = stash(some.groupBy("cls").agg(F.min("id").alias("rep"), F.first("grp").alias("grp"), F.first("n").alias("n")), "shingle-classes")
    by_token = Window.partitionBy("token")
    posted = some.select(F.explode("prefix").alias("token"), F.shiftleft("grp", N_BITS).bitwiseOR(F.least("n", F.lit((1 << N_BITS) - 1))).alias("post"))
    ends = posted.withColumn("low", F.min("post").over(by_token)).withColumn("high", F.max("post").over(by_token)).where("low <> high")
    n_of, grp_of = (lambda c: F.col(c).bitwiseAND(F.lit((1 << N_BITS) - 1))), (lambda c: F.shiftright(c, N_BITS))
    shared = stash(ends.select("token", grp_of("post").alias("grp"), n_of("post").alias("n"), grp_of("low").alias("least"), n_of("low").alias("least_n")).distinct(), "shared-shingles")
    slim = stash(signed.select("id", "n", "cls"), "shingle-sizes")
    unstash(signed)
    close = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    cls = members.select("cls", "grp", "n")
    settle(docs.sparkSession)

    # A pair at the threshold shares at least so many prefix shingles: what its sets must share,
    # less what the larger set has outside its prefix.
    larger, total = F.greatest("n", "m"), F.col("n") + F.col("m")
    needed = F.ceil(percent * total / (100 + percent)) - (F.ceil(percent * larger / 100) - 1)
    close = (100 * F.least("n", "m") >= percent * larger) & (F.col("count") >= needed)
    sets_of = lambda pairs: _sets(docs, members.join(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct(), "cls", "left_semi"), id_col, text_col, shingle)

    # first round: each group against the group that is least in most of its shared shingles
    stars = shared.where(F.col("grp") != F.col("least")).groupBy("grp", "n", "least", F.col("least_n").alias("m")).count().where(close)
    stars = stars.groupBy("grp").agg(F.max(F.struct("count", "least")).alias("best")).select(F.col("grp").alias("ga"), F.col("best.least").alias("gb"))
    least_class = cls.groupBy("grp").agg(F.min("cls").alias("b"))
    between = stars.join(cls.select(F.col("cls").alias("a"), F.col("grp").alias("ga")), "ga").join(least_class.withColumnRenamed("grp", "gb"), "gb").select("a", "b")
    within = cls.join(least_class, "grp").select(F.col("cls").alias("a"), "b")
    ordered = lambda pairs: pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stash(ordered(between.unionByName(within)), "shingle-pairs")
    crowds = shared.groupBy("token").count().where(F.col("count") >= CROWD).select("token")
    in_crowds = cls.join(shared.join(crowds, "token", "left_semi").select("grp").distinct(), "grp", "left_semi").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    sets = sets_of(pairs.unionByName(in_crowds))
    settle(docs.sparkSession)
    found = components(_verify(pairs, sets, percent))

    # further rounds: each class still apart from others of its prefix shingles against one of those, another each time
    several = cls.groupBy("grp").count().where("count > 1").select("grp")
    mixed = lambda p: p.withColumn("x", F.min("label").over(by_token)).withColumn("y", F.max("label").over(by_token)).where("x <> y").drop("x", "y")
    for turn in range(ROUNDS + 1):
        placed = stash(members.join(found, F.col("cls") == F.col("node"), "left").select("cls", "grp", "n", F.coalesce("label", "cls").alias("label")), "shingle-labels")
        apart = stash(mixed(shared.select("token", "grp").join(placed, "grp").select("token", "cls", "label", "n")), "open-shingles")
        if turn == ROUNDS:
            break
        sized = apart.withColumn("crowd", F.count("*").over(by_token) >= CROWD)
        drawn = F.struct(F.xxhash64(F.col("cls"), F.lit(turn), F.when(F.col("crowd"), F.col("token"))).alias("h"), "label", F.col("cls").alias("b"), F.col("n").alias("m"))
        ends = sized.withColumn("low", F.min(drawn).over(by_token)).withColumn("high", F.max(drawn).over(by_token))
        other = F.when(F.col("low.label") != F.col("label"), F.col("low")).when(F.col("high.label") != F.col("label"), F.col("high"))
        met_one = ends.withColumn("other", other).where("other is not null").select("cls", "n", "crowd", F.col("other.b").alias("b"), F.col("other.m").alias("m"))
        crowded = met_one.where(F.col("crowd") & (100 * F.least("n", "m") >= percent * larger)).select(F.col("cls").alias("a"), "b")
        near = met_one.where(~F.col("crowd")).groupBy("cls", "n", "b", "m").count().where(close)
        best = near.groupBy("cls").agg(F.max(F.struct("count", "b")).alias("best")).select(F.col("cls").alias("a"), F.col("best.b").alias("b"))
        more = stash(_verify(ordered(best.unionByName(crowded)), sets, percent), "shingle-links")
        if more.isEmpty():
            break
        settle(docs.sparkSession)
        found = components(found.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more))
    unstash(sets)

    # last round: what still lies in different components and shares enough prefix shingles or a group, in full
    inner = placed.join(several, "grp", "left_semi").select(F.col("grp").alias("token"), "cls", "label", "n")

    def met(posts: DataFrame) -> DataFrame:
        x, y = posts.alias("x"), posts.alias("y")
        apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.label") != F.col("y.label"))
        sized = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
        return x.join(y, apart & sized).groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).count()

    flagged = stash(apart.withColumn("crowd", F.count("*").over(by_token) >= CROWD), "open-shingles")
    in_crowd = flagged.where("crowd").drop("crowd")
    tokens_of = shared.select("token", "grp").join(placed.join(in_crowd.select("cls").distinct(), "cls", "left_semi").select("cls", "grp"), "grp")
    tokens_of = tokens_of.join(in_crowd.select("token", F.lit(True).alias("crowd")).distinct(), "token", "left").groupBy("cls").agg(F.collect_list("token").alias("own"), F.collect_list(F.when(F.col("crowd"), F.col("token"))).alias("crowds"))
    rest = met(flagged.where("not crowd").drop("crowd")).where(close).select("a", "b").unionByName(met(mixed(inner)).select("a", "b"))
    rest = rest.unionByName(_crowded_pairs(in_crowd.join(tokens_of, "cls"), percent))
    rest = stash(ordered(rest).join(pairs, ["a", "b"], "left_anti"), "shingle-pairs")
    if not rest.isEmpty():
        settle(docs.sparkSession)
        more = stash(_verify(rest, sets_of(rest), percent), "shingle-links")
        found = components(found.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more))
    whole = members.join(found, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("label", "cls").alias("label"))
    least = whole.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = whole.join(least, "label").select("cls", "component_id")
    return (
        slim.join(named, "cls", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    )


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest, each once; texts without words all stay.

    Rows that share both id and text are one row; rows that share an id alone are kept or dropped
    together; a null id is an id like others, and stays if no component has a smaller one. Has the
    columns of ``docs``, whatever their names.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("kept_id")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.md5(text_col).alias("text_md5"))
    one = rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id"))).dropDuplicates(["own_id", "text_md5"])
    return one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
