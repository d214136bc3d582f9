"""Near-duplicate vectors by sorted projection passes, with an exact way for dense places.

Equal vectors are one class. In each pass a class has a key of 64 sign bits of random projections;
classes are sorted by it, and each is compared with the next WINDOW ones. Two vectors at an angle
share a bit with probability 1 - angle / pi, so a pair at the threshold shares the first k bits
with a known probability, and a class's window holds all that share k bits with it, for a k that
can be read off the keys at the window's two edges. The k that holds in three quarters of the
passes (not each pass's own, which is small just where a class was parted from its like) gives, for
each class, a bound on the chance that all passes missed a link of its. How many passes there are
follows from the number of classes and the recall asked for.

Classes in dense places, whose windows reach only to long shared prefixes, keep a bound that is too
high: those are compared with one another, all of them, in blocks. A link is missed only if both of
its ends are, at a chance of 1 - RECALL at most, in sparse places by the passes. Windows go by rank
over a whole pass, so neither partitions nor their edges change what is found.

Every link is verified in double precision; links of several passes count once, and components
unite all of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small_batches, stash, unstash
from .graph import components
from .vectors import grouped, matrix, stacked, usable, width

#: Neighbours on each side; chance that a link of a class in a sparse place is found; rows of a stretch of ranks.
WINDOW, RECALL, STRETCH = 64, 0.999, 4_096
#: Passes at most; what they do not settle is compared in full.
MOST_PASSES = 96
#: Rows and bytes of a block at most; blocks at least, as soon as they have LEAST rows each.
BLOCK, BLOCK_BYTES, SPREAD, LEAST = 65_536, 32 << 20, 8, 256
#: Shuffle partitions of block pairs at most.
MOST_TASKS = 4_096
_U = np.uint64


def same_bit(threshold: float) -> float:
    """The chance that a random projection has one sign for both of a pair at the threshold."""
    return 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi


def passes_for(n: int, threshold: float, recall: float = RECALL) -> int:
    """Passes after which a link in an evenly filled space of ``n`` classes is found at a chance of ``recall``, and half as many more."""
    depth = math.log2(n / WINDOW) + 1 if n > WINDOW else 0
    found = same_bit(threshold) ** depth
    return 1 if found >= recall else min(MOST_PASSES, math.ceil(1.5 * math.log(1 - recall) / math.log(1 - found)))


def keys_of(unit: np.ndarray, turn: int) -> np.ndarray:
    """The 64 sign bits of each row in a pass, first projection highest."""
    directions = np.random.default_rng([2, turn]).normal(size=(unit.shape[1], 64))
    return np.packbits(unit @ directions > 0, axis=1).view(">u8")[:, 0].astype(_U)


def common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that are alike."""
    x = a ^ b
    high, low = (x >> _U(32)).astype(np.float64), (x & _U(0xFFFFFFFF)).astype(np.float64)
    return 64 - np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])


def depths(keys: np.ndarray) -> np.ndarray:
    """For rows in order of their keys, the least k such that all rows that share k bits with a row lie in its window."""
    n, reach = len(keys), WINDOW + 1
    shared = np.full(n, -1)
    if n > reach:
        edge = common_bits(keys[reach:], keys[:-reach])
        shared[reach:] = edge
        shared[:-reach] = np.maximum(shared[:-reach], edge)
    return shared + 1


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=0) + 0.0
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _placed(classes: DataFrame, kind: type, turns: int) -> DataFrame:
    """(pass, rank, cls, depth): each class's place in each pass, and the bits that put another one into its window."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = units(stacked(batch.column(1), kind))
                for turn in range(turns):
                    key = (keys_of(unit, turn) ^ _U(1 << 63)).view(np.int64)  # signed, in the same order
                    yield pa.record_batch([pa.array(np.full(len(key), turn, np.int32)), pa.array(key), batch.column(0)], names=["pass", "key", "cls"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.record_batch([pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(seen, seen + batch.num_rows)), *batch.columns], names=["part", "at", "pass", "key", "cls"])
            seen += batch.num_rows

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (turn, stretch), rows in grouped(batches, 2):
            rank = rows.column(2).to_numpy()
            key = rows.column(3).to_numpy().view(_U) ^ _U(1 << 63)
            depth = depths(key)
            own = np.flatnonzero(rank // STRETCH == stretch)
            yield pa.record_batch([pa.array(np.full(len(own), turn, np.int32)), pa.array(rank[own]), rows.column(4).combine_chunks().take(pa.array(own)), pa.array(depth[own], pa.int32())], names=["pass", "rank", "cls", "depth"])

    keyed = classes.select("cls", "vec").mapInArrow(project, "pass int, key long, cls binary")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "key", "cls"]
    ordered = stash(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, "part int, at long, pass int, key long, cls binary"), "vector-keys")
    # a row for each pass and partition: where the pass starts in the partition, and how many rows of it come before
    firsts = ordered.groupBy("pass", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ordered.join(F.broadcast(firsts.withColumn("before", before).drop("n")), ["pass", "part"]).withColumn("rank", F.col("before") + F.col("at") - F.col("first"))
    reach = WINDOW + 1
    spread = F.array_compact(F.array(F.floor(F.col("rank") / STRETCH), F.when((F.col("rank") >= STRETCH) & (F.col("rank") % STRETCH < reach), F.floor(F.col("rank") / STRETCH) - 1), F.when(F.col("rank") % STRETCH >= STRETCH - reach, F.floor(F.col("rank") / STRETCH) + 1)))
    judged = ranked.select("pass", F.explode(spread).alias("stretch"), "rank", "key", "cls").repartition("pass", "stretch").sortWithinPartitions("pass", "stretch", "rank").mapInArrow(judge, "pass int, rank long, cls binary, depth int")
    out = stash(judged, "vector-ranks")
    unstash(ordered)
    return out


def _linked(placed: DataFrame, classes: DataFrame, kind: type, threshold: float) -> DataFrame:
    """(u, v), u < v: the different classes that windows hold and that link, but for two dense ones."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, stretch), rows in grouped(batches, 2):
            rank, dense = rows.column(2).to_numpy(), np.array(rows.column(3).to_pylist(), bool)
            cls, unit = rows.column(4).to_pylist(), units(stacked(rows.column(5), kind))
            own = int((rank // STRETCH == stretch).sum())
            for step in range(1, min(WINDOW, len(rank) - 1) + 1):
                n = min(own, len(rank) - step)
                cos = np.einsum("ij,ij->i", unit[:n], unit[step : n + step])
                hit = np.flatnonzero((cos >= threshold) & ~(dense[:n] & dense[step : n + step]))
                if len(hit):
                    ends = [sorted((cls[i], cls[i + step])) for i in hit.tolist()]
                    yield pa.record_batch([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], names=["u", "v"])

    rows = placed.join(classes.select("cls", "vec", "dense"), "cls")
    stretch = F.floor(F.col("rank") / STRETCH)
    spread = F.array_compact(F.array(stretch, F.when((F.col("rank") >= STRETCH) & (F.col("rank") % STRETCH < WINDOW), stretch - 1)))
    rows = rows.select("pass", F.explode(spread).alias("stretch"), "rank", "dense", "cls", "vec").repartition("pass", "stretch").sortWithinPartitions("pass", "stretch", "rank")
    return rows.mapInArrow(compare, "u binary, v binary").distinct()


def close_pairs(a: np.ndarray, b: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs of unit rows at a cosine of ``threshold`` or more, a tile at a time; without ``b``, pairs i < j of ``a``."""
    other = a if b is None else b
    short, short_other = a.astype(np.float32), other.astype(np.float32)
    slack, some = (a.shape[1] + 8) * 2.0**-23, max(1, (1 << 21) // max(1, a.shape[1]))
    for lo in range(0, len(a), 256):
        for at in range(lo if b is None else 0, len(other), 4096):
            cos = short[lo : lo + 256] @ short_other[at : at + 4096].T
            i, j = np.divmod(np.flatnonzero(cos.ravel() >= threshold - slack), cos.shape[1])
            near = cos[i, j].astype(np.float64)
            i, j = i + lo, j + at
            if b is None:
                ahead = i < j
                i, j, near = i[ahead], j[ahead], near[ahead]
            ok = near >= threshold + slack
            for part in np.array_split(np.flatnonzero(~ok), len(ok) // some + 1):
                ok[part] = np.einsum("ij,ij->i", a[i[part]], other[j[part]]) >= threshold
            if ok.any():
                yield i[ok], j[ok]


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the ends of links sorted by ``i``, in place."""
    cuts = np.flatnonzero(np.diff(i)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
        ends = np.append(j[lo:hi], i[lo])
        root = parent[ends]
        while not np.array_equal(up := parent[root], root):
            root = up
        parent[root] = parent[ends] = root.min()


def _compared(classes: DataFrame, n: int, dim: int, kind: type, threshold: float) -> DataFrame:
    """(cls, others, up) of ``n`` classes, every pair compared: how many rows of other classes a class links with in a pair of blocks, and a class it hangs under there.

    A task counts the links of its classes and sends on, of the links, a forest that connects the same classes.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, copies, unit = None, [], np.zeros(0, np.int64), np.zeros((0, dim))
        for (lo, hi, side), rows in grouped(batches, 3):
            own, own_copies, own_unit = rows.column(3).to_pylist(), np.array(rows.column(4).to_pylist(), np.int64), stacked(rows.column(5), kind)
            own_unit = units(own_unit)
            if side == 0:
                key, ids, copies, unit = (lo, hi), own, own_copies, own_unit
                if lo < hi:
                    continue
            elif key != (lo, hi):
                continue
            first = len(ids) if side else 0  # where the second side's classes are numbered from
            names, weight = (ids + own, np.concatenate([copies, own_copies])) if side else (ids, copies)
            parent, total = np.arange(len(names)), np.zeros(len(names), np.int64)
            for i, j in close_pairs(unit, own_unit if side else None, threshold):
                j = j + first
                np.add.at(total, i, weight[j])
                np.add.at(total, j, weight[i])
                _unite(parent, i, j)
            while (parent[parent] != parent).any():
                parent = parent[parent]
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([names[k] for k in at], pa.binary()), pa.array(total[at]), pa.array([names[k] for k in parent[at]], pa.binary())], names=["cls", "others", "up"])

    blocks = max(1, -(-n // max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, dim))))), min(SPREAD, -(-n // LEAST)))
    keys = ["lo", "hi", "side"]
    rows = classes.withColumn("own", F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "copies", "vec")
    return rows.repartition(min(MOST_TASKS, blocks * (blocks + 1) // 2), "lo", "hi").sortWithinPartitions(*keys).mapInArrow(compare, "cls binary, others long, up binary")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    A link is found at a chance of ``recall`` at least, and one between two vectors in dense
    places always; none below ``threshold`` counts, decided in double precision over all
    components. A shorter vector counts as followed by zeros. Vectors that are null, empty or
    zero, or hold a null or non-finite component, link with nothing and are their own component.
    Equal vectors link. Repeated rows count one by one; a null id is never the smallest of a
    component. An empty table gives none.
    """
    dim = max(1, width(vectors, vec_col))
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.array(batch.column(2).to_pylist(), bool)
            rows = np.zeros((batch.num_rows, dim))
            if ok.any():
                rows[ok] = matrix(batch.column(1).filter(pa.array(ok)), dim)
            top = np.abs(rows).max(axis=1, keepdims=True)
            ok &= top[:, 0] > 0
            alike = rows / np.where(top > 0, top, 1) + 0.0
            cls = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() if k else None for r, k in zip(alike, ok, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(cls, pa.binary()), pa.array([r.tobytes() if k else None for r, k in zip(rows.astype(kind), ok, strict=True)], pa.binary())], names=["id", "cls", "vec"])

    vec, spark = F.col(vec_col), vectors.sparkSession
    with small_batches(spark):
        rows = stash(vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), usable(vec).alias("ok")).mapInArrow(read, "id long, cls binary, vec binary"), "vectors")
        classes = stash(rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "vector-classes")
        slim = stash(rows.select("id", "cls"), "vector-ids")
        unstash(rows)
        turns = passes_for(classes.count(), threshold, recall)
        placed = _placed(classes, kind, turns)
        settle(spark)
        missed = F.pow(1 - F.pow(F.lit(same_bit(threshold)), F.percentile("depth", 0.75)), F.lit(turns))
        dense = placed.groupBy("cls").agg((missed > 1 - recall).alias("dense"))
        judged = stash(classes.join(dense, "cls").select("cls", "copies", "vec", "dense"), "judged-vectors")
        links = stash(_linked(placed, judged, kind, threshold), "vector-links")
        unstash(placed)
        settle(spark)
        crowd = judged.where("dense")
        compared = stash(_compared(crowd.select("cls", "copies", "vec"), crowd.count(), dim, kind, threshold), "dense-links")
        found = stash(components(compared.select(F.col("cls").alias("u"), F.col("up").alias("v")).unionByName(links)), "vector-components")
        copies = classes.select(F.col("cls").alias("v"), "copies")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        others = both.join(copies, "v").groupBy(F.col("u").alias("cls")).agg(F.sum("copies").alias("others")).unionByName(compared.select("cls", "others")).groupBy("cls").agg(F.sum("others").alias("others"))
    whole = classes.select("cls", "least", "copies").join(found, F.col("cls") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cls"))
    least = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    about = whole.join(least, "label").join(others, "cls", "left").select("cls", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = slim.join(stash(about, "vector-results"), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id) c USING (vec_id)
LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) n USING (vec_id)
"""
