"""Exact top-k inner products over a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance to it; a range of distances is an
annulus. The index is a table sorted by pivot and annulus, and for each annulus the smallest and
largest distance of its rows to their own pivot and to a few reference pivots, and their largest
norm, are known. A query first searches the annuli around its own distance at its nearest pivots,
which gives a floor for its k-th score, and then expands the others in order, but for those that
cannot reach the floor. What rules an annulus out is the triangle inequality: with gap the least
distance that a row can have by any of these pivots, a score is at most (|q|^2 + |x|^2 - gap^2) / 2;
as a row is its pivot plus a residual no longer than the annulus' radius, it is also at most
<q, pivot> + |q| radius. Nothing is ruled out on an estimate.

Queries go in blocks of bounded size to where the index lies, once each, so no vector is shuffled
for the search: a task multiplies the rows of an annulus with the queries that are open for it.
Pivots, annuli and the fitting sample grow with the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stash, unstash
from .vectors import bytes_of, matrix, stacked, usable, width

#: Rows that an annulus aims at, annuli at most (the driver knows bounds of each), pivots at most, reference pivots.
ANNULUS, MOST_ANNULI, MOST_PIVOTS, REFERENCES = 1_024, 65_536, 1_024, 8
#: Vectors of the fitting sample for each pivot, and bytes of the sample and of a block of queries at most.
FITTED, SAMPLE_BYTES, QUERY_BYTES = 32, 16 << 20, 8 << 20
NO_ID, LEAST = (1 << 63) - 1, -(1 << 63)


def whole(rows: np.ndarray) -> np.ndarray:
    return np.floor(1024 * rows)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as longs: by doubles where these are exact, else by whole numbers; beyond a long, the nearest long."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if top < 1 << 53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def fit_pivots(rows: np.ndarray, pivots: int) -> np.ndarray:
    """Points far from one another, each moved to the mean of what is nearest to it."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    picked = [0]
    gap = _distances(rows, rows[:1])[:, 0]
    while len(picked) < min(pivots, len(rows)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(rows, rows[picked[-1:]])[:, 0])
    centre = rows[picked]
    for _ in range(4):
        near = _distances(rows, centre).argmin(1)
        centre = np.array([rows[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centre)])
    return centre


@dataclass
class Index:
    """Pivots, edges of the annuli of each, and what is known of each annulus (cell = pivot * annuli + place)."""

    pivots: np.ndarray
    edges: np.ndarray  # [pivots, annuli - 1]
    cells: np.ndarray | None = None  # rising
    low: np.ndarray | None = None  # [cells, 1 + references]: least and largest distance to the own pivot and to the references
    high: np.ndarray | None = None
    norm: np.ndarray | None = None

    @property
    def annuli(self) -> int:
        return self.edges.shape[1] + 1

    @property
    def references(self) -> np.ndarray:
        return self.pivots[:REFERENCES]

    def place(self, rows: np.ndarray, pivot: np.ndarray, gap: np.ndarray) -> np.ndarray:
        return pivot * self.annuli + (gap[:, None] > self.edges[pivot]).sum(1)

    def most(self, cell: int, query: np.ndarray, length: np.ndarray, own: np.ndarray, others: np.ndarray) -> np.ndarray:
        """No row of the cell scores more with these queries; raised by more than rounding can amount to.

        ``own`` and ``others`` are the queries' distances to the cell's pivot and to the references.
        """
        i = int(np.searchsorted(self.cells, cell))
        gap = np.concatenate([own[:, None], others], 1)
        gap = np.maximum(np.maximum(gap - self.high[i], self.low[i] - gap).max(1), 0)
        by_gap = (length**2 + self.norm[i] ** 2 - gap**2) / 2
        by_radius = query @ self.pivots[cell // self.annuli] + length * self.high[i, 0]
        slack = 1e-6 * (1 + (length + self.norm[i] + self.high[i].max()) ** 2)
        return np.minimum(np.minimum(by_gap, by_radius), length * self.norm[i]) + slack


def fit(sample: np.ndarray, n: int) -> Index:
    """Pivots by farthest points and a few rounds of means over the sample, annuli of each by quantiles of its own distances."""
    pivots = fit_pivots(sample, pivots_for(n))
    gaps = _distances(sample, pivots)
    near = gaps.argmin(1) if len(sample) else np.zeros(0, int)
    annuli = max(2, min(MOST_ANNULI // len(pivots), -(-n // (ANNULUS * len(pivots)))))
    steps = np.arange(1, annuli) / annuli
    return Index(pivots, np.array([np.quantile(gaps[near == i, i], steps) if (near == i).any() else np.zeros(annuli - 1) for i in range(len(pivots))]))


def pivots_for(n: int) -> int:
    return max(1, min(MOST_PIVOTS, math.ceil(math.sqrt(n) / 2)))


def search(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, seen: Accumulator | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each row whose id ``every`` divides.

    A score is the inner product of floor(1024 * x) of both vectors; ties go to the smaller id,
    null ids last. Candidates are all rows but those with the query's id; a query id on several
    rows is asked once, with the row that comes first by its vector's bytes. Vectors that are
    null, empty, or hold a null or non-finite component take no part; shorter ones count as
    followed by zeros. Fewer candidates than ``k`` give fewer rows, an empty table none. The
    pivots are fitted on a sample of FITTED vectors a pivot; every vector is indexed. ``seen``
    is added the number of (query, row) pairs that were multiplied.
    """
    dim = max(1, width(vectors, vec_col))
    with small_batches(vectors.sparkSession, rows=4_096):
        return _search(vectors, dim, id_col, vec_col, every, k, seen)


def _search(vectors: DataFrame, dim: int, id_col: str, vec_col: str, every: int, k: int, seen: Accumulator | None) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), bytes_of(whole(matrix(batch.column(1), dim)))], names=["id", "vec"])

    vec, spark = F.col(vec_col), vectors.sparkSession
    usable_rows = vectors.where(usable(vec)).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), vec.alias("vec"))
    rows = stash(usable_rows.mapInArrow(read, "id long, vec binary"), "search-vectors")
    n = rows.count()
    some = max(1, min(FITTED * pivots_for(n), SAMPLE_BYTES // (8 * dim)))
    sample = [r.vec for r in rows.orderBy(F.xxhash64("id"), "id", "vec").limit(some).select("vec").collect()]
    index = fit(np.frombuffer(b"".join(sample), np.float64).reshape(-1, dim), n)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = stacked(batch.column(1))
                gap = _distances(x, index.pivots)
                pivot = gap.argmin(1)
                own = gap[np.arange(len(gap)), pivot]
                yield pa.record_batch([pa.array(index.place(x, pivot, own), pa.int32()), pa.array(own), *batch.columns], names=["cell", "gap", "id", "vec"])

    keyed = rows.mapInArrow(key, "cell int, gap double, id long, vec binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = stash(keyed.repartitionByRange(parts, "cell", "gap", "id").sortWithinPartitions("cell", "gap", "id"), "search-index")
    _describe(table, index)
    asked = stash(rows.where((F.col("id") % every == 0) & (F.col("id") != NO_ID)).groupBy("id").agg(F.min("vec").alias("vec")), "search-queries")
    unstash(rows)
    blocks = max(1, -(-asked.count() * 8 * dim // (QUERY_BYTES // 2)))
    found = None
    for block in range(blocks):
        part = sorted(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect())  # QUERY_BYTES or so
        if part:
            more = _answer(table, index, np.array([r.id for r in part], np.int64), np.frombuffer(b"".join(r.vec for r in part), np.float64).reshape(-1, dim), k, seen)
            found = more if found is None else found.unionByName(more)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    return found.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def _describe(table: DataFrame, index: Index) -> None:
    """Fills in what is known of each cell."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = stacked(batch.column(2))
                gap = np.concatenate([batch.column(1).to_numpy()[:, None], _distances(x, index.references)], 1)
                cell, first = np.unique(batch.column(0).to_numpy(), return_index=True)
                columns = [np.minimum.reduceat(gap, first), np.maximum.reduceat(gap, first)]
                norm = np.maximum.reduceat(np.sqrt((x * x).sum(1)), first)
                yield pa.record_batch([pa.array(cell, pa.int32()), *(pa.array(c[:, j]) for c in columns for j in range(gap.shape[1])), pa.array(norm)], names=["cell", *names])

    m = 1 + len(index.references)
    names = [f"{side}{j}" for side in ("low", "high") for j in range(m)] + ["norm"]
    pick = [(F.min if c.startswith("low") else F.max)(c).alias(c) for c in names]
    each = table.select("cell", "gap", "vec").mapInArrow(bounds, "cell int, " + ", ".join(f"{c} double" for c in names))
    known = np.array(sorted(tuple(r) for r in each.groupBy("cell").agg(*pick).collect()), float).reshape(-1, 2 * m + 2)  # MOST_ANNULI rows at most
    index.cells, index.low, index.high, index.norm = known[:, 0].astype(np.int64), known[:, 1 : 1 + m], known[:, 1 + m : 1 + 2 * m], known[:, -1]


def _answer(table: DataFrame, index: Index, ids: np.ndarray, query: np.ndarray, k: int, seen: Accumulator | None) -> DataFrame:
    """(query_id, vec_id, score, rank) of a block of queries."""
    spark = table.sparkSession
    gaps = _distances(query, index.pivots)
    nearest = np.argsort(gaps, axis=1, kind="stable")[:, :2]
    # the annulus around the query's own distance, or the fullest next to it
    start = np.stack([index.place(query, p, gaps[np.arange(len(query)), p]) for p in nearest.T], 1)
    start = index.cells[np.minimum(np.searchsorted(index.cells, start), len(index.cells) - 1)]
    shared = spark.sparkContext.broadcast((ids, query, start))

    def scan(floors):
        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, query, start = shared.value
            floor = None if floors is None else floors.value
            length, others = np.sqrt((query * query).sum(1)), _distances(query, index.references)
            last, own, pairs = -1, None, 0
            for batch in batches:
                cells, names = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]]) if len(cells) else [0]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    cell = int(cells[lo])
                    first = (start == cell).any(1)
                    if floor is None:
                        open_ = np.flatnonzero(first)
                    else:
                        if cell // index.annuli != last:
                            last = cell // index.annuli
                            own = _distances(query, index.pivots[last : last + 1])[:, 0]
                        open_ = np.flatnonzero(~first & (index.most(cell, query, length, own, others) >= floor))
                    if not len(open_):
                        continue
                    x = stacked(batch.column(2).slice(lo, hi - lo))
                    pairs += len(open_) * len(x)
                    for at in range(0, len(open_), 512):
                        some = open_[at : at + 512]
                        yield best(ids[some], names[lo:hi], _products(query[some], x), k, None if floor is None else floor[some])
            if seen is not None:
                seen.add(pairs)

        return multiply

    schema = "query_id long, vec_id long, score long"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    slim = table.select("cell", "id", "vec")
    begun = stash(top(slim.where(F.col("cell").isin(np.unique(start).tolist())).mapInArrow(scan(None), schema)), "search-first")
    kth = {r.query_id: r.score for r in begun.where(F.col("rank") == k).select("query_id", "score").collect()}
    floor = np.array([float(kth.get(int(i), LEAST)) for i in ids])
    rest = slim.mapInArrow(scan(spark.sparkContext.broadcast(floor)), schema)
    return stash(top(begun.select("query_id", "vec_id", "score").unionByName(rest)), "search-found")


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, floor: np.ndarray | None) -> pa.RecordBatch:
    """The ``k`` first rows of each query by score and id, of those that reach the floor."""
    ok = ids[None, :] != query[:, None]
    if floor is not None:
        ok &= score >= floor[:, None]
    out: tuple = ([], [], [])
    for i in np.flatnonzero(ok.any(1)).tolist():
        at = np.flatnonzero(ok[i])
        at = at[np.lexsort((ids[at], -score[i, at].astype(object) if score[i].min() == LEAST else -score[i, at]))][:k]
        for column, values in zip(out, (np.full(len(at), query[i]), ids[at], score[i, at]), strict=True):
            column.append(values)
    return pa.record_batch([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names=["query_id", "vec_id", "score"])


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
