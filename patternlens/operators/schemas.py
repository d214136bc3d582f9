"""Schema clustering and recurring subtrees of JSON entries.

Entries are read once: a task sums up by signature what it has read, and everything else comes out
of the written sums. Only the different signatures, few whatever the number of entries, come to the
driver, which lets each join the first cluster it is similar enough to.
Equal signatures have similarity 1, so this is the sequential definition for thresholds up to 1.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions import jsontext
from ..tables import written
from .result import PATHS, SCHEMAS, Summary

#: Different signatures that the driver takes; more is an error, as no summary of them would help.
MOST_SIGNATURES = 50_000

#: Values of a field that a summary shows.
SHOWN = 5

#: Signatures, and bytes of values and paths, that a task holds before it passes its sums on.
HELD, HELD_BYTES = 10_000, 32 << 20


def signature(value: dict, depth: int) -> dict:
    """Field names to a type name, or to [type name, signature] where a nested object is described too."""
    out = {}
    for name, v in value.items():
        kind = jsontext.kind(v, boolean="bool")
        inner = v if isinstance(v, dict) else next((x for x in v if isinstance(x, dict)), None) if isinstance(v, list) else None
        out[name] = [kind, signature(inner, depth - 1)] if depth > 0 and inner is not None else kind
    return out


def similarity(a: dict, b: dict) -> float:
    """The mean over all fields of either: 1 for equal types, nested similarity where both are described, else 0."""
    names = sorted(a.keys() | b.keys())
    if not names:
        return 1.0
    total = 0.0
    for n in names:
        if n in a and n in b:
            x, y = a[n], b[n]
            kinds = [z[0] if isinstance(z, list) else z for z in (x, y)]
            if kinds[0] == kinds[1]:
                total += similarity(x[1], y[1]) if isinstance(x, list) and isinstance(y, list) else 1.0
    return total / len(names)


def description(sig: dict) -> str:
    return "{ " + ", ".join(f"{n}: {description(t[1]) if isinstance(t, list) else t}" for n, t in sorted(sig.items())) + " }"


def field_differences(a: dict, b: dict) -> tuple[list[str], list[str]]:
    """(fields of ``a`` alone, fields of ``b`` alone)."""
    return sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys())


def first_fit(signatures: list[tuple[str, int]], threshold: float) -> list[tuple[str, int, str]]:
    """(signature, cluster, representative) of signatures in order of first entry; clusters are numbered by theirs."""
    found: list[tuple[str, dict]] = []
    out = []
    for text, _ in signatures:
        sig = jsontext.loads(text)
        for k, (rep, other) in enumerate(found):
            if similarity(other, sig) >= threshold:
                out.append((text, k, rep))
                break
        else:
            out.append((text, len(found), text))
            found.append((text, sig))
    return out


def _shown(v) -> str:
    t = jsontext.scalar_text(v)
    return t if t is not None else "[...]" if isinstance(v, list) else "{...}"


class _Signatures:
    """Signatures as text; kept by names and types where nothing nested is described."""

    def __init__(self, depth: int):
        self.depth, self.kept = depth, {}

    def __call__(self, value: dict) -> str:
        types = tuple(map(type, value.values()))
        if self.depth > 0 and (dict in types or list in types):
            return jsontext.dumps(signature(value, self.depth))
        shape = (tuple(value), types)
        if (text := self.kept.get(shape)) is None:
            if len(self.kept) >= HELD:
                self.kept.clear()
            text = self.kept[shape] = jsontext.dumps(signature(value, self.depth))
        return text


def short_sample(v) -> str:
    """A value in a sample: long strings cut at 150 bytes on a character's edge, short arrays of whole numbers shown."""
    if isinstance(v, str):
        raw = v.encode()
        return v if len(raw) <= 150 else raw[:150].decode(errors="ignore") + "…"
    if isinstance(v, list):
        whole = len(v) <= 8 and all(isinstance(x, int) and not isinstance(x, bool) and x < 1 << 63 for x in v)
        return "[" + ", ".join(map(str, v)) + "]" if whole else "[...]"
    return "{...}" if isinstance(v, dict) else jsontext.scalar_text(v)


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


_TEXTS = pa.list_(pa.string())


def _summed(entries: DataFrame, depth: int) -> DataFrame:
    """(sig, n, size, src, idx, j, fields): of the entries of a signature that a task has read, or of those that are no objects (null).

    How many and how long they are, the first one's place, ``j`` if it is the only one, and of each
    field the smallest different values, up to SHOWN. A task may give several rows of one signature.
    """
    ship(entries.sparkSession)
    names = ["sig", "n", "size", "src", "idx", "j", "fields"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("field", pa.string()), ("own", _TEXTS)])))

    def batch_of(found: dict) -> pa.RecordBatch:
        rows = [(sig, n, size, *first, text if n == 1 else None, [{"field": k, "own": v} for k, v in own.items()]) for sig, (n, size, first, text, own) in found.items()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed, found, held = _Signatures(depth), {}, 0
        for batch in batches:
            for src, idx, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value, place = jsontext.loads(text), (src, idx)
                sig = signed(value) if isinstance(value, dict) else None
                row = found.get(sig)
                if row is None:
                    row = found[sig] = [0, 0, place, text, {}]
                    held += len(text) + 200
                row[0] += 1
                row[1] += _size(text)
                if place < row[2]:
                    row[2] = place
                if sig is None:
                    continue
                fields = row[4]
                for name, v in value.items():
                    t = _shown(v)
                    own = fields.get(name)
                    if own is None:
                        fields[name] = [t]
                        held += len(t) + 100
                    elif (len(own) < SHOWN or t < own[-1]) and t not in own:
                        insort(own, t)
                        held += len(t)
                        if len(own) > SHOWN:
                            held -= len(own.pop())
                if len(found) > HELD or held > HELD_BYTES:
                    yield batch_of(found)
                    found, held = {}, 0
        if found:
            yield batch_of(found)

    return entries.select("src", "idx", "j").mapInArrow(read, "sig string, n long, size long, src long, idx long, j string, fields array<struct<field:string,own:array<string>>>")


def _members(entries: DataFrame, depth: int, of: DataFrame) -> DataFrame:
    """(key, src, idx) of the entries that are objects."""

    @F.arrow_udf("string")
    def sign(column: pa.Array) -> pa.Array:
        signed = _Signatures(depth)
        values = map(jsontext.loads, column.to_pylist())
        return pa.array([signed(v) if isinstance(v, dict) else None for v in values], pa.string())

    return entries.select("src", "idx", sign("j").alias("sig")).join(F.broadcast(of), "sig").select("key", "src", "idx")


def signature_counts(entries: DataFrame, depth: int = 1) -> DataFrame:
    """(sig, n): how many entries have each signature, given as JSON text."""
    return _summed(entries, depth).where("sig is not null").groupBy("sig").agg(F.sum("n").alias("n"))


def clusters(signed: DataFrame, threshold: float, order: tuple[str, ...]) -> DataFrame:
    """(sig, key, rep): the cluster of each signature, small and broadcast where it is joined."""
    firsts = signed.groupBy("sig").agg(F.min(F.struct(*order)).alias("first"))
    rows = firsts.orderBy("first").limit(MOST_SIGNATURES + 1).collect()
    if len(rows) > MOST_SIGNATURES:
        raise ValueError(f"more than {MOST_SIGNATURES} different schemas: select a path or delete fields first")
    return signed.sparkSession.createDataFrame(first_fit([(r.sig, 0) for r in rows], threshold), "sig string, key long, rep string")


def _described(groups: DataFrame) -> DataFrame:
    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([description(jsontext.loads(x)) for x in column.to_pylist()], pa.string())

    @F.arrow_udf("array<string>")
    def names(column: pa.Array) -> pa.Array:
        return pa.array([sorted(jsontext.loads(x)) for x in column.to_pylist()], pa.list_(pa.string()))

    return groups.withColumn("description", text("rep")).withColumn("fields", names("rep"))


def _five(values: DataFrame) -> DataFrame:
    """The five smallest different values of each field of each cluster."""
    return values.groupBy("key", "field").agg(F.slice(F.array_sort(F.collect_set("value")), 1, SHOWN).alias("own")).select("key", "field", F.explode("own").alias("value"))


def _first_five(values: DataFrame, *order: str) -> DataFrame:
    from pyspark.sql import Window

    return values.withColumn("turn", F.row_number().over(Window.partitionBy("key", "field").orderBy(*order))).where("turn <= 5").select("key", "field", "value").distinct()


def _pretty(column):
    @F.arrow_udf("string")
    def pretty(c: pa.Array) -> pa.Array:
        return pa.array([jsontext.dumps(jsontext.loads(x), 2) for x in c.to_pylist()], pa.string())

    return pretty(column)


def _bytes(column) -> object:
    return F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long")


def schemas(entries: DataFrame, threshold: float = 0.8, depth: int = 1) -> Summary:
    """Clusters of objects by schema; entries that are no objects count in the total alone.

    A cluster of one entry is a group and an outlier. Which entries a cluster has is the
    relation ``extra["members"]`` (key, src, idx): it may be as long as the input.
    """
    summed = written(_summed(entries, depth), "schemas")
    signed = summed.where("sig is not null")
    of = clusters(signed, threshold, ("src", "idx"))
    rows = signed.join(F.broadcast(of), "sig")  # at most MOST_SIGNATURES rows
    groups = _described(rows.groupBy("key", "rep").agg(F.sum("n").alias("count"), F.min(F.struct("src", "idx")).alias("first")))
    values = _five(rows.select("key", F.explode("fields").alias("f")).select("key", "f.field", F.explode("f.own").alias("value")))
    single = rows.join(groups.where("count = 1").select("key"), "key")
    lone = single.select(F.struct("src", "idx").alias("first"), _pretty(F.col("j")).alias("content"), (F.col("idx") + 1).alias("line_number"), F.lit("unique_schema").alias("reason"), F.lit(0.0).alias("score"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    totals = (
        summed.agg(total("n").alias("total_entries"), total("size").alias("original_size"))
        .crossJoin(groups.agg(F.count("*").alias("unique_patterns"), F.coalesce(F.max("count"), F.lit(0)).alias("largest_cluster"), _bytes("description").alias("a")))
        .crossJoin(values.agg(_bytes("value").alias("b")))
        .crossJoin(lone.agg(F.count("*").alias("outliers"), _bytes("content").alias("c")))
        .withColumn("reduced_size", F.col("a") + F.col("b") + F.col("c"))
    )
    return Summary(SCHEMAS, "schema_clustering", groups, lone, totals, values=values, prefix="schema", extra={"members": _members(entries, depth, of)})


def _objects(entries: DataFrame) -> DataFrame:
    """(sig, n, size, src, idx, ord, j, paths, heads): of the objects of a signature, at any depth, that a task has read.

    How many there are, the first one's place, ``j`` if it is the only one, the paths they stand at, and
    the first ones with their fields, up to SHOWN. Paths start at ``$[*]``, as entries are taken for
    elements of one array; ``ord``, the place in a walk from the top, sorts like the walk visits. A row
    without ``sig`` has the number and the size of the entries.
    """
    ship(entries.sparkSession)
    names = ["sig", "n", "size", "src", "idx", "ord", "j", "paths", "heads"]
    long, kind = pa.int64(), pa.list_(pa.struct([("field", pa.string()), ("value", pa.string())]))
    kinds = (pa.string(), long, long, long, long, long, pa.string(), _TEXTS, pa.list_(pa.struct([("src", long), ("idx", long), ("ord", long), ("fields", kind)])))

    def batch_of(found: dict, n: int, size: int) -> pa.RecordBatch:
        rows = [(None, n, size, None, None, None, None, [], [])]
        for sig, (count, paths, heads, value) in found.items():
            shown = [{"src": s, "idx": i, "ord": o, "fields": f} for (s, i, o), f in heads]
            rows.append((sig, count, 0, *heads[0][0], jsontext.dumps(value) if count == 1 else None, sorted(paths), shown))
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed, found, n, size, held = _Signatures(0), {}, 0, 0, 0
        for batch in batches:
            for src, idx, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                size += _size(text)
                value = jsontext.loads(text)
                place, stack = 0, [("$[*]", value)]
                while stack:
                    path, v = stack.pop()
                    if isinstance(v, list):
                        path += "[*]"
                        stack.extend((path, x) for x in reversed(v) if isinstance(x, (dict, list)))
                        continue
                    if not isinstance(v, dict):
                        continue
                    sig, at = signed(v), (src, idx, place)
                    place += 1
                    row = found.get(sig)
                    if row is None:
                        row = found[sig] = [0, set(), [], v]
                        held += len(text) + 200
                    row[0] += 1
                    if row[0] == 2:
                        row[3] = None
                    if path not in row[1]:
                        row[1].add(path)
                        held += len(path) + 100
                    heads = row[2]
                    if len(heads) < SHOWN or at < heads[-1][0]:
                        fields = [{"field": k, "value": short_sample(v[k])} for k in sorted(v)]
                        insort(heads, (at, fields), key=lambda h: h[0])
                        held += 300 * len(fields) if len(heads) <= SHOWN else 0
                        del heads[SHOWN:]
                    inner = sorted(k for k, x in v.items() if isinstance(x, (dict, list)))
                    stack.extend((f"{path}.{k}", v[k]) for k in reversed(inner))
                if len(found) > HELD or held > HELD_BYTES:
                    yield batch_of(found, n, size)
                    found, n, size, held = {}, 0, 0, 0
        if n:
            yield batch_of(found, n, size)

    return entries.select("src", "idx", "j").mapInArrow(walk, "sig string, n long, size long, src long, idx long, ord long, j string, paths array<string>, heads array<struct<src:long,idx:long,ord:long,fields:array<struct<field:string,value:string>>>>")


def subtree(entries: DataFrame, threshold: float = 0.8) -> Summary:
    """Object shapes that occur more than once, wherever they stand; the others are singletons."""
    summed = written(_objects(entries), "objects")
    found = summed.where("sig is not null")
    of = clusters(found, threshold, ("src", "idx", "ord"))
    rows = found.join(F.broadcast(of), "sig")  # at most MOST_SIGNATURES rows
    placed = rows.groupBy("key").agg(F.sum("n").alias("count"), F.min(F.struct("src", "idx", "ord")).alias("first"))
    paths = rows.select("key", F.explode("paths").alias("path")).groupBy("key").agg(F.collect_set("path").alias("paths"))
    grouped = placed.join(paths, "key").join(F.broadcast(of.select("key", "rep").distinct()), "key").select("key", "rep", "count", "first", "paths")
    groups = _described(grouped.where("count > 1"))
    kept = groups.select("key", "fields")
    heads = rows.select("key", F.explode("heads").alias("h")).select("key", "h.src", "h.idx", "h.ord", F.explode("h.fields").alias("f"))
    each = heads.select("key", "src", "idx", "ord", "f.field", "f.value")
    named = each.join(kept.select("key", F.explode("fields").alias("field")), ["key", "field"])
    values = _first_five(named, "src", "idx", "ord")
    single = rows.join(grouped.where("count = 1").select("key"), "key")
    lone = single.select(F.struct("src", "idx", "ord").alias("first"), _pretty(F.col("j")).alias("content"), F.lit(0).cast("long").alias("line_number"), F.concat(F.lit("unique_schema at "), F.col("paths")[0]).alias("reason"), F.lit(0.0).alias("score"))
    counted = groups.agg(F.count("*").alias("unique_patterns"), F.coalesce(F.max("count"), F.lit(0)).alias("largest_cluster"), F.coalesce(F.sum("count"), F.lit(0)).alias("in_groups"), _bytes("description").alias("a"), F.coalesce(F.sum(F.aggregate("paths", F.lit(0), lambda n, p: n + F.octet_length(p))), F.lit(0)).alias("b"))
    totals = (
        summed.where("sig is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
        .crossJoin(counted)
        .crossJoin(values.agg(_bytes("value").alias("c")))
        .crossJoin(lone.agg(F.count("*").alias("outliers"), _bytes("reason").alias("d")))
        .select(
            (F.col("in_groups") + F.col("outliers")).alias("total_entries"), "unique_patterns", "outliers", "largest_cluster",
            (F.col("size") + F.greatest(F.col("n") + 1, F.lit(2))).alias("original_size"), (F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("reduced_size"),
        )
    )
    return Summary(PATHS, "subtree", groups, lone, totals, values=values, prefix="pattern", outlier_prefix="singleton")
