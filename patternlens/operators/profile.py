"""Profiles: what fields there are, and which of them a report would spend its length on."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions import jsontext
from ..functions import tokens as T
from ..functions.text import truncated
from ..tables import written
from .result import GROUPED, OUTLIERS, PATHS, SCHEMAS, Summary

#: Different values counted, values shown.
MOST_VALUES, SHOWN = 10_000, 5
PSEUDO = re.compile(r"\(.*\)\Z", re.S)


def _summed(seen: DataFrame, presence) -> DataFrame:
    """(path, types, cardinality, samples, present_in_pct) of (path, type, value, order)."""
    values = seen.groupBy("path", "value").agg(F.min("order").alias("order"))
    first = values.withColumn("turn", F.row_number().over(Window.partitionBy("path").orderBy("order"))).where(F.col("turn") <= SHOWN)
    samples = first.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "value"))), lambda x: x["value"]).alias("samples"))
    kinds = seen.groupBy("path").agg(F.array_sort(F.collect_set("type")).alias("types"), F.count("*").alias("n"))
    distinct = values.groupBy("path").agg(F.least(F.count("*"), F.lit(MOST_VALUES)).alias("cardinality"))
    return presence(kinds.join(distinct, "path").join(samples, "path")).select("path", "types", "cardinality", "samples", "present_in_pct")


def discover_text(entries: DataFrame) -> DataFrame:
    """A row for each slot: the n-th token of first lines that is neither blank nor punctuation."""
    seen = entries.select("src", "idx", F.posexplode(T.slots(F.col("first_line"))).alias("slot", "t"))
    seen = seen.select(F.concat(F.lit("slot["), F.col("slot").cast("string"), F.lit("]")).alias("path"), F.col("t.kind").alias("type"), truncated(F.col("t.text")).alias("value"), F.struct("src", "idx").alias("order"))
    total = entries.agg(F.count("*").alias("total"))
    return _summed(seen, lambda d: d.crossJoin(total).withColumn("present_in_pct", (F.col("n").cast("float") / F.col("total").cast("float")).cast("float")))


def leaves(entries: DataFrame, root: str = "$[*]") -> DataFrame:
    """(path, type, value, order, size): a row for each scalar, and one with ``size`` for each array."""
    ship(entries.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for src, idx, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place, stack = 0, [(root, jsontext.loads(text))]
                while stack:
                    path, v = stack.pop()
                    if isinstance(v, dict):
                        stack.extend((f"{path}.{n}", v[n]) for n in sorted(v, reverse=True))
                        continue
                    if isinstance(v, list):
                        out.append((src, idx, place, f"{path}[*]", None, None, len(v)))
                        stack.extend((f"{path}[*]", x) for x in reversed(v))
                    else:
                        t = jsontext.scalar_text(v)
                        out.append((src, idx, place, path, jsontext.kind(v), t[:100] + "…" if len(t) > 100 else t, None))
                    place += 1
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["src", "idx", "ord", "path", "type", "value", "size"])

    found = entries.select("src", "idx", "j").mapInArrow(walk, "src long, idx long, ord long, path string, type string, value string, size long")
    return found.select("path", "type", "value", F.struct("src", "idx", "ord").alias("order"), "size")


def discover_json(entries: DataFrame, root: str = "$[*]") -> DataFrame:
    """A row for each path to scalars; presence is the share of the elements of the nearest array that have it."""
    found = leaves(entries, root)
    arrays = found.where("size is not null").groupBy(F.col("path").alias("nearest")).agg(F.sum("size").alias("elements"))
    if root.endswith("[*]"):
        arrays = arrays.unionByName(entries.agg(F.lit(root).alias("nearest"), F.count("*").alias("elements")))

    def presence(d: DataFrame) -> DataFrame:
        d = d.withColumn("nearest", F.regexp_extract("path", r"^(.*\[\*\])", 1)).join(arrays, "nearest", "left")
        share = F.least(F.col("n").cast("float") / F.col("elements").cast("float"), F.lit(1.0).cast("float"))
        return d.withColumn("present_in_pct", F.when(F.col("elements") > 0, share).otherwise(F.lit(1.0)).cast("float"))

    return _summed(found.where("size is null"), presence)


@dataclass(frozen=True)
class Discovery:
    format: str
    entry_count: int
    fields: list[dict]


def pipeline_selector(paths: list[str]) -> str | None:
    """The path stage that reaches the outermost array, or None if that is the input itself."""
    arrays = {p[: p.rindex("[*]") + 3] for p in paths if "[*]" in p}
    if not arrays:
        return None
    best = min(arrays, key=lambda p: (len(p.encode()), p))
    return None if best == "$[*]" else best.removeprefix("$").replace("[*]", "[]")


def collect_discovery(fields: DataFrame, kind: str, count: int) -> Discovery:
    rows = [r.asDict() for r in fields.collect()]
    slot = lambda p: int(p[5:-1]) if p.startswith("slot[") else 0
    return Discovery(kind, count, sorted(rows, key=lambda r: (slot(r["path"]) if kind != "json" else 0, r["path"])))


def cost_buckets(s: Summary) -> DataFrame:
    """(path, chars, note): bytes that each field of a report takes."""
    size = F.octet_length
    total = lambda df, path, column: df.agg(F.coalesce(F.sum(size(column)), F.lit(0)).cast("long").alias("chars"), F.count("*").alias("n")).where("n > 0").select(F.lit(path).alias("path"), "chars")
    some = lambda df: df.where("chars > 0")
    if s.shape == GROUPED:
        samples = written(s.samples.select("content", "variable_values"), "samples")  # looked at twice
        out = total(s.groups, "pattern", "pattern").unionByName(total(samples, "content", "content"))
        var = samples.select(F.explode("variable_values").alias("path", "own")).select("path", F.explode("own").alias("v")).groupBy("path").agg(F.sum(size("v")).cast("long").alias("chars"))
        out = out.unionByName(var).unionByName(some(total(s.outliers, "(outliers)", "content")))
    elif s.shape == SCHEMAS:
        out = s.values.groupBy(F.col("field").alias("path")).agg(F.sum(size("value")).cast("long").alias("chars")).unionByName(some(total(s.outliers, "(outliers)", "content")))
    elif s.shape == PATHS:
        top = s.groups.select("key", F.concat(F.array_min("paths"), F.lit(".")).alias("top"))
        full = s.values.join(top, "key").withColumn("path", F.concat("top", "field"))
        numeric = F.min(F.trim("value").rlike(r"^\[[0-9, ]*\]\z").cast("int"))
        per = full.groupBy("path", "key").agg(F.sum(size("value")).cast("long").alias("chars"), numeric.alias("numeric"))
        out = per.groupBy("path").agg(F.sum("chars").alias("chars"), F.when(F.max("numeric") == 1, "numeric offsets (visual noise)").alias("note"))
        return out.unionByName(some(total(s.outliers, "(singletons)", "content")).withColumn("note", F.lit(None).cast("string")))
    else:
        features = s.features.select(F.concat(F.lit("'"), F.col("ngram"), F.lit("' ("), F.col("n").cast("string"), F.lit("x)")).alias("f"))
        out = some(total(features, "common_features", "f")).unionByName(some(total(s.outliers, "content", "content")))
    return out.withColumn("note", F.lit(None).cast("string"))


def del_argument(path: str) -> str | None:
    """The field that ``del`` can remove for a path: up to the first array below the entry, as del enters none."""
    if not path.startswith("$[*]."):
        return None
    inner = path[5:].split("[*]")[0]
    return f".{inner}" if inner else None


@dataclass(frozen=True)
class CostPreview:
    estimated_tokens: int
    fields: list[dict]
    suggestion: str | None = None
    warning: str | None = None


def cost_preview(s: Summary) -> CostPreview:
    """How long a report without a budget would be, by field; the rows of :func:`cost_buckets` ranked."""
    rows = cost_buckets(s).collect()
    total = sum(r.chars for r in rows)
    tokens = (total + 3) // 4
    share = lambda n: float(np.float32(n) / np.float32(total)) if total else 0.0
    lone = sum(r.chars for r in rows if r.path == "(singletons)")
    single_root = tokens > 10_000 and share(lone) > 0.9
    fields = [{"path": r.path, "tokens": (r.chars + 3) // 4, "pct": float(np.float32(share(r.chars)) * np.float32(100)), "note": r.note} for r in rows]
    fields.sort(key=lambda f: (-f["tokens"], f["path"]))
    suggestion = None
    if s.shape in (SCHEMAS, PATHS) and not single_root:
        noise = [f for f in fields if f["pct"] > 20 and not (f["path"].startswith("(") and PSEUDO.match(f["path"]))]
        names = list(dict.fromkeys(a for f in noise if (a := del_argument(f["path"]))))
        if names:
            suggestion = f"del({', '.join(names)}) → ~{max(0, tokens - sum(f['tokens'] for f in noise))} tokens"
    warning = None
    if single_root:
        warning = "The root is a single JSON object: without a path selector this preview says little.\nDiscover the array field first, then preview '.ARRAY_FIELD[]'."
    return CostPreview(tokens, fields, suggestion, warning)


__all__ = ["OUTLIERS", "CostPreview", "Discovery", "collect_discovery", "cost_buckets", "cost_preview", "discover_json", "discover_text"]
