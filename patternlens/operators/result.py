"""What every analysis returns: relations that stay distributed until somebody collects them.

Groups are not numbered where they are made: a number needs all groups in one order. They carry
what orders them, ``count`` and the place of their first entry, and are numbered as the few
that are asked for are collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lines that parts of a report are reckoned to take.
FIXED, SECTION, GROUP, SCHEMA, PATTERN, OUTLIER, SINGLETON, BASELINE = 4, 2, 15, 12, 12, 9, 1, 15
GROUPED, OUTLIERS, SCHEMAS, PATHS = "grouped", "outlier_focused", "schema_grouped", "path_grouped"
ITEMS = {GROUPED: "groups", SCHEMAS: "schemas", PATHS: "patterns"}
#: shape: (lines of a group, extra lines before outliers, lines of an outlier)
COSTS = {GROUPED: (GROUP, 1, OUTLIER), SCHEMAS: (SCHEMA, 1, OUTLIER), PATHS: (PATTERN, 2, SINGLETON)}

#: Groups and outliers that a report without a budget may have.
MOST = 1_000_000

#: Entries of a report's groups up to which their line ranges are brought with it; those of more stay a relation.
HELD_RANGES = 100_000


def capacity(budget: int, used: int, cost: int) -> int:
    return max(0, budget - used) // cost


class LineRanges(Sequence):
    """All line ranges of a group in order, read from the executors as they are asked for: there may be as many as entries."""

    def __init__(self, ranges: DataFrame, key):
        self.rows = ranges.where(F.col("key").eqNullSafe(F.lit(key))).select("start", "end")

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return ((r["start"], r["end"]) for r in self.rows.orderBy("start", "end").toLocalIterator())

    def __len__(self) -> int:
        return self.rows.count()

    def __bool__(self) -> bool:
        return not self.rows.isEmpty()

    def __getitem__(self, i):
        if isinstance(i, slice) and i.step in (None, 1) and (i.start or 0) >= 0 and i.stop is not None and i.stop >= 0:
            skip = i.start or 0
            return [(r["start"], r["end"]) for r in self.rows.orderBy("start", "end").offset(skip).limit(max(0, i.stop - skip)).collect()]
        if isinstance(i, slice):
            return list(self)[i]
        place = i if i >= 0 else len(self) + i
        found = self[place : place + 1] if place >= 0 else []
        if not found:
            raise IndexError(i)
        return found[0]

    def lines(self) -> int:
        return self.rows.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0))).first()[0]


@dataclass(frozen=True)
class Summary:
    """``groups``: key, name, pattern, count, first and what the shape adds; ``outliers``: first, content, line_number, reason, score.

    ``samples`` (key, pos, content, line_numbers, variable_values), ``ranges`` (key, start, end)
    and ``values`` (key, field, value) belong to groups by key. ``totals`` is one row:
    total_entries, unique_patterns, outliers, largest_cluster, original_size, reduced_size.
    """

    shape: str
    algorithm: str
    groups: DataFrame | None
    outliers: DataFrame
    totals: DataFrame
    samples: DataFrame | None = None
    ranges: DataFrame | None = None
    values: DataFrame | None = None
    baseline: DataFrame | None = None
    features: DataFrame | None = None
    prefix: str = "group"
    outlier_prefix: str = "outlier"
    input_file: str | None = None
    budget: int | None = None
    limit: int | None = None
    label: str | None = None
    extra: dict = field(default_factory=dict)

    def with_budget(self, lines: int | None) -> Summary:
        return replace(self, budget=lines)

    def top(self, n: int) -> Summary:
        """At most ``n`` groups; what goes is dropped, not made an outlier."""
        return replace(self, limit=n)

    def relabel(self, field_name: str) -> Summary:
        return replace(self, label=field_name)

    def ordered_groups(self) -> DataFrame:
        return self.groups.orderBy(F.desc("count"), *self.extra.get("order", ("first",)))

    def collect(self, most: int = MOST) -> dict:
        """The analysis as plain data; the driver holds the groups and outliers that budget and top leave.

        Groups of over HELD_RANGES entries have their line ranges as :class:`LineRanges`, of which the
        driver holds what is asked for.

        More than ``most`` of them are an error: a budget or top makes a report shorter, and the
        relations themselves have any number.
        """
        t = self.totals.first().asDict()
        groups = 0 if self.shape == OUTLIERS else t["unique_patterns"] if self.limit is None else min(self.limit, t["unique_patterns"])
        if self.budget is None and groups + t["outliers"] > most:
            raise ValueError(f"{groups} groups and {t['outliers']} outliers are more than a report of {most}: set a budget, or use the relations")
        applied: bool | None = None
        if self.shape == OUTLIERS:
            return self._collect_outliers(t)
        per_group, extra, per_outlier = COSTS[self.shape]
        n_groups, n_outliers = t["unique_patterns"], t["outliers"]
        if self.budget is not None:
            keep = min(n_groups, capacity(self.budget, FIXED + SECTION, per_group))
            keep_out = min(n_outliers, capacity(self.budget, FIXED + SECTION + keep * per_group + SECTION + extra, per_outlier))
            applied = keep < n_groups or keep_out < n_outliers
        else:
            keep, keep_out = n_groups, n_outliers
        if self.limit is not None and keep > self.limit:
            keep, applied = self.limit, True
        rows = self.ordered_groups().limit(keep).collect() if keep else []
        chosen = [r["key"] for r in rows]
        held = sum(r["count"] for r in rows) <= HELD_RANGES
        parts = {name: self._of(getattr(self, name), chosen) for name in ("samples", "values")} | {"ranges": self._of(self.ranges, chosen) if held else None}
        items = [self._item(i, r.asDict(True), t["total_entries"], parts) for i, r in enumerate(rows)]
        outliers = self.outliers.orderBy(*self.extra.get("outlier_order", ("first",))).limit(keep_out).collect() if keep_out else []
        named = [{"id": f"{self.outlier_prefix}_{i}", "content": r.content, "line_number": r.line_number, "reason": r.reason, "score": r.score} for i, r in enumerate(outliers)]
        singles = "singletons" if self.shape == PATHS else "outliers"
        return self._output(t, {"type": self.shape, ITEMS[self.shape]: items, singles: named}, applied)

    def _of(self, part: DataFrame | None, chosen: list) -> dict:
        out: dict = {}
        if part is None or not chosen:
            return out
        keys = part.sparkSession.createDataFrame([(k,) for k in chosen], f"key {part.schema['key'].dataType.simpleString()}")
        for r in part.join(keys, "key").collect():
            out.setdefault(r["key"], []).append(r)
        return out

    def _item(self, i: int, r: dict, total: int, parts: dict) -> dict:
        key, out = r["key"], {"id": f"{self.prefix}_{i}"}
        share = {"count": r["count"], "percentage": r["count"] / total * 100.0 if total else 0.0}
        if self.shape == GROUPED:
            samples = sorted(parts["samples"].get(key, []), key=lambda s: s["pos"])
            if parts["ranges"] is None:
                ranges = LineRanges(self.ranges, key) if self.ranges is not None else []
            else:
                ranges = sorted((x["start"], x["end"]) for x in parts["ranges"].get(key, []))
            return out | {"name": r["name"], "pattern": r["pattern"]} | share | {"samples": [{"content": s["content"], "line_numbers": list(s["line_numbers"] or []), "variable_values": {k: list(v) for k, v in sorted((s["variable_values"] or {}).items())}} for s in samples], "line_ranges": ranges}
        values: dict = {}
        for v in parts["values"].get(key, []):
            values.setdefault(v["field"], set()).add(v["value"])
        values = {k: sorted(x)[:5] for k, x in sorted(values.items())}
        first = values.get(self.label, [None])[0] if self.label else None
        fields = list(r["fields"])
        if self.shape == SCHEMAS:
            name = (f"Schema {i}" if not fields else ", ".join(fields) if len(fields) <= 3 else f"{', '.join(fields[:2])}, ... ({len(fields)} fields)") if first is None else first
            return out | {"name": name, "schema_description": r["description"], "fields": fields} | share | {"sample_values": values}
        return out | {"schema_description": r["description"] if first is None else first, "fields": fields} | share | {"paths": sorted(r["paths"]), "sample_values": values}

    def _collect_outliers(self, t: dict) -> dict:
        b = self.baseline.first()
        keep, applied = t["outliers"], None
        if self.budget is not None:
            keep = min(keep, capacity(self.budget, FIXED + SECTION + BASELINE + SECTION + 1, OUTLIER))
            applied = keep < t["outliers"]
        if self.limit is not None and keep > self.limit:
            keep, applied = self.limit, True
        rows = self.outliers.orderBy("score", "first").limit(keep).collect() if keep else []
        named = [{"id": f"outlier_{i}", "content": r.content, "line_number": r.line_number, "reason": r.reason, "score": r.score} for i, r in enumerate(rows)]
        features = [f"'{r.ngram}' ({r.n}x)" for r in self.features.collect()]
        normal = t["total_entries"] - t["outliers"]
        description = f"Most entries share common patterns. {t['total_entries']} entries analyzed."
        t = t | {"reduced_size": t["reduced_size"] + len(description.encode()) + sum(len(f.encode()) for f in features), "unique_patterns": 0, "largest_cluster": normal}
        baseline = {
            "description": description, "normal_count": normal, "normal_percentage": normal / t["total_entries"] * 100.0 if t["total_entries"] else 0.0, "common_features": features,
            "threshold": {"value": b.threshold, "auto_detected": b.auto_detected, "score_stats": {"min": b.min, "max": b.max, "mean": b.mean, "median": b.median}},
        }
        return self._output(t, {"type": self.shape, "baseline": baseline, "outliers": named}, applied)

    def _output(self, t: dict, results: dict, applied: bool | None) -> dict:
        meta = {"input_file": self.input_file, "total_entries": t["total_entries"], "algorithm": self.algorithm, "reduction_ratio": t["reduced_size"] / t["original_size"] if t["original_size"] else 0.0}
        if self.budget is not None:
            meta["budget_lines"] = self.budget
        if applied is not None:
            meta["budget_applied"] = applied
        return {"metadata": meta, "summary": {"unique_patterns": t["unique_patterns"], "outliers": t["outliers"], "largest_cluster": t["largest_cluster"] or 0}, "results": results}


def line_ranges(numbers: DataFrame) -> DataFrame:
    """(key, start, end) of the runs of consecutive numbers in (key, number), by gaps and islands."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("key").orderBy("number"))
    runs = numbers.withColumn("island", F.col("number") - place)
    return runs.groupBy("key", "island").agg(F.min("number").alias("start"), F.max("number").alias("end")).drop("island")
