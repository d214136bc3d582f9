"""Reports as JSON and Markdown."""

from __future__ import annotations

import json
from dataclasses import asdict

from .operators.profile import CostPreview, Discovery, pipeline_selector
from .operators.result import GROUPED, ITEMS, OUTLIERS, PATHS, SCHEMAS, LineRanges

#: Marks and limits of the reports.
MANY_GROUPS, MOST_SAMPLES, MOST_RANGES = 30, 3, 3
NOUNS = {GROUPED: "group", SCHEMAS: "schema", PATHS: "pattern", OUTLIERS: "outlier"}


def format_count(n: int) -> str:
    return f"{n:,}"


def to_json(output) -> str:
    data = output if isinstance(output, dict) else {k: v for k, v in asdict(output).items() if k not in ("suggestion", "warning") or v is not None}
    return json.dumps(data, indent=2, ensure_ascii=False, default=list)  # of what is no plain data, line ranges alone are left


def _fenced(text: str, kind: str = "") -> list[str]:
    return [f"```{kind}", text, "```"]


def _coded(values) -> str:
    return ", ".join(f"`{v}`" for v in values)


def to_markdown(output: dict) -> str:
    meta, results = output["metadata"], output["results"]
    shape = results["type"]
    n = len(results["outliers"] if shape == OUTLIERS else results[ITEMS[shape]])
    noun = NOUNS[shape] + ("" if n == 1 else "s")
    budget = f"  [budget: {meta['budget_lines']} lines]" if meta.get("budget_applied") and meta.get("budget_lines") is not None else ""
    total = meta["total_entries"]
    lines = ["# patternlens output", "", f"{format_count(total)} {'entry' if total == 1 else 'entries'} → {n} {noun}  ({meta['algorithm']}){budget}", ""]
    if shape != OUTLIERS and n > MANY_GROUPS:
        lines += [f"> {n} groups; consider adding `| top(20)` to your pipeline", ""]
    lines += {GROUPED: _grouped, OUTLIERS: _outliers, SCHEMAS: _schemas, PATHS: _paths}[shape](results, meta["algorithm"])
    return "\n".join(lines) + "\n"


def _samples(samples: list[dict], count: int) -> list[str]:
    distinct = list({s["content"]: s for s in reversed(samples)}.values())[::-1]
    distinct = sorted(distinct, key=lambda s: [x["content"] for x in samples].index(s["content"]))
    if len(distinct) == 1:
        out = ["**Sample entry**:", *_fenced(distinct[0]["content"])]
        if len(samples) > 1:
            out.append(f"  (all {count} entries identical)")
        if distinct[0]["variable_values"]:
            out += ["", "**Variable values**:"]
            out += [f"- `{name}`: {_coded(v)}" + (" (constant)" if len(v) == 1 else "") for name, v in sorted(distinct[0]["variable_values"].items(), key=lambda x: (len(x[0]), x[0]))]
        return out
    out = ["**Sample entries**:", ""]
    for i, s in enumerate(distinct[:MOST_SAMPLES], 1):
        out += [f"*Sample {i}*:", *_fenced(s["content"]), ""]
    if len(distinct) > MOST_SAMPLES:
        out.append(f"  (+ {len(distinct) - MOST_SAMPLES} more distinct)")
    return out


def _lone(outliers: list[dict], noun: str = "Line", kind: str = "", score: bool = True) -> list[str]:
    out = []
    for o in outliers:
        out += [f"### {o['id']} ({noun} {o['line_number']})", "", f"- **Reason**: {o['reason']}", *([f"- **Score**: {o['score']:.6f}"] if score else []), "", *_fenced(o["content"], kind), ""]
    return out


def _grouped(r: dict, algorithm: str) -> list[str]:
    out = ["## Pattern Groups", ""]
    for g in r["groups"]:
        out += [f"### {g['name']} ({g['count']} entries, {g['percentage']:.1f}%)", ""]
        if algorithm != "edit_distance_clustering":
            out += ["**Pattern**:", *_fenced(g["pattern"]), ""]
        if g["line_ranges"]:
            ranges = g["line_ranges"]
            head = ranges[: MOST_RANGES + 1]
            shown = ", ".join(str(a) if a == b else f"{a}-{b}" for a, b in head[:MOST_RANGES])
            total = lambda r: r.lines() if isinstance(r, LineRanges) else sum(b - a + 1 for a, b in r)
            more = f"  (… {total(ranges)} total lines)" if len(head) > MOST_RANGES else ""
            out += [f"**Line ranges**: {shown}{more}", ""]
        if g["samples"]:
            out += _samples(g["samples"], g["count"])
        out.append("")
    if r["outliers"]:
        out += ["## Outliers", "", "Rare patterns that appear only once:", "", *_lone(r["outliers"])]
    return out


def _outliers(r: dict, algorithm: str) -> list[str]:
    b = r["baseline"]
    t, s = b["threshold"], b["threshold"]["score_stats"]
    out = ["## Baseline", "", b["description"], "", f"- **Normal entries**: {b['normal_count']} ({b['normal_percentage']:.1f}%)"]
    if b["common_features"]:
        out += ["", "**Common features**:", *(f"- `{f}`" for f in b["common_features"])]
    origin = "auto-detected for bottom ~5%" if t["auto_detected"] else "user-specified"
    out += ["", "**Outlier detection**:", f"- Threshold: {t['value']:.6f} ({origin})", f"- Score range: {s['min']:.6f} to {s['max']:.6f} (mean: {s['mean']:.6f}, median: {s['median']:.6f})", "", "## Outliers", ""]
    if not r["outliers"]:
        return [*out, "No outliers detected.", ""]
    return [*out, f"{len(r['outliers'])} entries with unusual patterns:", "", *_lone(r["outliers"])]


def _values(values: dict) -> list[str]:
    if not values:
        return []
    return ["**Sample values**:", *(f"- `{k}`: {_coded(v)}" for k, v in sorted(values.items()) if v), ""]


def _schemas(r: dict, algorithm: str) -> list[str]:
    out = ["## Schema Groups", ""]
    for g in r["schemas"]:
        out += [f"### {g['name']} ({g['count']} entries, {g['percentage']:.1f}%)", "", "**Schema**:", *_fenced(g["schema_description"]), "", *_values(g["sample_values"])]
    if r["outliers"]:
        out += ["## Outliers", "", f"{len(r['outliers'])} entries with unique schemas:", "", *_lone(r["outliers"], "Entry", "json", score=False)]
    return out


def _paths(r: dict, algorithm: str) -> list[str]:
    out = ["## Subtree Patterns", ""]
    if not r["patterns"]:
        out += ["No repeated structural patterns found.", ""]
    for g in r["patterns"]:
        out += [f"### Pattern {g['id']} ({g['count']} objects, {g['percentage']:.1f}%)", "", "**Schema**:", *_fenced(g["schema_description"]), "", "**Appears at**:", *(f"- `{p}`" for p in g["paths"]), "", *_values(g["sample_values"])]
    if r["singletons"]:
        out += ["## Singletons", "", "Objects with a unique schema (appeared only once):", "", *(f"- **{s['id']}**: {s['reason']}" for s in r["singletons"]), ""]
    return out


def _wide(text: str, width: int) -> str:
    return text + " " * max(0, width - len(text.encode()))


def discovery_markdown(d: Discovery) -> str:
    paths = [f["path"] for f in d.fields]
    selector = pipeline_selector(paths) if d.format == "json" else None
    note = "  (root object — use path selector below)" if d.entry_count == 1 and selector else ""
    out = [f"Format: {d.format}  |  Entries: {d.entry_count}{note}"]
    if not d.fields:
        return "\n".join([*out, "No fields found.", ""])
    kinds = [", ".join(f["types"]) for f in d.fields]
    wide, kind_wide = max(4, *(len(p.encode()) for p in paths)), max(5, *map(len, kinds))
    out += [f"{_wide('Path', wide)}  {_wide('Types', kind_wide)}  {'Cardinality':>11}  Samples", "-" * (wide + kind_wide + 30)]
    for f, kind in zip(d.fields, kinds, strict=True):
        shown = ", ".join(f'"{s}"' for s in f["samples"]) + (", …" if f["samples"] and f["cardinality"] > len(f["samples"]) else "")
        out.append(f"{_wide(f['path'], wide)}  {_wide(kind, kind_wide)}  {f['cardinality']:>11}  {shown}")
    if d.format == "json":
        out += ["", f"Pipeline selector: {selector or '(top-level array — no path selection needed; use verbs directly)'}"]
    return "\n".join(out) + "\n"


def cost_markdown(c: CostPreview) -> str:
    out = [f"⚠  {c.warning}", ""] if c.warning else []
    out += [f"Estimated output: ~{c.estimated_tokens} tokens", "─" * 40]
    if not c.fields:
        out.append("No fields found.")
    else:
        wide = max(4, *(len(f["path"].encode()) for f in c.fields))
        for f in c.fields:
            note = f"  ← {f['note']}" if f["note"] else "  ← noise candidate" if f["pct"] > 20 else ""
            out.append(f"{_wide(f['path'], wide)}  {f['tokens']:>6} tokens  ({f['pct']:>3.0f}%){note}")
    if c.suggestion:
        out.append(f"Suggested: {c.suggestion}")
    return "\n".join(out) + "\n"


def formatted(output, name: str) -> str:
    if name == "json":
        return to_json(output)
    if name == "markdown":
        return to_markdown(output) if isinstance(output, dict) else discovery_markdown(output) if isinstance(output, Discovery) else cost_markdown(output)
    raise ValueError(f"Unknown format: {name}. Use 'json' or 'markdown'")
