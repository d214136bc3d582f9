"""Reports by shape, budget, top and label, and whole runs over logs and documents of the usual kinds."""

import json
import random

import pytest

from patternlens import api, cli, render
from patternlens.operators.result import Summary
from patternlens.plans.options import Options
from patternlens.sources.text import Files


def report(groups=(), outliers=(), total=3, algorithm="template_extraction", **meta):
    return {"metadata": {"input_file": None, "total_entries": total, "algorithm": algorithm, "reduction_ratio": 0.5, **meta}, "summary": {"unique_patterns": len(groups), "outliers": len(outliers), "largest_cluster": 1}, "results": {"type": "grouped", "groups": list(groups), "outliers": list(outliers)}}


def group(name="Request", count=3, samples=(), ranges=((1, 3),), **more):
    return {"id": "group_0", "name": name, "pattern": "Request took <NUM> ms", "count": count, "percentage": 100.0, "samples": [{"content": s, "line_numbers": [1], "variable_values": v} for s, v in samples], "line_ranges": list(ranges), **more}


LONE = {"id": "outlier_0", "content": "ERROR Rare exception", "line_number": 3, "reason": "rare_pattern", "score": 0.25}


def test_grouped_report():
    text = render.to_markdown(report([group(samples=[("Request took 42 ms", {"var_0": ["42"], "var_1": ["a", "b"]})])], [LONE]))
    for part in ("3 entries → 1 group  (template_extraction)", "## Pattern Groups", "**Pattern**:", "Request took <NUM> ms", "100.0%", "**Sample entry**:", "Request took 42 ms", "**Variable values**:", "`42` (constant)", "## Outliers", "Rare patterns", "(Line 3)", "rare_pattern"):
        assert part in text
    assert "`b` (constant)" not in text and "[budget" not in text
    assert "## Outliers" not in render.to_markdown(report([group()]))
    clusters = render.to_markdown(report([group(samples=[("one", {}), ("two", {})])], algorithm="edit_distance_clustering"))
    assert "**Pattern**:" not in clusters and "*Sample 2*:" in clusters


def test_line_ranges_of_a_report():
    assert "**Line ranges**: 1-3, 10-11, 20" in (text := render.to_markdown(report([group(ranges=((1, 3), (10, 11), (20, 20)))]))) and "total lines" not in text
    text = render.to_markdown(report([group(ranges=tuple((k, k + 1) for k in (1, 10, 20, 30, 40)))]))
    assert "20-21" in text and "30-31" not in text and "… 10 total lines" in text


def test_budget_and_hint_of_a_report():
    assert "[budget: 21 lines]" in render.to_markdown(report([group()], budget_lines=21, budget_applied=True))
    assert "[budget" not in render.to_markdown(report([group()], budget_lines=500, budget_applied=False))
    assert "31 groups; consider adding `| top(20)`" in render.to_markdown(report([group()] * 31))
    assert "consider adding" not in render.to_markdown(report([group()] * 30))


def test_equal_samples_are_shown_once():
    text = render.to_markdown(report([group(count=100, samples=[("same", {})] * 3)]))
    assert text.count("same") == 1 and "(all 100 entries identical)" in text and "**Sample entries**:" not in text
    assert "(+ 1 more distinct)" in render.to_markdown(report([group(samples=[(str(i), {}) for i in range(4)])]))


def test_counts_with_commas():
    assert [render.format_count(n) for n in (0, 999, 1000, 1234567)] == ["0", "999", "1,000", "1,234,567"]


def test_outlier_schema_and_path_reports(spark):
    text = api.process(spark, "a b\n" * 30 + "x y z\n", Options(pipeline="outliers", outlier_threshold=0.5))
    for part in ("→ 1 outlier  (ngram_outlier_detection)", "- **Normal entries**: 30 (96.8%)", "`'a b' (30x)`", "user-specified", "1 entries with unusual patterns:", "x y z"):
        assert part in text
    docs = json.dumps([{"id": i, "name": "n"} for i in range(5)] + [{"odd": True}])
    text = api.process(spark, docs, Options("json", pipeline="schemas"))
    for part in ("6 entries → 2 schemas  (schema_clustering)", "### id, name (5 entries, 83.3%)", "{ id: number, name: string }", "**Sample values**:", "entries with unique schemas:", "(Entry 6)", "```json"):
        assert part in text
    text = api.process(spark, json.dumps({"a": [{"x": 1}, {"x": 2}], "b": {"x": 3}}), Options("json"))
    for part in ("## Subtree Patterns", "### Pattern pattern_0 (3 objects", "**Appears at**:", "## Singletons", "unique_schema at $"):
        assert part in text
    assert "No repeated structural patterns found." in api.process(spark, '{"a": 1}', Options("json"))


def test_top_label_and_budget_as_users_write_them(spark):
    log = "".join(f"{w} {i}\n" for w, n in (("get", 5), ("put", 4), ("post", 3), ("del", 2)) for i in range(n)) + "lone words here\n"
    whole = api.process_to_output(spark, log)
    assert [g["count"] for g in whole["results"]["groups"]] == [5, 4, 3, 2, 1] and "budget_applied" not in whole["metadata"]
    assert [g["count"] for g in api.process_to_output(spark, log, Options(pipeline="patterns | top(2)"))["results"]["groups"]] == [5, 4]
    out = api.process_to_output(spark, log, Options(budget=40))
    assert len(out["results"]["groups"]) == 2 and out["metadata"]["budget_lines"] == 40 and out["metadata"]["budget_applied"] and "[budget: 40 lines]" in render.to_markdown(out)
    assert api.process_to_output(spark, log, Options(budget=10_000))["metadata"]["budget_applied"] is False
    docs = json.dumps([{"kind": "b", "x": 1}, {"kind": "a", "x": 2}])
    assert api.process_to_output(spark, docs, Options("json", pipeline="schemas | label(.kind)"))["results"]["schemas"][0]["name"] == "a"
    assert api.process_to_output(spark, docs, Options("json", pipeline="group_by(.kind) | top(1)"))["results"]["groups"][0]["name"] == "a"
    with pytest.raises(ValueError, match="more than a report"):
        api.summarize(spark, log).collect(most=3)
    assert isinstance(api.summarize(spark, log).top(1), Summary)


def test_cost_preview_warns_of_a_single_root(spark):
    big = json.dumps({"rows": [{f"k{i}_{j}": "v" * 50 for j in range(4)} for i in range(400)]})
    preview = api.cost_preview(spark, big, Options("json"))
    assert preview.warning and "without a path selector" in api.cost_preview_formatted(spark, big, Options("json"))


def kinds(seed=42):
    """Inputs of the usual kinds: (format, pipeline, text)."""
    rng = random.Random(seed)
    ip = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))
    web = "".join(f'{ip()} - - [2024-01-{1 + i % 28:02d} 10:00:{i % 60:02d}] "GET /item/{rng.randrange(900)} HTTP/1.1" {rng.choice([200, 200, 404])} {rng.randrange(9999)}\n' for i in range(300))
    app = "".join(f"2024-01-01 10:00:{i % 60:02d} {rng.choice(['INFO', 'WARN', 'ERROR'])} worker {rng.randrange(9)} {rng.choice(['started', 'done in ' + str(rng.randrange(99)) + 'ms'])}\n" for i in range(300))
    noisy = "".join(f"[{rng.choice(['a', 'b'])}] {rng.choice(['connection lost to host', 'cache miss for key', 'retry of job'])} {rng.randrange(10**6)}\n" for i in range(60))
    stack = "".join(f"2024-01-01 10:00:{i:02d} ERROR boom {i}\n  at a.b(C.java:{i})\n  at d.e(F.java:{i})\n" for i in range(30))
    kind = lambda i: [{"type": "user", "data": {"user_id": i, "email": "e", "plan": "p"}, "meta": {}}, {"type": "order", "data": {"order_id": i, "amount": 1.5, "items": []}, "meta": {}}, {"type": "error", "data": {"code": i, "message": "m", "stack": "s"}, "meta": {}}][i % 3]
    records = json.dumps([kind(i) for i in range(90)])
    user = lambda i: {"id": i, "name": f"n{i}", "email": "e"}
    order = lambda i: {"order_id": i, "amount": 2, "status": "s", "category": "c"}
    document = json.dumps({"users": [user(i) for i in range(9)], "team": {"members": [user(i) for i in range(3)]}, "config": {"owner": user(0)}, "orders": [order(i) for i in range(7)], "archive": [order(i) for i in range(2)]})
    return {"web": ("line", None, web), "app": ("line", None, app), "noisy": ("line", "similar(0.8)", noisy), "multiline": ("block", None, stack), "records": ("json", "schemas", records), "document": ("json", "subtree", document)}


@pytest.mark.parametrize("kind", ["web", "app", "noisy", "multiline", "records", "document"])
def test_whole_runs_from_files(spark, tmp_path, kind):
    form, pipeline, text = kinds()[kind]
    f = tmp_path / f"{kind}.txt"
    f.write_bytes(text.replace("\n", "\r\n").encode() if kind == "app" else text.encode())
    assert cli.main([*([pipeline] if pipeline else []), str(f), "--format", form, "--output-format", "json", "-o", str(tmp_path / "out.json")], spark) == 0
    out = json.loads((tmp_path / "out.json").read_text())
    own = api.process_to_output(spark, text, Options(form, pipeline=pipeline), f.name)
    assert out == json.loads(json.dumps(own)) and 0 < out["metadata"]["reduction_ratio"] < 2 and out["metadata"]["input_file"] == f.name
    r = out["results"]
    if kind in ("web", "app"):
        assert out["metadata"]["total_entries"] == 300 and out["metadata"]["algorithm"] == "template_extraction" and sum(g["count"] for g in r["groups"]) == 300
    if kind == "noisy":
        assert out["metadata"]["algorithm"] == "edit_distance_clustering" and sum(g["count"] for g in r["groups"]) == 60
    if kind == "multiline":
        assert out["metadata"]["total_entries"] == 30
    if kind == "records":
        assert len(r["schemas"]) >= 3
        assert len(api.process_to_output(spark, text, Options(form, pipeline="schemas", depth=0))["results"]["schemas"]) == 1
    if kind == "document":
        assert {"$[*].users[*]", "$[*].team.members[*]", "$[*].config.owner"} <= {p for x in r["patterns"] for p in x["paths"]} and any(len(x["paths"]) >= 3 for x in r["patterns"]) and any(len(x["paths"]) == 2 for x in r["patterns"])


def test_files_in_splits(spark, tmp_path):
    """Lines of several files, each cut into splits, have the numbers they have in the file."""
    for k in range(3):
        (tmp_path / f"f{k}.log").write_text("".join(f"{k} line {i}\n" if i % 7 else "\n" for i in range(1, 400)) + "last without an end")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        rows = api.text_entries(spark, Files((str(tmp_path),)), Options("line")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(k, i - 1): f"{k} line {i}" if i % 7 else "" for k in range(3) for i in range(1, 400)} | {(k, 399): "last without an end" for k in range(3)}
    assert {(r.src, r.idx): r.content for r in rows} == want and len(rows) == len(want)


def test_blocks_over_segments(spark, monkeypatch):
    from patternlens.sources import text

    raw = [(0, "head\n" + "".join(f"2024-01-01 10:00:00 a{i}\n more\n  of it\n" for i in range(20))), (1, "2024-01-01 10:00:00 only\nx\ny"), (2, "no stamps\nat all")]
    docs = spark.createDataFrame(raw, "src long, raw string")
    one = sorted(map(repr, text.blocks(docs).collect()))
    monkeypatch.setattr(text, "SEGMENT", 4)
    assert sorted(map(repr, text.blocks(docs).collect())) == one and len(one) == 21 + 1 + 2
