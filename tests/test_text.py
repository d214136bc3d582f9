import random

import pytest
from pyspark.sql import functions as F

from patternlens import api, render
from patternlens.functions import tokens as T
from patternlens.operators import grouping, outliers, similar
from patternlens.plans.options import Options
from patternlens.sources import text as source

from . import oracle


def entries(spark, text):
    return source.lines(source.from_text(spark, text))


def run(spark, text, pipeline=None, **options):
    return api.process_to_output(spark, text, Options(pipeline=pipeline, **options))


PINS = ["[2024-01-15] INFO User login", "Request took 42 ms", "User abc123def456 logged in", "   ", "<NUM> and 5", "[2024-01-15 10:00:00] x12:34:56y", "2024-01-15T10:23:45.123Z ok", "10:00:00+00:00",
        "192.168.1.1 fe80::1 42ms 3.5s 100MB deadbeef DEADBEEF Mon monday -100 3.14", "a\tb", "(x){y};z", "d41d8cd98f00b204e9800998ecf8427e", "١٢ 5"]


def test_signatures_match_plain_python(spark):
    rows = spark.createDataFrame([(x,) for x in PINS], "line string").select("line", T.signature(F.col("line")).alias("s")).collect()
    for r in rows:
        want = oracle.signature(r.line)
        got = tuple(("v" if p[0] == "V" else "f", p[1:]) for p in r.s.split("\0")) if r.s else ()
        assert got == want, r.line


def test_lines(spark):
    rows = source.lines(source.from_text(spark, "a\r\n\nb\rc\nd")).orderBy("idx").collect()
    assert [(r.content, r.line_numbers) for r in rows] == [("a", [1]), ("", [2]), ("b\rc", [3]), ("d", [4])]
    assert source.lines(source.from_text(spark, "")).count() == 0 and source.lines(source.from_text(spark, "x\n")).count() == 1


@pytest.mark.parametrize("pattern,text,want", [
    (None, "2024-01-15 10:00:00 a\n  x\n  y\n2024-01-15 10:00:01 b", [3, 1]), (None, "a\nb\nc\nd", [1, 1, 1, 1]), ("^X", "p\nX1\nq\nX2", [1, 2, 1]), ("^X", "X1\nq\nr", [1, 1, 1]), (None, "2024-01-15 10:00:00 a\n  x", [2]),
])
def test_blocks(spark, pattern, text, want):
    rows = source.blocks(source.from_text(spark, text), pattern).orderBy("idx").collect()
    assert [len(r.line_numbers) for r in rows] == want and [r.idx for r in rows] == list(range(len(want)))
    assert "\n".join(r.content for r in rows) == text


def test_patterns(spark):
    out = run(spark, "[2024-01-15] INFO User login\n[2024-01-15] INFO User logout\n[2024-01-16] INFO User login\n[2024-01-15] ERROR Connection failed")
    g = out["results"]["groups"]
    assert [(x["pattern"], x["count"]) for x in g] == [("[<DATE>] INFO User login", 2), ("[<DATE>] INFO User logout", 1), ("[<DATE>] ERROR Connection failed", 1)]
    assert g[0]["name"] == "INFO User login" and g[0]["line_ranges"] == [(1, 1), (3, 3)] and g[0]["samples"][0]["variable_values"] == {"var_0": ["2024-01-15", "2024-01-16"]}
    assert [(o["line_number"], o["reason"], o["score"]) for o in out["results"]["outliers"]] == [(2, "rare_pattern", 0.25), (4, "rare_pattern", 0.25)]
    assert out["metadata"]["algorithm"] == "template_extraction" and out["summary"] == {"unique_patterns": 3, "outliers": 2, "largest_cluster": 2}


def test_ranges_and_partitions(spark):
    text = "\n".join("same" if i in (1, 2, 3, 10, 11) else f"other {chr(96 + i)}" for i in range(1, 12))
    e = entries(spark, text)
    want = grouping.patterns(e).collect()
    assert want["results"]["groups"][0]["line_ranges"] == [(1, 3), (10, 11)]
    for n in (1, 7):
        assert grouping.patterns(e.repartition(n)).collect() == want


def test_budget(spark):
    text = "a a\na a\nb b\nb b\nc c\nc c"
    out = run(spark, text, budget=21)
    assert len(out["results"]["groups"]) == 1 and out["metadata"]["budget_applied"] is True and out["summary"]["unique_patterns"] == 3
    assert run(spark, text, budget=200)["metadata"]["budget_applied"] is False
    assert run(spark, text, budget=1)["results"]["groups"] == [] and run(spark, text, "patterns | top(0)")["results"]["groups"] == []


def test_slots(spark):
    out = run(spark, "INFO a\nINFO b\nERROR c\nERROR d\n ", "group_by(slot[0])")
    assert [(g["name"], g["count"]) for g in out["results"]["groups"]] == [("ERROR", 2), ("INFO", 2)]
    assert [(o["id"], o["line_number"], o["reason"]) for o in out["results"]["outliers"]] == [("ungrouped_0", 5, "no token at slot[0]")]


def test_similar_pins(spark):
    out = run(spark, "connection timeout\nconnection timeout!\ndatabase timeout\nuser logged in", "similar(0.3)")
    assert [g["count"] for g in out["results"]["groups"]] == [2, 1, 1] and out["metadata"]["algorithm"] == "edit_distance_clustering"


@pytest.mark.parametrize("limit", [0.0, 0.25, 0.5, 1.0])
def test_similar_is_the_sequential_definition(spark, limit):
    rng = random.Random(int(limit * 8))
    texts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 5))) for _ in range(40)]
    e = entries(spark, "\n".join(texts) + "\n")
    got = similar.similar(e, limit, size=4).groups.orderBy(F.desc("count"), "first").select("pattern", "count").collect()
    assert [(r.pattern, r["count"]) for r in got] == [(texts[c[0]], len(c)) for c in oracle.clusters(texts, limit)]


def test_outliers(spark):
    texts = ["INFO service started fine"] * 9 + ["ERROR Database explosion"]
    out = run(spark, "\n".join(texts), "outliers")
    got = {r.idx: r.score for r in outliers.scores(entries(spark, "\n".join(texts))).collect()}
    assert all(abs(got[i] - s) < 1e-12 for i, s in enumerate(oracle.ngram_scores(texts, 2)))
    assert [o["line_number"] for o in out["results"]["outliers"]] == [10] and out["results"]["baseline"]["threshold"]["auto_detected"]
    assert out["results"]["baseline"]["normal_count"] == 9
    assert len(run(spark, "\n".join(["x y"] * 5), "outliers")["results"]["outliers"]) == 5  # uniform: all are just under the threshold


def test_kth_score(spark):
    rng = random.Random(3)
    scores = [rng.choice([0.1, 0.2, 0.25, 0.5]) for _ in range(50)]
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    for k in (1, 2, 17, 50):
        assert outliers._kth(df, k) == sorted(scores)[k - 1]


def test_errors(spark):
    for text, pipeline in (("", None), ("x", "schemas"), ("x", "group_by(.a)"), ("x", 'where(.a == "b")')):
        with pytest.raises(ValueError):
            run(spark, text, pipeline)


def test_markdown_and_discovery(spark):
    md = api.process(spark, "Request 1 took 5 ms\nRequest 2 took 6 ms\nboom")
    assert "3 entries → 2 groups  (template_extraction)" in md and "Request <NUM> took <NUM> ms" in md and "## Outliers" in md and "- `var_0`: `1`, `2`" in md
    d = api.discover(spark, "GET 1\nGET 2 x")
    assert [(f["path"], f["types"], f["cardinality"], f["samples"]) for f in d.fields] == [("slot[0]", ["literal"], 1, ["GET"]), ("slot[1]", ["number"], 2, ["1", "2"]), ("slot[2]", ["literal"], 1, ["x"])]
    assert "Format: line  |  Entries: 2" in render.discovery_markdown(d)
    assert "tokens" in api.cost_preview_formatted(spark, "a 1\na 2") and render.format_count(1000000) == "1,000,000"
    assert "## Baseline" in api.process(spark, "a b\na b\nc d", Options(pipeline="outliers"))
    with pytest.raises(ValueError, match="Unknown format"):
        api.process(spark, "a", output_format="xml")
