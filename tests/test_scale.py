"""Steps that read their input once, and what is small of it alone afterwards."""

import json

import pytest

from patternlens import api
from patternlens.functions import jsontext
from patternlens.operators import schemas
from patternlens.sources import json as json_source


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def objects(spark, values):
    return spark.createDataFrame([(0, i, jsontext.dumps(v)) for i, v in enumerate(values)], "src long, idx long, j string").repartition(3)


def test_subtree_reads_entries_once(spark):
    """Groups, values and singletons come out of written sums: no plan of theirs walks the entries again."""
    values = [{"k": i, "items": [{"n": i * 10 + j, "s": f"v{i}"} for j in range(3)]} for i in range(8)] + [{"odd": {"x": 1}}]
    s = schemas.subtree(objects(spark, values))
    assert "MapInArrow" not in plan(s.groups) + plan(s.values) + plan(s.outliers) + plan(s.totals)
    out = s.collect()
    first, second = out["results"]["patterns"]
    assert (first["count"], first["paths"], first["sample_values"]) == (24, ["$[*].items[*]"], {"n": ["0", "1", "10", "11", "2"], "s": ["v0", "v1"]})
    assert (second["count"], second["paths"], second["sample_values"]["k"]) == (8, ["$[*]"], ["0", "1", "2", "3", "4"])
    assert sorted(x["reason"] for x in out["results"]["singletons"]) == ["unique_schema at $[*]", "unique_schema at $[*].odd"] and out["metadata"]["total_entries"] == 34


def test_subtree_passes_sums_on(spark, monkeypatch):
    values = [{f"k{i % 7}": i, "in": [{"a": i}, {"b": [str(i)]}]} for i in range(60)]
    key = lambda s: [(r.description, r["count"], r["first"], sorted(r.paths)) for r in s.groups.orderBy("first").collect()]
    want = key(schemas.subtree(objects(spark, values)))
    monkeypatch.setattr(schemas, "HELD", 0)  # the workers get it with the function
    assert key(schemas.subtree(objects(spark, values))) == want and sum(w[1] for w in want) == 180


def test_table_rows_are_canonical_without_python(spark):
    rows = [(1, True, "q\"\\ \x0b\x1b\\u001B é \x7f/\n", [("z", 1), None]), (2, None, None, None), (3, False, "\\\x0e\\\\\x1f", [])]
    df = spark.createDataFrame(rows, "n int, `b x` boolean, a string, l array<struct<y:string,x:long>>")
    found = json_source.rows(df, "n")
    assert "Arrow" not in plan(found)
    item = lambda x: None if x is None else {"y": x[0], "x": x[1]}
    want = [jsontext.dumps({"n": n, "b x": b, "a": a, "l": None if x is None else [item(y) for y in x]}) for n, b, a, x in rows]
    assert [r.j for r in found.orderBy("idx").collect()] == want


@pytest.mark.parametrize("text", ["1e-07", "[1e16,123456789012345678901,1.5]", '{"b":"e+1 1e+1 Infinity","a":[true,null]}', "-9223372036854775809", "18446744073709551615", "1e400"])
def test_quick_json_is_the_same(text):
    value = json.loads(text, parse_int=jsontext._integer)
    assert jsontext.loads(text) == value and jsontext.dumps(jsontext.loads(text)) == jsontext._dumps(value, None, 0)


def test_schemas_read_entries_once(spark):
    s = schemas.schemas(objects(spark, [{"id": i, "t": f"x{i % 9}"} for i in range(200)] + [3, {"odd": [1]}]))
    assert "MapInArrow" not in plan(s.groups) + plan(s.values) + plan(s.outliers) + plan(s.totals)
    one, two = s.collect()["results"]["schemas"]
    assert one["count"] == 200 and one["sample_values"] == {"id": ["0", "1", "10", "100", "101"], "t": ["x0", "x1", "x2", "x3", "x4"]} and two["sample_values"] == {"odd": ["[...]"]}
    assert s.totals.first().asDict() | {"reduced_size": 0} == {"total_entries": 202, "original_size": sum(len(f'{{"id":{i},"t":"x{i % 9}"}}') for i in range(200)) + 1 + len('{"odd":[1]}'), "unique_patterns": 2, "largest_cluster": 200, "outliers": 1, "reduced_size": 0, "a": 43, "b": 24, "c": 23} | {k: v for k, v in s.totals.first().asDict().items() if k in "abc"}
    assert s.extra["members"].groupBy("key").count().orderBy("key").collect()[0]["count"] == 200


def test_values_of_a_table_are_not_collected_in_one_task(spark):
    """The five smallest values are chosen where the rows are read."""
    e = spark.range(5000).selectExpr("id as event_id", "'t' as event_type")
    s = api.summarize_table(e, "schemas | label(.event_type)", "event_id")
    assert s.collect()["results"]["schemas"][0]["sample_values"]["event_id"] == ["0", "1", "10", "100", "1000"]
    assert "collect_set" in plan(s.values) and "MapInArrow" not in plan(s.values) and "range" not in plan(s.values).lower().replace("rangepartitioning", "")


def test_long_groups_leave_their_line_ranges_on_the_executors(spark, monkeypatch):
    """A report's line ranges may be as many as entries: they are read as they are asked for."""
    from patternlens import render
    from patternlens.operators import result

    log = "".join(f"get {i}\n" if i % 3 else f"put {i}\n" for i in range(1, 31))
    whole = api.process_to_output(spark, log)
    monkeypatch.setattr(result, "HELD_RANGES", 15)
    calls = []
    monkeypatch.setattr(result.Summary, "_of", (lambda of: lambda self, part, chosen: calls.append(part) or of(self, part, chosen))(result.Summary._of))
    s = api.summarize(spark, log)
    out = s.collect()
    assert calls and not any(part is s.ranges for part in calls)
    mine, want = out["results"]["groups"][0]["line_ranges"], whole["results"]["groups"][0]["line_ranges"]
    assert not isinstance(mine, list) and list(mine) == want and len(mine) == len(want) == 10 and mine[:3] == want[:3] and mine[-1] == want[-1] and mine.lines() == 20
    assert render.to_markdown(out) == render.to_markdown(whole) and render.to_json(out) == render.to_json(whole)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams_without_lambdas(spark, n):
    from collections import Counter

    from patternlens.operators import outliers

    texts = ["", "a", "a b", " a  b c; d ", "a b c d e", "[x]", None, "a b c"]
    entries = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "src long, idx long, content string")
    want = Counter()
    for t in texts:
        if t is not None:
            w = [x for x in __import__("re").split(r"[\s\[\](){}:,;\"']", t) if x]
            want.update([" ".join(w)] if len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)])
    found = outliers.ngram_counts(entries, n)
    assert {r.ngram: r.n for r in found.collect()} == want and "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [0, 3, 200_000])
def test_scores_with_few_or_many_frequent_ngrams(spark, monkeypatch, most):
    """Whatever is taken for frequent, scores are the same; frequent n-grams are joined where entries are read."""
    from patternlens.operators import outliers

    from .oracle import ngram_scores

    monkeypatch.setattr(outliers, "FREQUENT", most)
    texts = ["the quick fox"] * 9 + ["the quick dog runs", "one of a kind", "", "one of the quick"] + ["of a"] * 3
    entries = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts)], "src long, idx long, content string")
    scored = outliers.scores(entries)
    got = {r.idx: r.score for r in scored.collect()}
    assert len(got) == len(texts) and all(abs(got[i] - s) < 1e-15 for i, s in enumerate(ngram_scores(texts, 2)))
    assert "LeftAnti" in scored._jdf.queryExecution().optimizedPlan().toString()


def test_top_ngrams_need_no_scores(spark, monkeypatch):
    from patternlens import queries
    from patternlens.operators import outliers

    monkeypatch.setattr(outliers, "scores", None)
    assert queries.q18_top_ngrams(spark, "/root/testdata/sf0.001").count() == 10


def test_samples_of_templates_in_one_pass(spark):
    """First entries and their variables are of one shuffle; a report's length by field reads them once."""
    from patternlens.operators import grouping, profile

    log = "".join(f"get {i} of {i % 2}\n" for i in range(7)) + "no variable\n" * 4 + "lone 5ms\n"
    s = api.summarize(spark, log)
    rows = {r.content: r for r in s.samples.collect()}
    assert rows["get 0 of 0"].variable_values == {"var_0": list("01234"), "var_1": list("01010")} and rows["get 0 of 0"].line_numbers == [1, 2, 3]
    assert rows["no variable"].variable_values is None and rows["no variable"].line_numbers == [8, 9, 10] and rows["lone 5ms"].variable_values == {"var_0": ["5ms"]}
    assert "Join" not in plan(grouping.patterns(api.text_entries(spark, log, api.Options())).samples)
    buckets = profile.cost_buckets(s)
    assert "Window" not in plan(buckets) and {r.path: r.chars for r in buckets.collect()} == {"pattern": 18 + 11 + 15, "content": 10 + 11 + 8, "var_0": 8, "var_1": 5, "(outliers)": 8}
