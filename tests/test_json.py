import json

import pytest

from patternlens import api
from patternlens.functions import jsontext
from patternlens.operators import profile, schemas
from patternlens.plans.options import Options


def run(spark, value, pipeline=None, **options):
    return api.process_to_output(spark, value if isinstance(value, str) else json.dumps(value), Options(input_format="json", pipeline=pipeline, **options))


@pytest.mark.parametrize("text,want", [("1.0", "1.0"), ("1e2", "100.0"), ("1e100", "1e100"), ("1e-7", "1e-7"), ("18446744073709551616", "1.8446744073709552e19"), ('{"b":1,"a":2,"b":3}', '{"a":2,"b":3}'), ('"é\\n"', '"é\\n"'), ("[]", "[]")])
def test_canonical(text, want):
    assert jsontext.dumps(jsontext.loads(text)) == want


def test_pretty():
    assert jsontext.dumps({"b": [1, {}], "a": None}, 2) == '{\n  "a": null,\n  "b": [\n    1,\n    {}\n  ]\n}'


def test_entries():
    assert jsontext.entries('{"x":{},"y":{"a":1},"z":3}') == [{}, {"a": 1}, 3] and jsontext.entries('{"x":{},"y":1}') == [{"x": {}, "y": 1}]
    assert jsontext.is_map({"a": {}, "b": {}, "c": 1}) and not jsontext.is_map([1]) and jsontext.looks_like_json(" {} ")
    with pytest.raises(ValueError):
        jsontext.entries("3")


@pytest.mark.parametrize("op,wanted,hit", [("==", "1.0", True), ("==", 1.0, True), ("!=", 1.0, False), ("contains", 1.0, True)])
def test_where_numbers(op, wanted, hit):
    assert jsontext.holds({"a": 1.0}, ("a",), op, wanted) is hit


def test_where_edges():
    assert not jsontext.holds({}, ("a",), "!=", "x") and not jsontext.holds({"a": []}, ("a",), "!=", "x") and jsontext.holds({"a": None}, ("a",), "==", "null")
    assert not jsontext.holds({"a": "1f"}, ("a",), "==", 1.0) and not jsontext.holds({"a": " 1 "}, ("a",), "==", 1.0) and jsontext.holds({"a": "x"}, ("a",), "!=", 1.0)


def test_del_and_select():
    assert jsontext.without({"a": {"b": 1, "c": 2}, "d": [{"b": 1}]}, ("a", "b")) == {"a": {"c": 2}, "d": [{"b": 1}]}
    assert jsontext.without({"d": [{"b": 1}]}, ("d", "b")) == {"d": [{"b": 1}]} and jsontext.select([{"a": [1, 2]}, {"b": 1}, 3], ("a", ("*",))) == [1, 2] and jsontext.select([{"a": [1, None]}], ("a", 1)) == [None]


def test_group_by(spark):
    out = run(spark, [{"l": "error"}, {"l": "warn"}, {"l": "error"}, {}, {"l": None}, {"l": []}], "group_by(.l)")
    assert [(g["name"], g["count"], g["pattern"]) for g in out["results"]["groups"]] == [("error", 2, ".l = error"), ("null", 1, ".l = null"), ("warn", 1, ".l = warn")]
    assert [(o["id"], o["line_number"]) for o in out["results"]["outliers"]] == [("ungrouped_0", 4), ("ungrouped_1", 6)]


def test_pipeline_order_does_not_matter(spark):
    rows = {"items": [{"k": "a", "x": 1}, {"k": "b"}, {"k": "a"}]}
    out = run(spark, rows, '.items[] | group_by(.k) | del(.x) | where(.k != "b") | top(1)')
    assert out["metadata"]["total_entries"] == 2 and out["results"]["groups"][0]["samples"][0]["content"] == '{"k":"a"}'
    assert run(spark, rows, '.items[] | where(.k == "none") | group_by(.k)')["results"]["groups"] == []


def test_schemas_by_depth(spark):
    rows = [{"type": "u", "data": {"id": 1, "name": "x"}}] * 2 + [{"type": "o", "data": {"id": 1, "amount": 2.5, "status": "s"}}] * 2 + [{"type": "e", "data": {"code": 1}}]
    assert run(spark, rows, "schemas", depth=0)["summary"]["unique_patterns"] == 1
    out = run(spark, rows, "schemas", depth=1)
    assert out["summary"]["unique_patterns"] == 3 and out["results"]["schemas"][0]["schema_description"] == "{ data: { id: number, name: string }, type: string }" and out["results"]["outliers"][0]["line_number"] == 5
    assert run(spark, ["s", 42, {"a": 1}, None, {"a": 2}], "schemas")["results"]["schemas"][0] == {"id": "schema_0", "name": "a", "schema_description": "{ a: number }", "fields": ["a"], "count": 2, "percentage": 40.0, "sample_values": {"a": ["1", "2"]}}
    assert run(spark, rows, "similar(0.1) | label(.type)")["results"]["schemas"][0]["name"] == "e"


def test_similarity():
    assert abs(schemas.similarity({"n": "string", "a": "number", "e": "string"}, {"n": "string", "a": "number"}) - 2 / 3) < 1e-12
    assert schemas.similarity({"id": "number"}, {"id": "string"}) == 0 and schemas.similarity({}, {}) == 1 and schemas.field_differences({"a": 1}, {"b": 1}) == (["a"], ["b"])


def test_subtree(spark):
    out = run(spark, {"users": [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}], "admins": [{"id": 3, "name": "c"}, {"id": 4, "name": "d"}]})
    p = out["results"]["patterns"]
    assert len(p) == 1 and p[0]["count"] == 4 and p[0]["paths"] == ["$[*].admins[*]", "$[*].users[*]"] and p[0]["sample_values"]["name"] == ["a", "b", "c", "d"]
    assert out["results"]["singletons"][0]["reason"] == "unique_schema at $[*]" and out["metadata"]["total_entries"] == 5
    assert schemas.short_sample("é" * 100) == "é" * 75 + "…" and schemas.short_sample([1, 2]) == "[1, 2]" and schemas.short_sample([1, "x"]) == "[...]"


def test_discover(spark):
    d = api.discover(spark, json.dumps([{"code": 1, "cat": "a"}, {"cat": "b"}, {"code": 2, "cat": "a"}]), Options(input_format="json"))
    got = {f["path"]: f for f in d.fields}
    assert abs(got["$[*].code"]["present_in_pct"] - 2 / 3) < 1e-6 and got["$[*].cat"]["cardinality"] == 2 and d.entry_count == 3
    root = api.discover_formatted(spark, json.dumps({"a": {"b": [{"c": 1}]}, "z": 1}), Options(input_format="json"))
    assert "Pipeline selector: .a.b[]" in root and "root object" in root


def test_cost(spark):
    c = api.cost_preview(spark, json.dumps([{"big": "x" * 140 + str(i), "n": i} for i in range(4)]), Options(input_format="json", pipeline="subtree"))
    assert c.fields[0]["path"] == "$[*].big" and c.suggestion.startswith("del(.big)") and c.warning is None
    lone = api.cost_preview(spark, json.dumps({"a": "x" * 50_000}), Options(input_format="json"))
    assert lone.warning and lone.suggestion is None and profile.del_argument("$[*].advices.advices[*].frame.sourceCode") == ".advices.advices"


def test_errors(spark):
    for value, pipeline in (([], None), ([1], "patterns"), ([1], "outliers")):
        with pytest.raises(ValueError):
            run(spark, value, pipeline)
    with pytest.warns(UserWarning):
        assert run(spark, [{"a": 1}], "group_by(slot[0])")["summary"]["outliers"] == 1
    assert "# patternlens output" in api.process(spark, json.dumps([{"a": 1}] * 2), Options(input_format="json", pipeline="schemas"))
    assert "## Subtree Patterns" in api.process(spark, json.dumps([{"a": 1}] * 2), Options(input_format="json"))
