import pytest

from patternlens.plans.expr import ALL, Del, END, GroupBy, Label, ParseError, PathSelect, Similar, Top, Verb, Where, looks_like_pipeline, parse_pipeline, slot_index
from patternlens.plans.options import Options, format_of_file, input_format
from patternlens.registry import find_algorithm, find_format, find_formatter


def test_worked_example():
    assert parse_pipeline(".diagnostics[] | del(.sourceCode) | group_by(.category)") == [PathSelect(("diagnostics", ALL)), Del((("sourceCode",),)), GroupBy("category")]


@pytest.mark.parametrize("text,stage", [
    (".a[*].b", PathSelect(("a", ALL, "b"))), (".a[2]", PathSelect(("a", 2))), ("del(.a, .b.c)", Del((("a",), ("b", "c")))), ('where(.a.b != "x\\"y")', Where(("a", "b"), "!=", 'x"y')),
    ("where(.n == 5)", Where(("n",), "==", 5.0)), ('where(.a contains "z")', Where(("a",), "contains", "z")), ("group_by(slot[3])", GroupBy("slot[3]")), ("label(.x)", Label("x")),
    ("top(0)", Top(0)), ("similar(0.8)", Similar(0.8)), ("similar(1)", Similar(1.0)), ("subtree", Verb("subtree")),
])
def test_stages(text, stage):
    assert parse_pipeline(text) == [stage]


@pytest.mark.parametrize("text", ["", "frobnicate", ".[]", "top(-1)", "del(a)", "where(.a < 3)", "group_by(.a.b)", ".a |", 'where(.a == "x)', "top(1) top(2)", ".a-b"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse_pipeline(text)


def test_error_positions():
    with pytest.raises(ParseError) as e:
        parse_pipeline("frobnicate")
    assert "frobnicate" in str(e.value) and e.value.position == 0
    with pytest.raises(ParseError) as e:
        parse_pipeline("top(")
    assert e.value.position == END


def test_names():
    assert slot_index("slot[12]") == 12 and slot_index("x") is None
    assert looks_like_pipeline(".a") and looks_like_pipeline("summarize") and not looks_like_pipeline("app.log") and not looks_like_pipeline("where(.a == 1)")
    assert input_format("LOGS") == "line" and format_of_file("a/b.JSON") == "json" and format_of_file("b.log") == "line"
    for bad in (lambda: format_of_file("file"), lambda: input_format("csv"), lambda: Options(ngram_size=0)):
        with pytest.raises(ValueError):
            bad()
    assert find_algorithm("TEMPLATE").name == "patterns" and find_formatter("md").name == "markdown" and find_format("multi-line").name == "block" and find_format("csv") is None
