"""Runs: a source, a pipeline, a result."""

from __future__ import annotations

import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .functions import jsontext
from .operators import grouping, profile, schemas, similar, typed
from .operators.outliers import outliers
from .operators.result import Summary
from .plans.expr import Del, GroupBy, Label, PathSelect, Similar, Stage, Top, Verb, Where, parse_pipeline, slot_index
from .plans.options import BLOCK, JSON, Options
from .sources import json as json_source
from .sources import text as text_source

Source = str | DataFrame | text_source.Files


def _documents(spark: SparkSession, source: Source) -> DataFrame:
    if isinstance(source, text_source.Files):
        return text_source.read_files(spark, *source.paths)
    return text_source.from_text(spark, source) if isinstance(source, str) else source


def _split(stages: list[Stage]) -> tuple[tuple[Stage, ...], Verb | Similar | None, str | None, int | None, str | None]:
    """(pre-processing, algorithm, group_by field, top, label): the last of each kind counts, whatever the order."""
    before = tuple(s for s in stages if isinstance(s, (PathSelect, Del, Where)))
    last = lambda kind: next((s for s in reversed(stages) if isinstance(s, kind)), None)
    group, top, label = last(GroupBy), last(Top), last(Label)
    return before, last((Verb, Similar)), group and group.field, top and top.n, label and label.field


def _finished(s: Summary, options: Options, top: int | None, label: str | None, input_file: str | None) -> Summary:
    from dataclasses import replace

    return replace(s, budget=options.budget, limit=top, label=label, input_file=input_file)


def _group_key(entries: DataFrame, name: str):
    @F.arrow_udf("string")
    def key(column: pa.Array) -> pa.Array:
        values = [jsontext.loads(x) for x in column.to_pylist()]
        return pa.array([jsontext.scalar_text(v[name]) if isinstance(v, dict) and name in v else None for v in values], pa.string())

    return key("j")


def _json_summary(entries: DataFrame, verb, group: str | None, options: Options) -> Summary:
    if group is not None:
        if slot_index(group) is not None:
            warnings.warn(f"group_by({group}) on JSON looks for a field of that name; slots are for text", stacklevel=3)
        return grouping.group_by_value(entries, group, _group_key(entries, group))
    if isinstance(verb, Similar):
        return schemas.schemas(entries, verb.threshold, options.depth)
    name = verb.name if verb else "subtree"
    if name in ("summarize", "subtree"):
        return schemas.subtree(entries)
    if name == "schemas":
        return schemas.schemas(entries, depth=options.depth)
    raise ValueError(f"'{name}' is for text; JSON input takes summarize, schemas, subtree, similar and group_by")


def _text_summary(entries: DataFrame, verb, group: str | None, options: Options) -> Summary:
    if group is not None:
        n = slot_index(group)
        if n is None:
            raise ValueError(f"group_by(.{group}) needs JSON input; text takes group_by(slot[N])")
        return grouping.group_by_slot(entries, n)
    if isinstance(verb, Similar):
        return similar.similar(entries, verb.threshold)
    name = verb.name if verb else "patterns"
    if name in ("summarize", "patterns"):
        return grouping.patterns(entries)
    if name == "outliers":
        return outliers(entries, options.ngram_size, options.outlier_threshold)
    raise ValueError(f"'{name}' needs JSON input")


def text_entries(spark: SparkSession, source: Source, options: Options) -> DataFrame:
    if isinstance(source, text_source.Files):
        found = text_source.file_lines(spark, *source.paths)
        return text_source.block_entries(found, options.entry_pattern) if options.input_format == BLOCK else text_source.line_entries(found)
    docs = _documents(spark, source)
    return text_source.blocks(docs, options.entry_pattern) if options.input_format == BLOCK else text_source.lines(docs)


def summarize(spark: SparkSession, source: Source, options: Options | None = None, input_file: str | None = None) -> Summary:
    """The analysis that the options ask for, as relations; nothing is collected but what an algorithm itself needs.

    ``source`` is a text, documents as a DataFrame (src, raw), or files, whose lines are read in splits.
    """
    options = options or Options()
    stages = parse_pipeline(options.pipeline) if options.pipeline else []
    before, verb, group, top, label = _split(stages)
    if options.input_format == JSON:
        docs = _documents(spark, source)
        whole = json_source.documents(docs)
        if whole.isEmpty():
            raise ValueError("No JSON objects found in input")
        entries = json_source.documents(docs, before) if before else whole
        return _finished(_json_summary(entries, verb, group, options), options, top, label, input_file)
    if before:
        raise ValueError("path selection, del and where need JSON input")
    entries = text_entries(spark, source, options)
    if entries.isEmpty():
        raise ValueError("Input is empty")
    return _finished(_text_summary(entries, verb, group, options), options, top, label, input_file)


def summarize_table(df: DataFrame, pipeline: str, order: str, options: Options | None = None) -> Summary:
    """A pipeline over the rows of a table, ``order`` numbering them. Filters run on typed columns, so Catalyst sees them."""
    options = options or Options(input_format=JSON)
    before, verb, group, top, label = _split(parse_pipeline(pipeline))
    numbered = df.withColumn("_order", F.col(order))
    for s in before:
        if isinstance(s, Where):
            numbered = typed.where(numbered, s.path, s.op, s.value)
        elif isinstance(s, Del):
            numbered = typed.delete(numbered, *s.paths)
        else:
            raise ValueError("path selection over a table: use operators.typed.select, which gives new entries")
    data = numbered.drop("_order")
    if group is not None:
        j = F.to_json(F.struct(*data.columns), {"ignoreNullFields": "false"})
        rows = numbered.select(F.lit(0).cast("long").alias("src"), F.col("_order").cast("long").alias("idx"), *data.columns, j.alias("j"))
        out = grouping.group_by_value(rows.select("src", "idx", "j", typed.key(data, group).alias("_key")), group, F.col("_key"))
    else:
        out = _json_summary(json_source.rows(numbered, "_order", columns=data.columns), verb, None, options)
    return _finished(out, options, top, label, None)


def process_to_output(spark: SparkSession, source: Source, options: Options | None = None, input_file: str | None = None) -> dict:
    return summarize(spark, source, options, input_file).collect()


def process(spark: SparkSession, source: Source, options: Options | None = None, output_format: str = "markdown", input_file: str | None = None) -> str:
    if output_format not in ("json", "markdown"):
        return render.formatted({}, output_format)
    return render.formatted(process_to_output(spark, source, options, input_file), output_format)


def discover(spark: SparkSession, source: Source, options: Options | None = None) -> profile.Discovery:
    """What fields or slots the input has; a pipeline is not looked at."""
    options = options or Options()
    if options.input_format == JSON:
        docs = _documents(spark, source)
        entries = json_source.documents(docs)
        lone = entries.count() == 1 and not _is_array(docs)
        return profile.collect_discovery(profile.discover_json(entries, "$" if lone else "$[*]"), JSON, entries.count())
    entries = text_entries(spark, source, options)
    return profile.collect_discovery(profile.discover_text(entries), options.input_format, entries.count())


def _is_array(docs: DataFrame) -> bool:
    return docs.where(F.ltrim("raw").startswith("[")).limit(1).count() > 0


def discover_formatted(spark: SparkSession, source: Source, options: Options | None = None, output_format: str = "markdown") -> str:
    return render.formatted(discover(spark, source, options), output_format)


def cost_preview(spark: SparkSession, source: Source, options: Options | None = None) -> profile.CostPreview:
    from dataclasses import replace

    return profile.cost_preview(summarize(spark, source, replace(options or Options(), budget=None)))


def cost_preview_formatted(spark: SparkSession, source: Source, options: Options | None = None, output_format: str = "markdown") -> str:
    return render.formatted(cost_preview(spark, source, options), output_format)
