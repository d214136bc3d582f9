"""Command line: ``python -m patternlens.cli [PIPELINE] [FILE] [options]``."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import SparkSession

from . import __version__, api
from .plans.expr import SYNTAX, looks_like_pipeline
from .plans.options import Options, format_of_file
from .sources.text import Files


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="patternlens", description="Summarises logs and JSON.", epilog=SYNTAX, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("args", nargs="*", help="a pipeline, a file, or both; without a file the standard input is read")
    p.add_argument("--format", help="json, line or block; needed for standard input")
    p.add_argument("--entry-pattern", help="regular expression of the line that begins a block")
    p.add_argument("--output-format", default="markdown", help="markdown or json")
    p.add_argument("-o", "--output", help="file to write")
    p.add_argument("--budget", type=int, help="lines that the report may take")
    p.add_argument("--ngram-size", type=int, default=2)
    p.add_argument("--outlier-threshold", type=float, default=0.0)
    p.add_argument("--depth", type=int, default=1, help="nested levels of a schema")
    p.add_argument("--discover", action="store_true", help="list fields or slots")
    p.add_argument("--cost-preview", action="store_true", help="estimate which fields the report spends its length on")
    p.add_argument("--version", action="version", version=__version__)
    return p


def split_args(args: list[str]) -> tuple[str | None, str | None]:
    """(pipeline, file): a file or folder that is there is one, whatever it looks like, and so is a URL that Spark may read."""
    pipeline = file = None
    for a in args:
        if os.path.exists(a) or re.match(r"\w+://", a):
            file = a
        elif looks_like_pipeline(a) and pipeline is None:
            pipeline = a
        elif file is None:
            file = a
        else:
            raise ValueError(f"one pipeline and one file at most: {a}")
    return pipeline, file


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    try:
        pipeline, file = split_args(a.args)
        if file is None and not a.format:
            raise ValueError("standard input needs --format")
        options = Options(a.format or format_of_file(file), a.entry_pattern, pipeline, a.budget, a.ngram_size, a.outlier_threshold, a.depth)
        if file is not None and "://" not in file and not os.path.exists(file):
            raise FileNotFoundError(f"no such file: {file}")
        source = sys.stdin.read() if file is None else Files((file if "://" in file else f"file://{os.path.abspath(file)}",))
        spark = spark or SparkSession.builder.appName("patternlens").getOrCreate()
        if a.discover:
            out = api.discover_formatted(spark, source, options, a.output_format)
        elif a.cost_preview:
            out = api.cost_preview_formatted(spark, source, options, a.output_format)
        else:
            out = api.process(spark, source, options, a.output_format, os.path.basename(file) if file else None)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(out)
        print(f"written to {a.output}", file=sys.stderr)
    else:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
