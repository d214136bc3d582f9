"""What algorithms, formats and formatters there are."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Entry:
    name: str
    description: str
    aliases: tuple[str, ...] = ()
    details: tuple[tuple[str, str], ...] = ()


ALGORITHMS = (
    Entry("patterns", "lines of one template, with typed variable slots", ("template", "template_extraction"), (("input", "line, block"),)),
    Entry("similar", "entries within an edit distance of a leader, or schemas within a similarity", ("clustering", "edit_distance"), (("threshold", "0 to 1"),)),
    Entry("outliers", "entries whose n-grams are rare", ("ngram", "ngram_outliers"), (("ngram_size", "1 to 10"), ("threshold", "0 for automatic"))),
    Entry("schemas", "objects of similar schema", ("schema", "schema_clustering"), (("input", "json"), ("threshold", "0.8"), ("depth", "1"))),
    Entry("subtree", "object shapes that recur at any depth", ("subtrees",), (("input", "json"), ("threshold", "0.8"))),
)
FORMATTERS = (
    Entry("markdown", "a report with sections and code blocks", ("md",), (("mime_type", "text/markdown"), ("file_extension", "md"))),
    Entry("json", "the analysis as data", (), (("mime_type", "application/json"), ("file_extension", "json"))),
)
FORMATS = (
    Entry("json", "an array, a map of objects, or an object", ("json-array", "json-map")),
    Entry("line", "an entry a line", ("text", "log", "logs")),
    Entry("block", "entries of several lines", ("multiline", "multi-line")),
)


def _find(entries: tuple[Entry, ...], name: str) -> Entry | None:
    wanted = name.lower()
    return next((e for e in entries if wanted == e.name or wanted in e.aliases), None)


def find_algorithm(name: str) -> Entry | None:
    return _find(ALGORITHMS, name)


def find_formatter(name: str) -> Entry | None:
    return _find(FORMATTERS, name)


def find_format(name: str) -> Entry | None:
    return _find(FORMATS, name)
