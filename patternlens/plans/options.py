"""Options of a run, and the names of formats."""

from __future__ import annotations

from dataclasses import dataclass

JSON, LINE, BLOCK = "json", "line", "block"
#: Other names of the formats.
ALIASES = {"json": JSON, "json-array": JSON, "json-map": JSON, "line": LINE, "text": LINE, "log": LINE, "logs": LINE, "block": BLOCK, "multiline": BLOCK, "multi-line": BLOCK}
NGRAM_SIZES = range(1, 11)


def input_format(name: str) -> str:
    try:
        return ALIASES[name.lower()]
    except KeyError:
        raise ValueError(f"Unknown input format: {name}. Use 'json', 'line' or 'block'") from None


def format_of_file(path: str) -> str:
    """json for a .json file, line for any other extension; without one the format must be given."""
    name = path.replace("\\", "/").rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    if not dot or not stem or not ext:
        raise ValueError("The format can't be told without a file extension: give one")
    return JSON if ext.lower() == "json" else LINE


@dataclass(frozen=True)
class Options:
    """``threshold`` 0 or less: found from the data. ``depth`` counts nested levels of a schema."""

    input_format: str = LINE
    entry_pattern: str | None = None
    pipeline: str | None = None
    budget: int | None = None
    ngram_size: int = 2
    outlier_threshold: float = 0.0
    depth: int = 1

    def __post_init__(self):
        object.__setattr__(self, "input_format", input_format(self.input_format))
        if self.ngram_size not in NGRAM_SIZES:
            raise ValueError("ngram_size must be between 1 and 10")
