"""Log lines as typed tokens, in expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a time stamp, and the classes of words in order of precedence.
MARK = chr(0)
STAMP = r"(?U)(\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{2}:\d{2}:\d{2}(?:\.\d+)?)"
PIECES = r"[ \t]|[\[\](){},;]|[^\x00 \t\[\](){},;]+"
CLASSES = (
    ("timestamp", r"(?U)^\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\z"),
    ("date", r"(?U)^\d{4}-\d{2}-\d{2}\z"),
    ("timestamp", r"(?U)^\d{2}:\d{2}:\d{2}(?:\.\d+)?\z"),
    ("identifier", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"),
    ("identifier", r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})\z"),
    ("duration", r"(?U)^\d+(?:\.\d+)?(?:ms|s|m|h|d|MB|GB|KB|B)\z"),
    ("ip_address", r"(?U)^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\z"),
    ("ip_address", r"^[0-9a-f:]+::[0-9a-f:]*\z"),
    ("number", r"(?U)^-?\d+(?:\.\d+)?\z"),
    ("identifier", r"^[0-9A-Fa-f]{8,}\z"),
    ("timestamp", r"^(?i:mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\z"),
)
#: How a variable of each class is shown.
SHOWN = {"number": "<NUM>", "timestamp": "<TIME>", "date": "<DATE>", "identifier": "<ID>", "duration": "<DURATION>", "ip_address": "<IP>"}
PUNCTUATION = "[](){},;"
#: Lines that may hold a variable: every class has a digit or a colon, eight hex letters, or is a name of three letters.
VARIED = r"(?U)[\d:]|[A-Fa-f]{8}|(?:^|[\x00 \t\[\](){},;])" + CLASSES[10][1].removeprefix("^").removesuffix(r"\z") + r"(?:[\x00 \t\[\](){},;]|\z)"


def words(line: Column) -> Column:
    """Array of the pieces of a line: words, single blanks or tabs, single punctuation marks."""
    marked = F.regexp_replace(line, F.lit(STAMP), F.lit(f"{MARK}$1{MARK}"))
    return F.regexp_extract_all(marked, F.lit(PIECES), F.lit(0))


def kind_of(word: Column) -> Column:
    """literal, whitespace, punctuation or a class of variables."""
    out = F.when(word.isin(" ", "\t"), "whitespace").when(word.isin(*PUNCTUATION), "punctuation")
    # every class but hex words and names of days and months has a digit or a colon: others need two tests only
    plain = ~word.rlike(r"(?U)[\d:]")
    out = out.when(plain, F.when(word.rlike(CLASSES[9][1]), "identifier").when(word.rlike(CLASSES[10][1]), "timestamp").otherwise("literal"))
    for name, pattern in CLASSES:
        out = out.when(word.rlike(pattern), name)
    return out.otherwise("literal")


def tokens(line: Column) -> Column:
    """Array of (kind, text)."""
    return F.transform(words(line), lambda w: F.struct(kind_of(w).alias("kind"), w.alias("text")))


def is_variable(kind: Column) -> Column:
    return kind.isin(*SHOWN)


def shown(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in SHOWN.items():
        out = F.when(kind == name, text).otherwise(out)
    return out


def signature(line: Column) -> Column:
    """What lines of one template have in common, as a string: V and a class or F and a text, with NUL between.

    NUL can't be part of a token, so equal strings are equal token lists; a literal ``<NUM>``
    differs from a number. A tab counts as a blank. A line is rewritten as a whole, class after
    class, so all of it stays in generated code: every token gets a NUL and an F ahead, and what is
    of a class gets the class instead.
    """
    pieces = lambda text: F.regexp_replace(text, F.lit(PIECES), F.lit(f"{MARK}F$0"))
    plain = lambda text: F.substr(F.translate(F.regexp_replace(text, F.lit(r"\x00(?=\x00|\z)"), F.lit("")), "\t", " "), F.lit(2))  # noqa: E731  without what parted tokens only
    out = pieces(F.regexp_replace(line, F.lit(STAMP), F.lit(f"{MARK}$1{MARK}")))
    for name, pattern in CLASSES:
        flags, body = pattern.partition("^")[::2]
        out = F.regexp_replace(out, F.lit(rf"{flags}\x00F(?:{body.removesuffix(chr(92) + 'z')})(?=\x00|\z)"), F.lit(f"{MARK}V{SHOWN[name]}"))
    return F.when(line.rlike(VARIED), plain(out)).otherwise(plain(pieces(line)))


def parts(sig: Column) -> Column:
    return F.when(sig == "", F.array().cast("array<string>")).otherwise(F.split(sig, MARK, -1))


def pattern(sig: Column) -> Column:
    """A signature as people read it."""
    return F.regexp_replace(sig, F.lit(r"(?:^|\x00)[FV]"), F.lit(""))


def template_name(sig: Column) -> Column:
    """The first five fixed tokens that are neither blank nor punctuation, or ``Pattern``."""
    fixed = F.filter(parts(sig), lambda p: p.startswith("F") & (F.trim(F.substr(p, F.lit(2))) != "") & ~F.substr(p, F.lit(2)).isin(*PUNCTUATION, ":"))
    name = F.array_join(F.slice(F.transform(fixed, lambda p: F.substr(p, F.lit(2))), 1, 5), " ")
    return F.when(name == "", "Pattern").otherwise(name)


def variables(line: Column) -> Column:
    """The texts of a line's variable tokens, in order."""
    return F.transform(F.filter(tokens(line), lambda t: is_variable(t["kind"])), lambda t: t["text"])


def slots(line: Column) -> Column:
    """The tokens that are neither blank nor punctuation; a date counts as a timestamp."""
    kept = F.filter(tokens(line), lambda t: ~t["kind"].isin("whitespace", "punctuation"))
    return F.transform(kept, lambda t: F.struct(F.when(t["kind"] == "date", "timestamp").otherwise(t["kind"]).alias("kind"), t["text"].alias("text")))
