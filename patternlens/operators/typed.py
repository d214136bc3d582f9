"""The pipeline's filters on tables with a schema, where Catalyst prunes and pushes them down.

A null column counts as a present null, as a row can't lack a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsontext import number

#: Texts that count as numbers; Spark alone would also take blanks and Java's suffixes.
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"


def column(df: DataFrame, path: tuple[str, ...]) -> tuple[Column | None, T.DataType | None]:
    """The column at a path, or (None, None) where the schema has none."""
    kind: T.DataType = df.schema
    found = None
    for name in path:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None, None
        found = F.col(f"`{name}`") if found is None else found.getField(name)
        kind = kind[name].dataType
    return found, kind


def where(df: DataFrame, path: tuple[str, ...], op: str, value: str | float) -> DataFrame:
    """Rows whose field holds; missing fields, arrays and structs never do, not even for ``!=``."""
    c, kind = column(df, path)
    if c is None or isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return df.where(F.lit(False))
    if isinstance(kind, T.StringType) and isinstance(value, str) and op in ("==", "contains", "starts_with", "ends_with") and value != "null":
        test = {"==": c == value, "contains": c.contains(value), "starts_with": c.startswith(value), "ends_with": c.endswith(value)}[op]  # pushed to the scan
        return df.where(test if op == "==" or value not in "null" else test | c.isNull())
    if isinstance(kind, T.NumericType) and not isinstance(value, str) and op in ("==", "!="):
        return df.where(c == value) if op == "==" else df.where(c.isNull() | (c != value))
    text = F.coalesce(c.cast("string"), F.lit("null"))
    if op in ("==", "!="):
        same = text == value if isinstance(value, str) else F.coalesce(F.when(text.rlike(NUMBER), text.try_cast("double")) == F.lit(float(value)), F.lit(False))
        return df.where(same if op == "==" else ~same)
    part = value if isinstance(value, str) else number(value).removesuffix(".0")
    return df.where({"contains": text.contains(part), "starts_with": text.startswith(part), "ends_with": text.endswith(part)}[op])


def delete(df: DataFrame, *paths: tuple[str, ...]) -> DataFrame:
    """Without these fields; nothing that is not there, and nothing inside arrays."""
    for path in paths:
        if len(path) == 1:
            df = df.drop(path[0]) if path[0] in df.columns else df
        elif column(df, path)[0] is not None:
            df = df.withColumn(path[0], F.col(f"`{path[0]}`").dropFields(".".join(path[1:])))
    return df


def select(df: DataFrame, segments: tuple) -> DataFrame:
    """Entries along a path: a struct's fields become the columns, elements of arrays become rows; what does not fit is dropped."""
    for k, s in enumerate(segments):
        if isinstance(s, str):
            c, kind = column(df, (s,))
        else:
            c, kind = column(df, ("entry",))
        if c is None:
            return df.where(F.lit(False))
        if isinstance(s, str):
            df = df.select(c.alias("entry"))
        elif not isinstance(kind, T.ArrayType):
            return df.where(F.lit(False))
        elif isinstance(s, int):
            df = df.where(F.size(c) > s).select(F.get(c, s).alias("entry"))
        else:
            df = df.select(F.explode(c).alias("entry"))
        kind = df.schema["entry"].dataType
        following = segments[k + 1] if k + 1 < len(segments) else None
        if isinstance(kind, T.StructType) and (following is None or isinstance(following, str)):
            df = df.where("entry is not null").select("entry.*")
    return df


def key(df: DataFrame, name: str) -> Column:
    """A column as the text that ``group_by`` groups by; null for what can't be a key."""
    c, kind = column(df, (name,))
    if c is None or isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.lit(None).cast("string")
    return F.coalesce(c.cast("string"), F.lit("null"))
