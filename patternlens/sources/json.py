"""JSON sources: (src, idx, j), a row an entry, ``j`` its canonical text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..deploy import ship
from ..functions import jsontext
from ..plans.expr import Del, PathSelect, Stage, Where

SCHEMA = "src long, idx long, j string"


def _apply(values: list, stages: tuple[Stage, ...]) -> list:
    for s in stages:
        if isinstance(s, PathSelect):
            values = jsontext.select(values, s.segments)
        elif isinstance(s, Del):
            for path in s.paths:
                values = [jsontext.without(v, path) for v in values]
        elif isinstance(s, Where):
            values = [v for v in values if jsontext.holds(v, s.path, s.op, s.value)]
    return values


def documents(docs: DataFrame, stages: tuple[Stage, ...] = (), src: str = "src", raw: str = "raw") -> DataFrame:
    """Entries of whole JSON documents, with the path, del and where stages applied as they are read.

    One pass over the text does it all, as a document is parsed in one piece anyway.
    """
    ship(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for s, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, v in enumerate(_apply(jsontext.entries(text), stages)):
                    out[0].append(s)
                    out[1].append(i)
                    out[2].append(jsontext.dumps(v))
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["src", "idx", "j"])

    return docs.where(F.col(raw).isNotNull()).select(F.col(src).cast("long"), F.col(raw)).mapInArrow(read, SCHEMA)


_SAME = (S.ByteType, S.ShortType, S.IntegerType, S.LongType, S.BooleanType, S.StringType)
#: Escapes that Spark writes in capitals: control characters without a short form whose code has a letter.
_CAPITALS = ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F")


def _same(kind: S.DataType) -> bool:
    """Whether Spark writes values of the type as canonical text does, but for the order of fields."""
    if isinstance(kind, S.ArrayType):
        return _same(kind.elementType)
    if isinstance(kind, S.StructType):
        return len({n.lower() for n in kind.names}) == len(kind.names) and all(_same(f.dataType) for f in kind)
    return isinstance(kind, _SAME)


def _sorted(value: Column, kind: S.DataType) -> Column:
    """The value with the fields of all structs in order of their names."""
    if isinstance(kind, S.ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType)) if isinstance(kind.elementType, (S.ArrayType, S.StructType)) else value
    if isinstance(kind, S.StructType):
        return F.when(value.isNotNull(), F.struct(*(_sorted(value.getField(n), kind[n].dataType).alias(n) for n in sorted(kind.names))))
    return value


def canonical_columns(df: DataFrame, names: list[str]) -> Column | None:
    """Canonical text of an object of the columns, without Python; None if a column is of a type that needs it."""
    if not _same(S.StructType([df.schema[n] for n in names])) or len({n.lower() for n in df.columns}) < len(df.columns):
        return None
    text = F.to_json(F.struct(*(_sorted(F.col(f"`{n.replace('`', '``')}`"), df.schema[n].dataType).alias(n) for n in sorted(names))), {"ignoreNullFields": "false"})
    small = text
    for code in _CAPITALS:
        small = F.regexp_replace(small, F.lit(rf"(?<!\\)((?:\\\\)*+)\\u{code}"), F.lit(rf"$1\\u{code.lower()}"))
    return F.when(text.contains("\\u00"), small).otherwise(text)


def rows(df: DataFrame, order: str, json_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of a table as entries of one source; ``order`` numbers them. Nulls in columns are present nulls.

    An entry is the text of ``json_col``, else an object of the columns, all if none are named.
    """
    place = (F.lit(0).cast("long").alias("src"), F.col(order).cast("long").alias("idx"))
    names = columns or df.columns
    if json_col is None and (plain := canonical_columns(df, names)) is not None:
        return df.select(*place, plain.alias("j"))
    ship(df.sparkSession)
    j = F.col(json_col) if json_col else F.to_json(F.struct(*names), {"ignoreNullFields": "false"})

    @F.arrow_udf("string")
    def canonical(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else jsontext.dumps(jsontext.loads(x)) for x in column.to_pylist()], pa.string())

    return df.select(*place, canonical(j).alias("j"))


def transformed(entries: DataFrame, stages: tuple[Stage, ...]) -> DataFrame:
    """Entries with path, del and where stages applied, all in one pass.

    An entry that gives several keeps its place: their ``idx`` are those of the entry with a
    place in it, dense only if every entry gives one at most; over 2^24 values of one entry are an error.
    """
    if not stages:
        return entries
    ship(entries.sparkSession)
    many = any(isinstance(x, tuple) for s in stages if isinstance(s, PathSelect) for x in s.segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for s, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = _apply([jsontext.loads(text)], stages)
                if len(values) > 1 << 24:
                    raise ValueError(f"entry {i} gives {len(values)} values")
                for k, v in enumerate(values):
                    out[0].append(s)
                    out[1].append((i << 24) + k if many else i)
                    out[2].append(jsontext.dumps(v))
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["src", "idx", "j"])

    return entries.select("src", "idx", "j").mapInArrow(run, SCHEMA)
