"""JSON values as canonical text: sorted keys, no blanks, numbers as read."""

from __future__ import annotations

import json
import re


def _integer(text: str) -> int | float:
    value = int(text)
    return value if -(1 << 63) <= value < 1 << 64 else float(text)


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON number")


_BIG = re.compile(r"\d{19}")
_PLAIN, _EXACT = json.JSONDecoder(parse_constant=_refuse), json.JSONDecoder(parse_int=_integer, parse_constant=_refuse)


def loads(text: str):
    """Of repeated keys the last counts; integers beyond 64 bits become floats; NaN and the like are errors."""
    return (_EXACT if _BIG.search(text) else _PLAIN).decode(text)


_EXP = re.compile(r"e([+-])0*(\d)")


def number(value: int | float) -> str:
    """The shortest text, exponents without plus sign or leading zeros."""
    if isinstance(value, int):
        return str(value)
    if value in (float("inf"), float("-inf")):
        return "null"
    return _EXP.sub(lambda m: "e" + ("-" if m[1] == "-" else "") + m[2], repr(value))


_COMPACT = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False)
#: What the library's encoder may write otherwise: floats with an exponent, or beyond all bounds.
_ODD = re.compile(r"\de[+-]|Infinity|NaN")


def dumps(value, indent: int | None = None, level: int = 0) -> str:
    if indent is None:
        text = _COMPACT.encode(value)
        return _dumps(value, None, 0) if _ODD.search(text) else text
    return _dumps(value, indent, level)


def _dumps(value, indent: int | None, level: int) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        items = [_dumps(v, indent, level + 1) for v in value]
        ends = "[]"
    else:
        colon = ":" if indent is None else ": "
        items = [json.dumps(k, ensure_ascii=False) + colon + _dumps(value[k], indent, level + 1) for k in sorted(value)]
        ends = "{}"
    if not items:
        return ends
    if indent is None:
        return ends[0] + ",".join(items) + ends[1]
    pad = "\n" + " " * indent * (level + 1)
    return ends[0] + pad + ("," + pad).join(items) + "\n" + " " * indent * level + ends[1]


def scalar_text(value) -> str | None:
    """A scalar as text, null included; None for arrays and objects."""
    if isinstance(value, str):
        return value
    if isinstance(value, (list, dict)):
        return None
    return dumps(value)


def kind(value, *, boolean: str = "boolean") -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return boolean
    return "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def at_path(value, path: tuple[str, ...]):
    """(found, value) along object keys."""
    for key in path:
        if not isinstance(value, dict) or key not in value:
            return False, None
        value = value[key]
    return True, value


def without(value, path: tuple[str, ...]):
    """A copy without the field; arrays are not entered, missing parts change nothing."""
    if not isinstance(value, dict) or path[0] not in value:
        return value
    if len(path) == 1:
        return {k: v for k, v in value.items() if k != path[0]}
    return value | {path[0]: without(value[path[0]], path[1:])}


_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")


def holds(value, path: tuple[str, ...], op: str, wanted) -> bool:
    """A predicate on one value; false for missing fields, arrays and objects, whatever the operator."""
    found, v = at_path(value, path)
    text = scalar_text(v) if found else None
    if text is None:
        return False
    if op in ("==", "!="):
        if isinstance(wanted, str):
            same = text == wanted
        else:
            same = bool(_FLOAT.match(text)) and float(text) == wanted
        return same == (op == "==")
    part = wanted if isinstance(wanted, str) else number(wanted).removesuffix(".0")
    return {"contains": part in text, "starts_with": text.startswith(part), "ends_with": text.endswith(part)}[op]


def select(values: list, segments: tuple) -> list:
    """Entries along a path; what does not fit a segment is dropped."""
    for s in segments:
        if isinstance(s, tuple):
            values = [x for v in values if isinstance(v, list) for x in v]
        elif isinstance(s, int):
            values = [v[s] for v in values if isinstance(v, list) and s < len(v)]
        else:
            values = [v[s] for v in values if isinstance(v, dict) and s in v]
    return values


def entries(text: str) -> list:
    """The entries of a document: elements of an array, values of a map of objects, or the one object.

    A map has more than one key, and objects for more than half of its values; its keys are
    dropped. A scalar is an error.
    """
    value = loads(text)
    if isinstance(value, list):
        return value
    if not isinstance(value, dict):
        raise ValueError("JSON input must be an array or an object")
    if is_map(value):
        return [value[k] for k in sorted(value)]
    return [value]


def is_map(value) -> bool:
    return isinstance(value, dict) and len(value) > 1 and 2 * sum(isinstance(v, dict) for v in value.values()) > len(value)


def looks_like_json(text: str) -> bool:
    s = text.strip()
    return s[:1] + s[-1:] in ("[]", "{}") and len(s) > 1
