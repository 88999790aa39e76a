"""Text helpers: half-even number text and compact JSON sizes."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text that rounds the exact binary value half to even; Spark's own formatting rounds half up."""

    def text(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else f"{v:.{digits}f}" for v in values], dtype=object)

    return F.pandas_udf(text, "string")(x.cast("double"))


class Repeated(dict):
    """A JSON object; ``twice`` holds keys that it names more than once (the last value counts)."""

    twice: frozenset = frozenset()


def _object(pairs: list[tuple[str, object]]) -> Repeated:
    out = Repeated(pairs)
    if len(out) != len(pairs):
        seen: set[str] = set()
        out.twice = frozenset(k for k, _ in pairs if k in seen or seen.add(k))
    return out


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def strict_json(line: str):
    """The value of one JSON text; ValueError for trailing text, NaN and lone surrogates."""
    value = json.loads(line, object_pairs_hook=_object, parse_constant=_refuse)
    line.encode()
    if "\\u" in line or "\\U" in line:
        json.dumps(value, ensure_ascii=False).encode()
    return value


def float_text(x: float) -> str:
    """Shortest text of a double: plain from 1e-5 up to 1e16, else with an exponent without sign or padding."""
    if x == 0 or 1e-5 <= abs(x) < 1e16:
        text = repr(x)
        if "e" in text:
            text = format(Decimal(text), "f")
        return text if "." in text else text + ".0"
    mantissa, _, exponent = repr(x).partition("e")
    return f"{mantissa.removesuffix('.0')}e{int(exponent)}"


def compact_size(value) -> int:
    """UTF-8 bytes of the value written as JSON without white space."""
    if value is None or value is True:
        return 4
    if value is False:
        return 5
    if isinstance(value, str):
        return len(json.dumps(value, ensure_ascii=False).encode())
    if isinstance(value, int):
        return len(str(value)) if -(1 << 63) <= value < 1 << 64 else len(float_text(float(value)))
    if isinstance(value, float):
        return len(float_text(value))
    if isinstance(value, list):
        return 2 + sum(map(compact_size, value)) + max(len(value) - 1, 0)
    return 2 + sum(compact_size(k) + 1 + compact_size(v) for k, v in value.items()) + max(len(value) - 1, 0)


RESOURCE = re.compile(r"/|~/|https?://")


def looks_like_resource(text: str) -> bool:
    """Paths and http addresses: case-sensitive, by their beginning."""
    return RESOURCE.match(text) is not None


END = "~ end of line ~"


def _clean(line: Column) -> Column:
    return ~F.contains(line, F.lit(END)) & ~F.contains(line, F.lit("\\u")) & F.is_valid_utf8(line)


def plain_json(line: Column) -> Column:
    """The line as VARIANT if the JVM's reading of it is the strict one, else null: then ``strict_json`` has to look.

    Null for anything that is not exactly one JSON value without repeated keys, and for
    lines with ``\\u`` escapes (surrogates) or broken UTF-8, which the JVM's parser repairs.
    The parser would ignore text behind a value: the line is read as the first
    element of an array that must end with a text of our own.
    """
    both = F.try_parse_json(F.concat(F.lit("["), line, F.lit(f',"{END}"]')))
    ours = (F.try_variant_get(both, "$[1]", "string") == END) & _clean(line)
    return F.when(ours, F.try_variant_get(both, "$[0]", "variant"))


def plain_kind(line: Column) -> Column:
    """Type of the VARIANT of ``plain_json`` as ``in_line`` writes it, without making that value; null or another text where that is null."""
    return F.when(_clean(line), F.schema_of_variant(F.try_parse_json(F.concat(F.lit('{"line":'), line, F.lit(f',"{END}":0}}')))))


def in_line(kind: str) -> str:
    return f"OBJECT<line: {kind}, `{END}`: BIGINT>"


def plain_numbers(line: Column) -> Column:
    """Whether all numbers of a JSON text are integers of fewer than 18 digits: of others the JVM writes another text."""
    outside = F.regexp_replace(F.regexp_replace(line, r"\\.", ""), r'"[^"]*"', "")
    return ~outside.rlike(r"[0-9][.eE]|[0-9]{18}")


def kind_of(value: Column, path: str = "$") -> Column:
    """Type of a value in a VARIANT, such as STRING, BIGINT, VOID (JSON null); null if it is not there."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def absent(value: Column, path: str) -> Column:
    """Not there, or JSON null."""
    found = F.try_variant_get(value, path, "variant")
    return found.isNull() | F.is_variant_null(found)


def variant_size(value: Column) -> Column:
    """``compact_size`` of a VARIANT without other numbers than ``plain_numbers``; 0 for none and for JSON null."""
    return F.when(value.isNull() | F.is_variant_null(value), 0).otherwise(F.octet_length(F.to_json(value))).cast("long")
