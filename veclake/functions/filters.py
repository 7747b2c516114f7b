"""Metadata filters: AND of equalities, as a Column over typed columns or VARIANT.

A key must exist.  Numbers are equal by value whatever their type; a string
never equals a number; null equals null; lists and objects compare deeply.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ["BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"]


def _canonical(value) -> str:
    """JSON with sorted keys and whole floats as integers, as to_json prints a VARIANT."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(v[k]) for k in sorted(v)}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else v

    return json.dumps(plain(value), separators=(",", ":"), ensure_ascii=False)


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def check_filter(filters: dict | None) -> None:
    """Raise ValueError for NaN or infinite numbers anywhere in a filter."""

    def walk(path, v):
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError(f"filter {path} is not finite")
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, (list, tuple)) else ():
            walk(f"{path}.{k}", x)

    for k, v in (filters or {}).items():
        walk(k, v)


def matches(meta: dict | None, filters: dict | None) -> bool:
    """The same rule for one record's metadata in Python, for kernels that hold them."""
    for key, value in (filters or {}).items():
        if not isinstance(meta, dict) or key not in meta:
            return False
        own = meta[key]
        if is_number(value) and is_number(own):
            if float(own) != float(value):
                return False
        elif type(own) is not type(value) and not isinstance(value, tuple) or _canonical(own) != _canonical(value):
            return False
    return True


def variant_match(meta: Column, filters: dict | None) -> Column:
    """Filter over a VARIANT object; an empty filter matches all, a null object only that."""
    check_filter(filters)
    parts = []
    for key, value in (filters or {}).items():
        path = '$["' + key.replace('"', '\\"') + '"]'
        leaf = F.variant_get(meta, path, "variant")
        kind = F.schema_of_variant(leaf)
        if value is None:
            test = F.is_variant_null(leaf)
        elif is_number(value):
            number = kind.isin(*NUMBERS) | kind.startswith("DECIMAL")
            test = F.when(number, F.try_variant_get(meta, path, "double") == float(value))
        elif isinstance(value, (bool, str)):
            name = "BOOLEAN" if isinstance(value, bool) else "STRING"
            test = F.when(kind == name, F.try_variant_get(meta, path, name.lower()) == F.lit(value))
        else:
            test = F.to_json(leaf) == F.lit(_canonical(value))
        parts.append(F.coalesce(leaf.isNotNull() & test, F.lit(False)))
    return reduce(Column.__and__, parts, F.lit(True))


def typed_match(schema: T.StructType, filters: dict | None) -> Column:
    """Filter over typed columns: plain comparisons, which reach the Parquet scan.

    A value whose type cannot equal the column's matches nothing.
    """
    check_filter(filters)
    kinds = {f.name: f.dataType for f in schema.fields}
    parts = []
    for key, value in (filters or {}).items():
        kind = kinds.get(key)
        if kind is None:
            parts.append(F.lit(False))
        elif value is None:
            parts.append(F.col(f"`{key}`").isNull())
        elif isinstance(kind, T.NumericType):
            parts.append(F.col(f"`{key}`") == F.lit(value) if is_number(value) else F.lit(False))
        elif isinstance(kind, T.BooleanType):
            parts.append(F.col(f"`{key}`") == F.lit(value) if isinstance(value, bool) else F.lit(False))
        elif isinstance(kind, T.StringType):
            parts.append(F.col(f"`{key}`") == F.lit(value) if isinstance(value, str) else F.lit(False))
        else:
            parts.append(F.to_json(F.col(f"`{key}`")) == F.lit(_canonical(value)))
    return reduce(Column.__and__, parts, F.lit(True))
