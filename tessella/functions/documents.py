"""JSON: typed reading with defaults, never failing on a bad value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def items_or_error(text: Column, key: str) -> Column:
    """struct<items: array<string>, error: string> of an object's list: no list gives an empty one and the reason."""
    parsed = F.try_parse_json(text)
    items = F.try_variant_get(parsed, f"$.{key}", "array<string>")
    error = F.when(parsed.isNull(), "not JSON").when(items.isNull(), f"no list {key}")
    return F.struct(F.coalesce(items, F.array().cast("array<string>")).alias("items"), error.alias("error"))


def unwrap_list(text: Column, keys: list[str], element: str) -> Column:
    """The list itself, or the one that the object holds under the first of keys that has one; else empty."""
    parsed = F.try_parse_json(text)
    found = [F.try_variant_get(parsed, "$", f"array<{element}>")] + [F.try_variant_get(parsed, f"$.{k}", f"array<{element}>") for k in keys]
    return F.coalesce(*found, F.array().cast(f"array<{element}>"))


def field(text: Column, path: str, kind: str) -> Column:
    """A field of a JSON text, null where the text or the field is bad."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)
