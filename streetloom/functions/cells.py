"""Nested cells: paths into them, their distinct values, merged maps, and JSON for files that hold no nesting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def extract(schema: StructType, path: str, tags: str = "tags") -> Column:
    """A value by its name among the tags, else among the fields, or by a dotted path through fields and maps.

    What the schema does not have is null. Values are strings, nested ones as JSON.
    """
    if "." not in path:
        found = [F.element_at(F.col(tags), path)] if tags in schema.names else []
        found += [_text(F.col(path), schema[path].dataType)] if path in schema.names else []
        return F.coalesce(*found) if found else F.lit(None).cast("string")
    first, *parts = path.split(".")
    if first not in schema.names:
        return F.lit(None).cast("string")
    at, kind = F.col(first), schema[first].dataType
    for part in parts:
        if isinstance(kind, StructType) and part in kind.names:
            at, kind = at.getField(part), kind[part].dataType
        elif isinstance(kind, MapType):
            at, kind = F.element_at(at, part), kind.valueType
        else:
            return F.lit(None).cast("string")
    return _text(at, kind)


def _text(value: Column, kind: DataType) -> Column:
    return to_cell(value, kind) if nested(kind) else value.cast("string")


def nested(kind: DataType) -> bool:
    return isinstance(kind, (ArrayType, MapType, StructType))


def to_cell(value: Column, kind: DataType) -> Column:
    """A nested value as JSON; others as they are."""
    return F.to_json(value, {"ignoreNullFields": "false"}) if nested(kind) else value


def from_cell(value: Column, kind: DataType) -> Column:
    """What `to_cell` wrote, as it was."""
    return F.from_json(value, kind) if nested(kind) else value


def unique_values(value: Column) -> Column:
    """Aggregate: the distinct values that are not null, in order."""
    return F.sort_array(F.collect_set(value))


def scalar_or_list(values: Column) -> Column:
    """Aggregated values as JSON: the only one alone, several as a list, none as null."""
    return F.when(F.size(values) == 1, F.element_at(values, 1).cast("string")).when(F.size(values) > 1, F.to_json(values))


def merged(maps: Column) -> Column:
    """Maps of an array as one; of equal keys the last value counts. Missing maps are passed over."""
    maps = F.filter(maps, lambda m: m.isNotNull())
    keys = F.array_distinct(F.flatten(F.transform(maps, F.map_keys)))
    last = lambda k: F.element_at(F.filter(maps, lambda m: F.map_contains_key(m, k)), -1)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(last(k), k)))
