"""Tables completed by others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_first(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of both tables; a column that both have is the left one's, where that is null the right one's."""
    both = [c for c in left.columns if c in right.columns and c not in keys]
    names = [*left.columns, *(c for c in right.columns if c not in left.columns)]
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    side = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in keys or c in both else F.col(f"a.{c}" if c in left.columns else f"b.{c}")
    return joined.select(*(side(c).alias(c) for c in names))
