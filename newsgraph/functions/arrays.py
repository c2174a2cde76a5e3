"""Arrays of one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c made once, however often f names it: in a one-element array."""
    return F.transform(F.array(c), f)[0]


def first_of_key(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in order. Where keys repeat, items are sorted by key and place, and back, so that long arrays aren't searched once an item."""

    def first(all_: Column) -> Column:
        placed = F.sort_array(F.transform(all_, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"), x.alias("x"))))
        kept = _bound(placed, lambda s: F.filter(s, lambda y, k: (k == 0) | ~y["key"].eqNullSafe(F.get(s, k - 1)["key"])))
        return F.transform(F.sort_array(F.transform(kept, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x")))), lambda y: y["x"])

    return _bound(items, lambda all_: F.when(F.size(F.array_distinct(F.transform(all_, key))) == F.size(all_), all_).otherwise(first(all_)))
