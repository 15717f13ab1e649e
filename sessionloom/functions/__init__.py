"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(x: Column) -> Column:
    """Truncation towards zero, as long."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def share(part: Column, total: Column, of: float) -> Column:
    """of * part / total, NULL where total is 0."""
    return F.try_divide(part.cast("double"), total.cast("double")) * of


def sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0))).cast("long")


def least_of(columns: Sequence[Column]) -> Column:
    """The least that is not NULL, of one column or more."""
    return F.least(*columns) if len(columns) > 1 else columns[0]


def any_of(conditions: Sequence[Column]) -> Column:
    """OR in which NULL counts as false."""
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        return (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda acc, x: acc + x)


def spread(seed: int, *keys: Column) -> Column:
    """A pseudo-random order from integer keys that plain SQL can compute as well; a round for each key and a last
    one, without which neighbouring keys would stay neighbours."""
    out = F.lit(seed).cast("long")
    for k in (*keys, F.lit(0)):
        out = F.pmod(out * F.lit(1_103_515_245).cast("long") + k.cast("long") + F.lit(12_345), F.lit(2_147_483_647).cast("long"))
    return out
