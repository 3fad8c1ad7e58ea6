"""Rounding that engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | float | int | None) -> Column:
    """A column of a name, a number's literal, or the column itself."""
    if isinstance(x, str):
        return F.col(x)
    return x if isinstance(x, Column) else F.lit(x)


def rnd(x: Column, digits: int) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits: halves go up, and binary doubles give the same on every engine."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def ladder(x: Column, bounds: list[float], labels: list, closed: bool = True) -> Column:
    """The first label whose upper bound is not below x (closed) or is above x; the last label beyond all. Null gives null."""
    out = F.lit(labels[-1])
    for b, label in reversed(list(zip(bounds, labels, strict=False))):
        out = F.when(x <= b if closed else x < b, F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)


def known(flag: Column) -> Column:
    """A condition that is false where it is null: a value that was not measured proves nothing."""
    return F.coalesce(flag, F.lit(False))
