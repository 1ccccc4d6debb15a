"""Sizes and places of drawings: affine maps as structs, and what group scaling leaves of an extent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """The map (x, y) -> (a x + c y + e, b x + d y + f)."""
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), e.alias("e"), f.alias("f"))


def after(m: Column, n: Column) -> Column:
    """The map that does ``m`` first and then ``n``."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"], m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"], m["e"] * n["a"] + m["f"] * n["c"] + n["e"], m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def extent(m: Column) -> Column:
    """(width, height) of a unit square under a map."""
    return F.struct(F.hypot(m["a"], m["b"]).alias("width"), F.hypot(m["c"], m["d"]).alias("height"))


def group_scaled(size: Column, groups: Column) -> Column:
    """A size within nested groups, each with its extent ``ext`` and its child extent ``chext``; groups without one scale by 1."""
    return F.aggregate(groups, size.cast("double"), lambda acc, g: acc * F.when(g["chext"] > 0, g["ext"] / g["chext"]).otherwise(F.lit(1.0)))
