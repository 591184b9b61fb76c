"""Joins of boxes on a page with other boxes on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meet_boxes(left: DataFrame, right: DataFrame, keys: list[str], a: list[str], b: list[str], width: float, height: float, across: int = 16, down: int = 18) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose boxes ``a`` (of ``left``) and ``b`` may overlap, once each; the caller compares
    the boxes themselves.

    A frame of ``width`` by ``height`` is cut into ``across`` times ``down`` cells, those at its edges taking in what lies beyond it, so
    a box has at most as many. Boxes meet by keys and cell, and a pair stays in the cell that holds the upper left corner of
    what both cover. Rows with a null in their box meet nothing.
    """
    place = lambda c, size, n: F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0), F.floor(c / (size / n)).cast("double"))).cast("int")

    def cells(rows: DataFrame, box: list[str]) -> DataFrame:
        x, y, w, h = (F.col(c) for c in box)
        over = lambda c, length, size, n: F.explode(F.sequence(place(c, size, n), place(c + F.greatest(length, F.lit(0.0)), size, n)))
        return rows.dropna(subset=box).withColumn("__column", over(x, w, width, across)).withColumn("__row", over(y, h, height, down))

    def corner(k: int) -> Column:
        return F.greatest(a[k], b[k])

    rows = cells(left, a).join(cells(right, b), [*keys, "__column", "__row"])
    rows = rows.filter((F.col("__column") == place(corner(0), width, across)) & (F.col("__row") == place(corner(1), height, down)))
    return rows.drop("__column", "__row")
