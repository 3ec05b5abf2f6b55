"""Joins of boxes and points on pages through a grid.

A box is dealt to the cells that it touches, a point to its own; only what shares a page and a cell is compared.  Two boxes may
share several cells: the pair counts in the cell of its reference point, the corner where the overlap begins, so no
pair comes twice and nothing has to be made distinct.  The exact test decides.  Rows without a page or with a coordinate
missing or NaN meet nothing; a box with its corners exchanged is tested as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edge of a cell, in units of the page.
CELL = 64.0

_EDGES = ("x0", "y0", "x1", "y1")


def _at(c: Column, cell: float) -> Column:
    return F.floor(c / cell)


def _known(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    good = F.col("page").isNotNull()
    for c in columns:
        good &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(good)


def dealt(boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """``boxes`` with cx, cy: a row for each cell that a box touches."""
    span = lambda a, b: F.sequence(_at(F.least(a, b), cell), _at(F.greatest(a, b), cell))
    wide = _known(boxes, _EDGES).withColumn("cx", F.explode(span(F.col("x0"), F.col("x1"))))
    return wide.withColumn("cy", F.explode(span(F.col("y0"), F.col("y1"))))


def boxes_meet(one: DataFrame, other: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of boxes that overlap by more than an edge: structs ``a`` and ``b`` of the columns of both sides, each pair of rows once."""
    pack = lambda df, name: dealt(df, cell).select("page", "cx", "cy", F.struct(*df.columns).alias(name))
    a, b = F.col("a"), F.col("b")
    met = (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["y0"] < b["y1"]) & (a["y1"] > b["y0"])
    begins = lambda lo, hi: _at(F.greatest(F.least(a[lo], a[hi]), F.least(b[lo], b[hi])), cell)
    once = (begins("x0", "x1") == F.col("cx")) & (begins("y0", "y1") == F.col("cy"))
    return pack(one, "a").join(pack(other, "b"), ["page", "cx", "cy"]).where(met & once).select("a", "b")


def points_outside(points: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """The rows of points(page, x, y, ...) that lie in none of the boxes of their page; edges count as inside."""
    edges = dealt(boxes, cell).select(*(F.col(c).alias(f"_{c}") for c in ("page", "cx", "cy", *_EDGES))).alias("b")
    p = points.alias("p")
    same = (F.col("p.page") == F.col("b._page")) & (_at(F.col("p.x"), cell) == F.col("b._cx")) & (_at(F.col("p.y"), cell) == F.col("b._cy"))
    inside = F.col("p.x").between(F.col("b._x0"), F.col("b._x1")) & F.col("p.y").between(F.col("b._y0"), F.col("b._y1"))
    return p.join(edges, same & inside, "left_anti")
