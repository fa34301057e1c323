"""Nearest of many centres (J6 for large k): a grid over the centres with an exact bound.

For every cell of a grid the nearest centre of any of its points must be one of
few: with u the smallest, over all centres, of the largest distance between the
centre and the cell, a centre farther than u from the whole cell cannot be
nearest.  The lists of cells are computed once; a point then looks up its
cell and compares itself with that list instead of all k centres.  Points
outside the grid are compared with all centres.

Ties go to the lower id, and distances are computed as in
``hubs.nearest_hub``, so both give the same ids.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTS = "_cell long, _centres array<struct<h: int, x: double, y: double>>"


def cell_lists(centres, side: int) -> tuple[tuple[float, float, float, float], list[list[int]]]:
    """(x0, y0, width, height of a cell) of a side x side grid over the centres, and each cell's candidate ids."""
    c = np.asarray(centres, dtype=float)
    x0, y0 = c.min(axis=0)
    w, h = np.maximum((c.max(axis=0) - (x0, y0)) / side, 1e-9)
    rooms = 1e-9 * (1 + np.abs(c).max())    # for rounding of the cell a point falls into
    out = []
    for row in range(side):
        lo_y, hi_y = y0 + row * h - rooms, y0 + (row + 1) * h + rooms
        near_y = np.maximum(np.maximum(lo_y - c[:, 1], c[:, 1] - hi_y), 0)
        far_y = np.maximum(np.abs(c[:, 1] - lo_y), np.abs(c[:, 1] - hi_y))
        for col in range(side):
            lo_x, hi_x = x0 + col * w - rooms, x0 + (col + 1) * w + rooms
            near = np.hypot(np.maximum(np.maximum(lo_x - c[:, 0], c[:, 0] - hi_x), 0), near_y)
            far = np.hypot(np.maximum(np.abs(c[:, 0] - lo_x), np.abs(c[:, 0] - hi_x)), far_y)
            out.append(np.flatnonzero(near <= far.min() * (1 + 1e-9) + 1e-12).tolist())
    return (float(x0), float(y0), float(w), float(h)), out


def assign_nearest(df: DataFrame, centres, lon: str = "start_lon", lat: str = "start_lat", out: str = "cluster", side: int | None = None,
                   broadcast_rows: int = 5_000_000) -> DataFrame:
    """``df`` with the id of the nearest of ``centres`` (lon, lat), whatever their number.

    ``side`` is the number of grid cells along each axis (about the root of the
    number of centres).  The lists are broadcast if they hold at most
    ``broadcast_rows`` centres in all, else joined by cell.
    """
    spark: SparkSession = df.sparkSession
    side = side or max(1, round(math.sqrt(len(centres))))
    (x0, y0, w, h), lists = cell_lists(centres, side)
    struct = lambda i: (int(i), float(centres[i][0]), float(centres[i][1]))
    rows = [(cell, [struct(i) for i in ids]) for cell, ids in enumerate(lists)] + [(-1, [struct(i) for i in range(len(centres))])]
    table = spark.createDataFrame(rows, LISTS)
    col, row = F.floor((F.col(lon) - x0) / w), F.floor((F.col(lat) - y0) / h)
    fits = col.between(0, side - 1) & row.between(0, side - 1)
    cell = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.when(fits, row * side + col).otherwise(F.lit(-1)).cast("long"))
    held = sum(len(ids) for ids in lists) + len(centres)
    side_table = F.broadcast(table) if held <= broadcast_rows else table
    x, y = F.col(lon), F.col(lat)
    best = F.array_min(F.transform("_centres", lambda c: F.struct(((x - c["x"]) * (x - c["x"]) + (y - c["y"]) * (y - c["y"])).alias("d"), c["h"].alias("h"))))
    return df.withColumn("_cell", cell).join(side_table, "_cell", "left").withColumn(out, best["h"]).drop("_cell", "_centres")
