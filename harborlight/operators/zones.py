"""Positions inside zones: a grid-cell hash join followed by an exact containment test.

Each zone is cut into grid cells, and a cell carries only the zone's edges that pass through it, with the
parity of one reference point in it. A position is inside if the way from it to the reference point, which
does not leave the cell, meets edges in number that says so. So a zone of many points costs each position
what its cell holds, and the zone side grows with the edges. A cell without edges lies wholly inside or outside.
The zone side joins by cell; Spark broadcasts it when its size is below the broadcast threshold and
otherwise shuffles, with skewed cells split by adaptive execution. No hint overrides that choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import geo

CELL_DEGREES = 0.5
#: Where the reference point lies in its cell, as a share of its sides: not on round coordinates, where zones have their points.
REFERENCE = 0.41421356237
#: Degrees by which a cell is taken larger when its edges are looked for, against rounding.
MARGIN = 1e-9


def with_edges(zones: DataFrame) -> DataFrame:
    """Add `edges` (array of struct(x1, y1, x2, y2)) and the bounding box of each zone."""

    def ring_edges(ring: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(ring) - 1),
            lambda i: F.struct(
                F.element_at(ring, i)["x"].alias("x1"),
                F.element_at(ring, i)["y"].alias("y1"),
                F.element_at(ring, i + 1)["x"].alias("x2"),
                F.element_at(ring, i + 1)["y"].alias("y2"),
            ),
        )

    closed = F.filter("rings", lambda r: F.size(r) >= 4)
    points = F.flatten(F.col("rings"))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return zones.select(
        "*",
        F.flatten(F.transform(closed, ring_edges)).alias("edges"),
        F.struct(
            F.array_min(ys).alias("min_lat"),
            F.array_min(xs).alias("min_lon"),
            F.array_max(ys).alias("max_lat"),
            F.array_max(xs).alias("max_lon"),
        ).alias("bbox"),
    )


def zone_edges(zones: DataFrame) -> DataFrame:
    """One row per edge: zone_id, i, x1, y1, x2, y2."""
    return (
        with_edges(zones)
        .select("zone_id", F.posexplode("edges").alias("i", "e"))
        .select("zone_id", "i", "e.x1", "e.y1", "e.x2", "e.y2")
    )


def _passes(e: Column, west: Column, south: Column, size: float) -> Column:
    """The edge may pass through the cell: its box meets the cell, and the cell's corners don't all lie on one side of it."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    sides = [
        dx * (south + (size + MARGIN if up else -MARGIN) - e["y1"]) - dy * (west + (size + MARGIN if right else -MARGIN) - e["x1"])
        for up in (False, True) for right in (False, True)
    ]
    return (
        (F.least(e["x1"], e["x2"]) <= west + size + MARGIN) & (F.greatest(e["x1"], e["x2"]) >= west - MARGIN)
        & (F.least(e["y1"], e["y2"]) <= south + size + MARGIN) & (F.greatest(e["y1"], e["y2"]) >= south - MARGIN)
        & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
    )


def _reference(cell: str, size: float) -> Column:
    return (F.col(cell) + REFERENCE) * F.lit(size)


def _meets_level(e: Column, y) -> Column:
    return (e["y1"] > y) != (e["y2"] > y)


def _x_at(e: Column, y) -> Column:
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]


def zone_cells(zones: DataFrame, size: float = CELL_DEGREES) -> DataFrame:
    """One row per grid cell a zone reaches: `edges` in it and `_ref`, whether its reference point is inside.

    `_whole` cells have no edge and lie entirely inside; cells without edges outside are left out. A zone is first
    cut into rows of cells, so an edge is looked at once per row and once per cell of its rows.
    """
    box = F.col("bbox")

    def span(low: str, high: str) -> Column:
        return F.sequence(F.floor(box[low] / size).cast("int"), F.floor(box[high] / size).cast("int"))

    south, west = F.col("_cell_lat") * F.lit(size), F.col("_cell_lon") * F.lit(size)
    level = _reference("_cell_lat", size)
    rows = (
        with_edges(zones)
        .withColumn("_cell_lat", F.explode(span("min_lat", "max_lat")))
        .withColumn("edges", F.filter(
            "edges",
            lambda e: (F.least(e["y1"], e["y2"]) <= south + size + MARGIN) & (F.greatest(e["y1"], e["y2"]) >= south - MARGIN),
        ))
        .withColumn("_cuts", F.transform(F.filter("edges", lambda e: _meets_level(e, level)), lambda e: _x_at(e, level)))
    )
    cells = (
        rows.withColumn("_cell_lon", F.explode(span("min_lon", "max_lon")))
        .withColumn("edges", F.filter("edges", lambda e: _passes(e, west, south, size)))
        .withColumn("_ref", F.size(F.filter("_cuts", lambda x: x > _reference("_cell_lon", size))) % 2 == 1)
        .drop("_cuts")
    )
    return cells.withColumn("_whole", F.size("edges") == 0).where(~F.col("_whole") | F.col("_ref"))


def in_cell(lat: str, lon: str, size: float = CELL_DEGREES) -> Column:
    """Strictly inside the zone, for a position in the cell of its row of zone_cells.

    The way to the reference point runs along the position's latitude and then along the reference longitude. Edges count by
    the same half-open rules as in a ray test, so a way through a corner of the zone counts once.
    """
    x, y = F.col(lon), F.col(lat)
    ref_y, ref_x = _reference("_cell_lat", size), _reference("_cell_lon", size)

    def crossed(e: Column) -> Column:
        along = _meets_level(e, y) & ((x < _x_at(e, y)) != (ref_x < _x_at(e, y)))
        y_there = (e["y2"] - e["y1"]) * (ref_x - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0)) + e["y1"]
        up = ((e["x1"] > ref_x) != (e["x2"] > ref_x)) & ((y < y_there) != (ref_y < y_there))
        # An edge that is met on both parts of the way counts twice, which is not at all.
        return F.coalesce(along, F.lit(False)) != F.coalesce(up, F.lit(False))

    odd = F.size(F.filter("edges", crossed)) % 2 == 1
    return (F.col("_ref") != odd) & ~geo.on_edges(lat, lon, F.col("edges"))


def in_zones(positions: DataFrame, zones: DataFrame, *zone_columns: str, size: float = CELL_DEGREES) -> DataFrame:
    """Every (position, zone) pair where the position is strictly inside the zone."""
    cells = zone_cells(zones, size).select("_cell_lat", "_cell_lon", "_whole", "_ref", "edges", "bbox", *zone_columns)
    cell_lat, cell_lon = geo.grid_cell("latitude", "longitude", size)
    inside = F.col("_whole") | (geo.in_bbox("latitude", "longitude", F.col("bbox")) & in_cell("latitude", "longitude", size))
    return (
        positions.withColumn("_cell_lat", cell_lat)
        .withColumn("_cell_lon", cell_lon)
        .join(cells, ["_cell_lat", "_cell_lon"])
        .where(inside)
        .select(*positions.columns, *zone_columns)
    )
