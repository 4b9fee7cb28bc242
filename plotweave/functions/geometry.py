"""Planar and Web Mercator geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edge length in pixels of the world at zoom 0.
WORLD_PIXELS = 512


def point_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def in_rect(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """Inside an axis-aligned rectangle, all edges included."""
    return x.between(left, left + width) & y.between(top, top + height)


# --- rings and edges -------------------------------------------------------------------------------


def ring_edges(ring: Column) -> Column:
    """Directed edges of one ring; the last vertex connects to the first, so an open ring is closed."""
    n = F.size(ring)
    ends = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        ends,
        lambda a, b: F.struct(a.x.alias("x1"), a.y.alias("y1"), b.x.alias("x2"), b.y.alias("y2")),
    )


def polygon_edges(rings: Column) -> Column:
    """Edges of all rings. Under the even-odd rule holes need no special care."""
    return F.flatten(F.transform(rings, ring_edges))


def edge_crossed(edge: Column, x: Column, y: Column) -> Column:
    """A ray from (x, y) to the right meets the edge: half-open in y, strict in x.

    try_divide, because the optimizer may evaluate the division for horizontal edges too.
    """
    straddles = (edge.y1 > y) != (edge.y2 > y)
    at = F.try_divide((edge.x1 - edge.x2) * (y - edge.y2), edge.y1 - edge.y2) + edge.x2
    return straddles & F.coalesce(x < at, F.lit(False))


def inside_edges(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a polygon's edges."""
    crossings = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(edge_crossed(e, x, y), 1).otherwise(0))
    return crossings % 2 == 1


def ring_signed_area(ring: Column) -> Column:
    """Shoelace area, counted from the first vertex to keep the products small."""
    x0, y0 = ring[0].x, ring[0].y
    twice = F.aggregate(
        ring_edges(ring),
        F.lit(0.0),
        lambda s, e: s + (e.x1 - x0) * (e.y2 - y0) - (e.x2 - x0) * (e.y1 - y0),
    )
    return twice / 2


def rings_bbox(rings: Column) -> Column:
    xs = F.transform(F.flatten(rings), lambda v: v.x)
    ys = F.transform(F.flatten(rings), lambda v: v.y)
    return F.struct(
        F.array_min(xs).alias("min_x"),
        F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"),
        F.array_max(ys).alias("max_y"),
    )


# --- Web Mercator ----------------------------------------------------------------------------------


def _world(lng: Column, lat: Column, zoom: float) -> tuple[Column, Column]:
    """World pixel position of a location."""
    size = WORLD_PIXELS * 2.0**zoom
    x = (lng + 180) / 360 * size
    y = (180 - F.lit(180 / math.pi) * F.log(F.tan(F.lit(math.pi / 4) + lat * (math.pi / 360)))) / 360 * size
    return x, y


def project_mercator(lng: Column, lat: Column, zoom: float, center: tuple[float, float],
                     viewport: tuple[int, int] = (0, 0)) -> Column:
    """Screen pixel of a location for a north-up map with the given centre."""
    x, y = _world(lng, lat, zoom)
    cx, cy = _world(F.lit(float(center[0])), F.lit(float(center[1])), zoom)
    return F.struct((x - cx + viewport[0] / 2).alias("x"), (y - cy + viewport[1] / 2).alias("y"))


def unproject_mercator(x: Column, y: Column, zoom: float, center: tuple[float, float],
                       viewport: tuple[int, int] = (0, 0)) -> Column:
    """Location under a screen pixel, the inverse of :func:`project_mercator`."""
    size = WORLD_PIXELS * 2.0**zoom
    cx, cy = _world(F.lit(float(center[0])), F.lit(float(center[1])), zoom)
    wx, wy = x + cx - viewport[0] / 2, y + cy - viewport[1] / 2
    lng = wx / size * 360 - 180
    lat = F.lit(360 / math.pi) * F.atan(F.exp((180 - wy / size * 360) * (math.pi / 180))) - 90
    return F.struct(lng.alias("lng"), lat.alias("lat"))


def tile_key(lng: Column, lat: Column, z: int) -> Column:
    """Address of the map tile that holds a location; the outermost tiles absorb the rim.

    The map ends at 85.06 degrees: latitudes beyond belong to the first and last row. Null places have null tiles.
    """
    n = 2**z
    x, y = _world(lng, F.when(lat.isNotNull(), F.greatest(F.lit(-89.0), F.least(F.lit(89.0), lat))), 0)
    last = F.lit(n - 1).cast("bigint")
    clamp = lambda c: F.when(c.isNotNull(), F.least(F.greatest(F.floor(c / WORLD_PIXELS * n).cast("bigint"), F.lit(0).cast("bigint")), last))
    return F.struct(F.lit(z).alias("z"), clamp(x).alias("x"), clamp(y).alias("y"))


# --- four-corner labels ----------------------------------------------------------------------------


def corners_nest(row: Column | None = None) -> Column:
    """The eight flat columns as one nested struct."""
    get = F.col if row is None else row.getField

    def corner(name: str) -> Column:
        return F.struct(get(f"{name}_lng").alias("lng"), get(f"{name}_lat").alias("lat"))

    return F.struct(
        corner("top_left").alias("topLeft"),
        corner("top_right").alias("topRight"),
        corner("bottom_right").alias("bottomRight"),
        corner("bottom_left").alias("bottomLeft"),
    )


def corners_flatten(corners: Column) -> list[Column]:
    """The nested struct as eight flat columns."""
    nested = {"top_left": "topLeft", "top_right": "topRight", "bottom_right": "bottomRight", "bottom_left": "bottomLeft"}
    return [
        corners.getField(field).getField(axis).alias(f"{flat}_{axis}")
        for flat, field in nested.items()
        for axis in ("lng", "lat")
    ]


def corners_to_ring(corners: Column) -> Column:
    """[[lng, lat] x 4] in the order top left, top right, bottom right, bottom left."""
    return F.array(*[
        F.array(corners.getField(f).lng, corners.getField(f).lat)
        for f in ("topLeft", "topRight", "bottomRight", "bottomLeft")
    ])


def corners_centroid(corners: Column) -> Column:
    fields = ("topLeft", "topRight", "bottomRight", "bottomLeft")

    def mean(axis: str) -> Column:
        a, b, c, d = (corners.getField(f).getField(axis) for f in fields)
        return (a + b + c + d) / 4

    return F.struct(mean("lng").alias("lng"), mean("lat").alias("lat"))


def round_corner(value: Column) -> Column:
    """Six decimals, about a tenth of a metre."""
    return F.round(value, 6)


def bbox_reorder(bbox: Column) -> Column:
    """[south, north, west, east] as [[west, south], [east, north]]."""
    return F.array(F.array(bbox[2], bbox[0]), F.array(bbox[3], bbox[1]))


def bilinear(corners: Column, u: Column, v: Column) -> Column:
    """Location at the sheet fraction (u, v), u to the right and v downwards."""

    def blend(axis: str) -> Column:
        tl, tr, br, bl = (corners.getField(f).getField(axis) for f in ("topLeft", "topRight", "bottomRight", "bottomLeft"))
        return (1 - v) * ((1 - u) * tl + u * tr) + v * ((1 - u) * bl + u * br)

    return F.struct(blend("lng").alias("lng"), blend("lat").alias("lat"))
