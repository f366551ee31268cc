"""Distances, boxes and map tiles as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.table import ColumnDef, RequestError

EARTH_METERS = 6_371_008.8
MERCATOR_LAT = math.degrees(math.atan(math.sinh(math.pi)))


def checked_point(p: dict) -> tuple[float, float]:
    if set(p) != {"lat", "lon"} or not all(math.isfinite(x) for x in p.values()) or abs(p["lat"]) > 90 or abs(p["lon"]) > 180:
        raise RequestError(f"bad point {p}")
    return float(p["lat"]), float(p["lon"])


def checked_bounds(b: dict) -> tuple[float, float, float, float]:
    """(south, north, west, east)."""
    (north, west), (south, east) = checked_point(b["top_left"]), checked_point(b["bottom_right"])
    if north < south:
        raise RequestError("bounds go from north to south")
    return south, north, west, east


def haversine(point: Column, lat: float, lon: float) -> Column:
    dlat, dlon = F.radians(point["lat"] - F.lit(lat)), F.radians(point["lon"] - F.lit(lon))
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(F.lit(lat))) * F.cos(F.radians(point["lat"])) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return F.lit(2 * EARTH_METERS) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def any_point(column: ColumnDef, test) -> Column:
    c = F.col(column.name)
    return F.exists(c, test) if column.is_array else test(c)


def in_box(point: Column, south: float, north: float, west: float, east: float) -> Column:
    inside = point["lat"].between(south, north)
    if west > east:  # across the antimeridian
        return inside & ((point["lon"] >= west) | (point["lon"] <= east))
    return inside & point["lon"].between(west, east)


def near(column: ColumnDef, lat: float, lon: float, meters: float) -> Column:
    """Within a radius: a box that holds the circle is tested first, and reaches the scan for single points."""
    if not math.isfinite(meters) or meters < 0:
        raise RequestError("the radius is finite and not negative")
    reach = math.degrees(meters / EARTH_METERS) * (1 + 1e-9) + 1e-9
    south, north = lat - reach, lat + reach
    box = lambda p: p["lat"].between(south, north)
    if south > -90 and north < 90:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat))))) * (1 + 1e-9) + 1e-9
        if wide < 180 and lon - wide >= -180 and lon + wide <= 180:
            box = lambda p: p["lat"].between(south, north) & p["lon"].between(lon - wide, lon + wide)
    return any_point(column, lambda p: box(p) & (haversine(p, lat, lon) <= meters))


def distance(column: ColumnDef, lat: float, lon: float, mode: str = "min") -> Column:
    """Meters to the nearest or farthest point, or their mean; null where there is no point."""
    c = F.col(column.name)
    if not column.is_array:
        return haversine(c, lat, lon)
    all_ = F.transform(c, lambda p: haversine(p, lat, lon))
    if mode == "average":
        return F.when(F.size(c) > 0, F.aggregate(all_, F.lit(0.0), lambda a, x: a + x) / F.size(c))
    return {"min": F.array_min, "max": F.array_max}[mode](all_)


def tile_xy(point: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator tile of a point; latitudes are clamped and 180 east is 180 west."""
    n = float(2**zoom)
    lon = F.when(point["lon"] == 180, F.lit(-180.0)).otherwise(point["lon"])
    lat = F.radians(F.least(F.greatest(point["lat"], F.lit(-MERCATOR_LAT)), F.lit(MERCATOR_LAT)))
    cell = lambda v: F.least(F.greatest(F.floor(v * n), F.lit(0)), F.lit(2**zoom - 1))
    return cell((lon + 180) / 360), cell((F.lit(1.0) - F.asinh(F.tan(lat)) / math.pi) / 2)
