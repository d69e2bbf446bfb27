"""Geometry on latitudes and longitudes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule; ``ring`` is an array of (lon, lat) structs, closed or not."""
    n = F.size(ring)
    edges = F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.element_at(ring, F.when(i == 0, n).otherwise(i).cast("int")).alias("b")))

    def crosses(e: Column) -> Column:
        straddles = (e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)
        at = (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / F.when(e["b"]["lat"] == e["a"]["lat"], F.lit(1e-12)).otherwise(e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"]
        return straddles & (lon < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (min lat, max lat, min lon, max lon), borders included."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def cell(value: Column, degrees: float) -> Column:
    return F.floor(value / degrees)
