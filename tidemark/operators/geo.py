"""Geospatial operators on latitude/longitude columns in degrees, sphere of 6371 km."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import HOT_ROWS, salt
from tidemark.operators.ordered import framed, null_safe_join
from tidemark.session import materialize, shuffle_partitions

# Sphere radius, pairs a task and units per kilometre.
EARTH_KM = 6371.0
TASK_PAIRS = 8_000_000  # candidate pairs that one task of a radius join compares
UNITS = {"km": 1.0, "miles": 0.621371, "m": 1000.0}


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "km") -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    s, t = F.sin(dlat / 2), F.sin(dlon / 2)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t
    return F.lit(EARTH_KM * UNITS[unit]) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def within_radius(df: DataFrame, lat: str, lon: str, center: tuple[float, float], km: float) -> DataFrame:
    """Points at most ``km`` from the centre; a latitude band prunes the scan first."""
    band = math.degrees(km / EARTH_KM)
    near = F.col(lat).between(center[0] - band, center[0] + band)
    return df.where(near & (haversine(F.col(lat), F.col(lon), F.lit(center[0]), F.lit(center[1])) <= km))


def radius_join(a: DataFrame, b: DataFrame, km: float, *, a_id: str, b_id: str) -> DataFrame:
    """Pairs within ``km`` of two tables (id, lat, lon).

    Equi-join on grid cells: latitude bands as high as the radius, and in each
    band longitude cells at least as wide as the radius reaches there (one cell
    around the poles, wrapping at 180 degrees).  Each ``a`` row visits the
    neighbouring cells.  The candidates of a cell are counted first: the join has a
    partition per TASK_PAIRS of them, and cells with more are cut on both sides.
    The chord between two points decides, and the distance only near the limit.
    """
    delta = km / EARTH_KM
    height = math.degrees(delta) * (1 + 1e-9)

    def cells(band: Column) -> Column:
        far = F.greatest(F.abs(band * height), F.abs((band + 1) * height))  # latitude farthest from the equator
        ratio = F.lit(math.sin(min(delta, math.pi / 2))) / F.cos(F.radians(far))
        reach = F.degrees(F.asin(ratio)) * (1 + 1e-9)
        return F.when((far + height >= 90) | (ratio >= 1), F.lit(1)).otherwise(F.greatest(F.floor(360 / reach), F.lit(1))).cast("long")

    def cell(lon: Column, n: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * n), n)

    def place(lat: Column, lon: Column, prefix: str) -> list[Column]:
        flat = F.cos(F.radians(lat))
        return [c.alias(f"{prefix}{n}") for n, c in (("x", flat * F.cos(F.radians(lon))), ("y", flat * F.sin(F.radians(lon))), ("z", F.sin(F.radians(lat))))]

    home = F.floor(F.col("lat") / height)
    right = b.select(F.col(b_id).alias("_b_id"), "lat", "lon", home.alias("_band"), *place(F.col("lat"), F.col("lon"), "_b"))
    right = right.withColumn("_cell", cell(F.col("lon"), cells(F.col("_band"))))
    left = a.select(F.col(a_id).alias("_a_id"), F.col("lat").alias("_alat"), F.col("lon").alias("_alon"), *place(F.col("lat"), F.col("lon"), "_a"),
                    F.explode(F.sequence(F.floor(F.col("lat") / height) - 1, F.floor(F.col("lat") / height) + 1)).alias("_band"))
    left = left.withColumn("_n", cells(F.col("_band")))
    own = cell(F.col("_alon"), F.col("_n"))
    left = left.withColumn("_cell", F.explode(F.array_distinct(F.array(own, F.pmod(own + 1, F.col("_n")), F.pmod(own - 1 + F.col("_n"), F.col("_n")))))).drop("_n")

    keys = ["_band", "_cell"]
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb")), keys)
    sizes = materialize(sizes.withColumn("_pairs", F.col("_na") * F.col("_nb")), "cells")
    total = sizes.agg(F.sum("_pairs"), F.sum("_na"), F.sum("_nb")).first()  # one row
    parts = max(shuffle_partitions(a.sparkSession), math.ceil((total[0] or 0) / TASK_PAIRS), math.ceil(((total[1] or 0) + (total[2] or 0)) / HOT_ROWS))
    by_b = F.least(F.col("_nb"), F.ceil(F.col("_pairs") / TASK_PAIRS))
    by_a = F.ceil(F.col("_pairs") / (by_b * TASK_PAIRS))
    hot = sizes.where(F.col("_pairs") > TASK_PAIRS).select(*keys, by_b.cast("int").alias("_sb"), F.least(by_a, F.col("_na")).cast("int").alias("_sa"))

    def cut(side: DataFrame, row_id: str, mine: str, other: str) -> DataFrame:
        """Deals the rows of hot cells over this side's pieces, once for each piece of the other."""
        side = side.join(hot, keys, "left").withColumns({
            f"_p{mine}": F.coalesce(F.pmod(F.xxhash64(row_id), F.col(f"_s{mine}")), F.lit(0)).cast("int"),
            f"_p{other}": F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"_s{other}"), F.lit(1)) - 1))})
        return side.drop("_sa", "_sb").repartition(parts, *keys, "_pa", "_pb")

    left, right = cut(left, "_a_id", "a", "b"), cut(right, "_b_id", "b", "a")
    d = left.hint("merge").join(right, [*keys, "_pa", "_pb"])
    chord = sum(((F.col(f"_a{n}") - F.col(f"_b{n}")) * (F.col(f"_a{n}") - F.col(f"_b{n}")) for n in "xyz"), F.lit(0.0))
    limit = 4 * math.sin(min(delta, math.pi) / 2) ** 2
    d = d.where(chord <= limit * (1 + 1e-9) + 1e-12)
    exact = haversine(F.col("_alat"), F.col("_alon"), F.col("lat"), F.col("lon"))
    # only pairs that stand near the limit need their distance to be judged
    d = d.where((chord <= limit * (1 - 1e-6) - 1e-12) | (exact <= km)).withColumn("distance_km", exact)
    return d.select(F.col("_a_id").alias(a_id), F.col("_b_id").alias(b_id), "distance_km")


def bounding_box(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


def centroid(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def polygon_join(points: DataFrame, polygons: DataFrame, *, point_id: str, polygon_id: str, cell: float = 5.0) -> DataFrame:
    """(point, polygon) pairs with the point inside, by ray casting.

    ``polygons`` is a vertex table (polygon_id, seq, lat, lon).  Bounding boxes are
    cut into grid cells for an equi-join with the points; the surviving candidates
    meet the polygon's edges and an odd number of crossings means inside.
    """
    edges = framed(polygons, [polygon_id], ["seq"], lambda w: {"_plat": F.lag("lat").over(w), "_plon": F.lag("lon").over(w)}, before=1)
    last = polygons.groupBy(polygon_id).agg(F.max_by(F.struct("lat", "lon"), "seq").alias("_last"))
    edges = null_safe_join(edges, last, [polygon_id]).select(
        polygon_id, F.col("lat").alias("ilat"), F.col("lon").alias("ilon"),
        F.coalesce("_plat", "_last.lat").alias("jlat"), F.coalesce("_plon", "_last.lon").alias("jlon"))
    edges = edges.where("ilon <> jlon")  # a meridian edge never straddles
    boxes = bounding_box(polygons, [polygon_id])
    g = lambda c: F.floor(F.col(c) / cell)
    tiles = boxes.withColumn("_cy", F.explode(F.sequence(g("min_lat"), g("max_lat")))).withColumn("_cx", F.explode(F.sequence(g("min_lon"), g("max_lon"))))
    p = points.select(point_id, "lat", "lon", g("lat").alias("_cy"), g("lon").alias("_cx"))
    sizes = p.groupBy("_cy", "_cx").agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > HOT_ROWS).select("_cy", "_cx", F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_s"))
    p, tiles = salt(p, tiles, hot, ["_cy", "_cx"], F.col(point_id))
    near = p.join(tiles, ["_cy", "_cx", "_salt"]).where(
        F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon")))
    x, y = F.col("lon"), F.col("lat")
    straddles = (F.col("ilon") > x) != (F.col("jlon") > x)
    below = y < (F.col("jlat") - F.col("ilat")) * (x - F.col("ilon")) / (F.col("jlon") - F.col("ilon")) + F.col("ilat")
    hits = near.select(point_id, polygon_id, "lat", "lon").join(edges, polygon_id).where(straddles & below)
    return hits.groupBy(point_id, polygon_id).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select(point_id, polygon_id)
