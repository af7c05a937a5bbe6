"""Nearest-cell climate lookup, depth interpolation, distance bands and named places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions.geo import (
    EARTH_RADIUS_KM,
    EARTH_RADIUS_ROUNDED_KM,
    cell_centre,
    haversine_km,
    longitude_gap,
    wrap_longitude,
)
from pelagia.operators.neighbours import linked_groups, neighbours_within


def climate_profiles(grid: DataFrame) -> DataFrame:
    """One row per cell with its (depth, value) profile sorted by depth; cells without a value vanish."""
    level = F.struct("depth", "value")
    return (
        grid.where(F.col("value").isNotNull())
        .groupBy("cell_lat", "cell_lon")
        .agg(F.array_sort(F.collect_list(level)).alias("profile"))
    )


def ring_candidates(profiles: DataFrame, max_ring: int = 3) -> DataFrame:
    """For every origin cell near a usable cell: the usable cells of its first non-empty ring.

    The table only depends on the grid (at most one row per grid cell), so the rows to be
    matched are never multiplied by the ring offsets.
    """
    steps = F.sequence(F.lit(-max_ring), F.lit(max_ring))
    near = (
        profiles.select("cell_lat", "cell_lon", F.explode(steps).alias("_di"))
        .select("*", F.explode(steps).alias("_dj"))
        .select(
            (F.col("cell_lat") - F.col("_di")).alias("origin_lat"),
            wrap_longitude(F.col("cell_lon") - F.col("_dj")).alias("origin_lon"),
            F.greatest(F.abs("_di"), F.abs("_dj")).alias("ring"),
            F.struct(F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon")).alias("cell"),
        )
    )
    # A usable cell is its own first ring; only the other origins look further out.
    own = profiles.select(
        F.col("cell_lat").alias("origin_lat"),
        F.col("cell_lon").alias("origin_lon"),
        F.lit(0).alias("ring"),
        F.array(F.struct(F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"))).alias("cells"),
    )
    further = near.where("ring > 0").join(own.select("origin_lat", "origin_lon"), ["origin_lat", "origin_lon"], "left_anti")
    by_ring = further.groupBy("origin_lat", "origin_lon", "ring").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    first = F.min_by(F.struct("ring", "cells"), "ring").alias("_r")
    outer = by_ring.groupBy("origin_lat", "origin_lon").agg(first).select("origin_lat", "origin_lon", "_r.*")
    return own.unionByName(outer)


def short_way_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    """Great-circle distance with the longitude difference taken the short way round."""
    return haversine_km(lat1, F.lit(0.0), lat2, longitude_gap(lon2, lon1), radius)


def interpolate_profile(profile: Column, depth: Column) -> Column:
    """Struct of the value at a depth: exact, linear between levels, or the nearest level outside the range."""
    below = F.filter(profile, lambda p: p["depth"] <= depth)
    above = F.filter(profile, lambda p: p["depth"] >= depth)
    low = F.when(F.size(below) > 0, F.try_element_at(below, F.lit(-1))).otherwise(F.try_element_at(above, F.lit(1)))
    high = F.when(F.size(above) > 0, F.try_element_at(above, F.lit(1))).otherwise(F.try_element_at(below, F.lit(-1)))
    inside = (F.size(below) > 0) & (F.size(above) > 0)
    exact = inside & (low["depth"] == depth)
    share = F.try_divide(depth - low["depth"], high["depth"] - low["depth"])
    value = F.when(~inside | exact, low["value"]).otherwise(low["value"] + share * (high["value"] - low["value"]))
    method = (
        F.when(exact, "exact_depth")
        .when(inside, "depth_interpolated")
        .otherwise("nearest_depth_outside_available_range")
    )
    return F.when(
        F.size(profile) > 0,
        F.struct(
            value.alias("value"),
            low["depth"].alias("depth_lower"),
            high["depth"].alias("depth_upper"),
            low["value"].alias("value_lower"),
            high["value"].alias("value_upper"),
            method.alias("depth_method"),
        ),
    )


def match_climate(rows: DataFrame, grid: DataFrame, max_ring: int = 3, radius: float = EARTH_RADIUS_ROUNDED_KM) -> DataFrame:
    """Climate value at the position and depth of every row, from the nearest cell of the first usable ring.

    Two equi joins on a cell: one for the candidate cells, one for the profile of the
    chosen cell.  Rows without position or depth keep a status text.
    """
    profiles = climate_profiles(grid)
    complete = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("depth_m").isNotNull()
    placed = rows.withColumn("_olat", F.when(complete, cell_centre(F.col("lat")))).withColumn(
        "_olon", F.when(complete, cell_centre(wrap_longitude(F.col("lon"))))
    )
    candidates = ring_candidates(profiles, max_ring)
    near = placed.join(
        candidates, (F.col("_olat") == F.col("origin_lat")) & (F.col("_olon") == F.col("origin_lon")), "left"
    )
    measured = F.transform(
        "cells",
        lambda c: F.struct(
            short_way_km(F.col("lat"), F.col("lon"), c["lat"], c["lon"], radius).alias("km"),
            c["lat"].alias("lat"),
            c["lon"].alias("lon"),
        ),
    )
    chosen = near.withColumn("_best", F.array_min(measured))
    joined = chosen.join(
        profiles, (F.col("_best.lat") == F.col("cell_lat")) & (F.col("_best.lon") == F.col("cell_lon")), "left"
    )
    status = (
        F.when(~complete, "missing_lat_lon_or_depth")
        .when(F.col("ring").isNull(), f"no_value_within_{max_ring}deg")
        .when(F.col("ring") == 0, "matched_exact_1deg_cell")
        .otherwise(F.concat(F.lit("matched_neighbor_within_"), F.col("ring").cast("string"), F.lit("deg")))
    )
    return joined.withColumn("_v", interpolate_profile(F.col("profile"), F.col("depth_m"))).select(
        *rows.columns,
        F.col("_v.value").alias("climate_value"),
        "cell_lat",
        "cell_lon",
        F.col("_best.km").alias("distance_km"),
        F.col("_v.depth_lower").alias("depth_lower"),
        F.col("_v.depth_upper").alias("depth_upper"),
        F.col("_v.value_lower").alias("value_lower"),
        F.col("_v.value_upper").alias("value_upper"),
        F.col("_v.depth_method").alias("depth_method"),
        status.alias("match_status"),
    )


def nearest_place(rows: DataFrame, places: Sequence[tuple[str, float, float]], max_degrees: float, default: str) -> DataFrame:
    """Name of the place at the rounded position, else the nearest within ``max_degrees``, else ``default``.

    Places are a short literal list, searched inside each row.
    """
    listed = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for n, a, b in places]
    )
    exact = F.filter(listed, lambda p: (p["lat"] == F.round("lat", 1)) & (p["lon"] == F.round("lon", 1)))
    ranked = F.transform(
        listed,
        lambda p: F.struct(F.hypot(F.col("lat") - p["lat"], F.col("lon") - p["lon"]).alias("d"), p["name"].alias("name")),
    )
    best = F.array_min(ranked)
    name = (
        F.when(F.size(exact) > 0, exact[0]["name"]).when(best["d"] < max_degrees, best["name"]).otherwise(F.lit(default))
    )
    return rows.withColumn("place", name)


def geographic_distances(sites: DataFrame, max_km: float | None = None, radius: float = EARTH_RADIUS_KM) -> DataFrame:
    """Great-circle distance of every pair of sites (a < b), or of those no more than ``max_km`` apart."""
    return neighbours_within(sites, "site", max_km, radius).withColumnsRenamed({"id_a": "site_a", "id_b": "site_b"})


def distance_groups(points: DataFrame, key: str, max_km: float = 500.0, radius: float = EARTH_RADIUS_KM) -> DataFrame:
    """Points with the group they are linked into by steps shorter than ``max_km``; the group is its least id.

    Each position counts once, under its least id, so repeated positions add nothing.
    """
    spots = points.groupBy("lat", "lon").agg(F.min(key).alias("spot"))
    groups = linked_groups(spots, "spot", max_km, radius)
    labelled = spots.join(groups.withColumnRenamed("id", "spot"), "spot").select("lat", "lon", "component")
    return points.join(labelled, ["lat", "lon"])
