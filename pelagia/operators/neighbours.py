"""Positions within a distance of each other: pairs of cells are settled as all, none, or split further."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions.geo import EARTH_RADIUS_KM, haversine_km, unit_vector
from pelagia.operators.farthest import AXES, FINEST, LEVELS, PAIRS_PER_POINT, at_level, balls, length, side
from pelagia.operators.graph import connected_components
from pelagia.session import cut_lineage

MARGIN = 1e-9  # of a chord, around the limit: pairs of points that near to it are always measured
CELL = ["row", "col"]


def located(points: DataFrame, key: str) -> DataFrame:
    """(id, lat, lon, unit vector, finest cell) of the points that have a position."""
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    known = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    return known.select(
        F.lit(0).alias("all"), F.col(key).alias("id"), "lat", "lon", x.alias("x"), y.alias("y"), z.alias("z"),
        F.floor((F.col("lat") + 90) / FINEST).alias("_row"), F.floor((F.col("lon") + 180) / FINEST).alias("_col"),
    )


def chord_range() -> tuple[Column, Column]:
    """Least and greatest chord that any two points of two cells can have."""
    at = lambda name, s: [F.col(f"{c}_{name}_{s}") for c in AXES]
    boxes = list(zip(at("low", "a"), at("high", "a"), at("low", "b"), at("high", "b")))
    both = F.col("radius_a") + F.col("radius_b")
    apart = length([x - y for x, y in zip(at("mean", "a"), at("mean", "b"))])
    gap = length([F.greatest(F.lit(0.0), la - hb, lb - ha) for la, ha, lb, hb in boxes])
    reach = length([F.greatest(ha - lb, hb - la) for la, ha, lb, hb in boxes])
    return F.greatest(apart - both, gap), F.least(apart + both, reach)


def cell_pairs(points: DataFrame, level: int, above: DataFrame | None) -> DataFrame:
    """Pairs of cells of a level, each once: all of them, or those within the pairs ``above`` of the level before."""
    cells = balls(at_level(points, level), "all")
    a, b = side(cells, "all", "a"), side(cells, "all", "b")
    ordered = F.struct("row_a", "col_a") <= F.struct("row_b", "col_b")
    if above is None:
        return a.join(b, "all").where(ordered)
    over = above.select("all", *[F.col(f"{c}_{s}").alias(f"up_{c}_{s}") for s in "ab" for c in CELL])
    for s, cell in (("a", a), ("b", b)):
        inside = cell.withColumn(f"up_row_{s}", F.shiftright(f"row_{s}", 2)).withColumn(f"up_col_{s}", F.shiftright(f"col_{s}", 2))
        over = over.join(inside, ["all", f"up_row_{s}", f"up_col_{s}"])
    same = (F.col("up_row_a") == F.col("up_row_b")) & (F.col("up_col_a") == F.col("up_col_b"))
    return over.where(~same | ordered)


def settled(points: DataFrame, level: int, above: DataFrame | None, chord: float) -> DataFrame:
    """Pairs of cells that may hold points within ``chord``; ``linked`` says that all their points are."""
    least, most = chord_range()
    pairs = cell_pairs(points, level, above).where(least <= chord + MARGIN)
    ends = [f"{c}_{s}" for s in "ab" for c in CELL]
    return cut_lineage(pairs.select("all", *ends, (F.col("n_a") * F.col("n_b")).alias("work"), (most < chord - MARGIN).alias("linked")))


def opened(pairs: DataFrame, points: DataFrame, level: int, columns: list[str]) -> DataFrame:
    """Pairs of points of pairs of cells, once each: ``columns`` with ``_a`` and ``_b``, the lesser id in a."""
    cells = at_level(points, level).select("row", "col", *columns)
    met = pairs.select(*[f"{c}_{s}" for s in "ab" for c in CELL])
    for s in "ab":
        met = met.join(cells.select(*[F.col(c).alias(f"{c}_{s}") for c in [*CELL, *columns]]), [f"row_{s}", f"col_{s}"])
    one = (F.col("row_a") == F.col("row_b")) & (F.col("col_a") == F.col("col_b"))
    a_first = F.col("id_a") < F.col("id_b")
    pick = lambda c, s, t: F.when(a_first, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{t}"))
    once = met.where(a_first | (~one & (F.col("id_a") > F.col("id_b"))))
    return once.select(*[pick(c, "a", "b").alias(f"{c}_a") for c in columns], *[pick(c, "b", "a").alias(f"{c}_b") for c in columns])


def limit_of(max_km: float | None, radius: float) -> float:
    """The chord of a distance; beyond half the circumference every pair is within it."""
    return 3.0 if max_km is None or max_km >= math.pi * radius else 2.0 * math.sin(max_km / (2.0 * radius))


def neighbours_within(points: DataFrame, key: str, max_km: float | None = None, radius: float = EARTH_RADIUS_KM) -> DataFrame:
    """(id_a, id_b, km) of all pairs (a < b) of points no more than ``max_km`` apart; without it, of all pairs.

    ``key`` is unique. Pairs of cells that are within the limit as a whole are opened as they are, those beyond it are
    dropped, the rest is split until few pairs of points are left to be measured; no point list is ever sent anywhere.
    Points without a position have no pairs.
    """
    placed = cut_lineage(located(points, key))
    total, chord = placed.count(), limit_of(max_km, radius)
    done, above = [], None
    columns = ["id", "lat", "lon"]
    for level in range(LEVELS):
        pairs = settled(placed, level, above, chord)
        rest = pairs.where("not linked")
        work = rest.agg(F.sum("work")).first()[0] or 0
        last = level == LEVELS - 1 or work <= PAIRS_PER_POINT * total
        done.append(opened(pairs if last else pairs.where("linked"), placed, level, columns))
        if last:
            break
        above = rest
    every = reduce(DataFrame.unionByName, done)
    km = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"), radius)
    out = every.select("id_a", "id_b", km.alias("km"))
    return out if max_km is None else out.where(F.col("km") <= max_km)


def linked_groups(points: DataFrame, key: str, max_km: float, radius: float = EARTH_RADIUS_KM) -> DataFrame:
    """(id, component) of points joined by steps shorter than ``max_km``; the component is its least id.

    Cells whose points are all linked with another cell's, or with each other, hang together as a whole: an edge for
    the pair and one for each point, not one for each pair of points. Pairs of cells that hang together already are
    dropped; of the others, those near the limit are split further, and what is left is measured point by point. So a
    crowd of points costs no more than its number.
    """
    placed = cut_lineage(located(points, key))
    total, chord = placed.count(), limit_of(max_km, radius)
    edges, above = [], None
    for level in range(LEVELS):
        pairs = settled(placed, level, above, chord)
        cells = at_level(placed, level)
        roots = cells.groupBy(*CELL).agg(F.min("id").alias("root"))
        ends = pairs.where("linked").join(roots.toDF("row_a", "col_a", "src"), ["row_a", "col_a"]).join(roots.toDF("row_b", "col_b", "dst"), ["row_b", "col_b"])
        whole = ends.select(F.inline(F.array(F.struct(F.col("row_a").alias("row"), F.col("col_a").alias("col")), F.struct(F.col("row_b").alias("row"), F.col("col_b").alias("col"))))).distinct()
        members = cells.join(whole, CELL, "left_semi").join(roots, CELL).select(F.col("id").alias("src"), F.col("root").alias("dst"))
        edges.append(cut_lineage(ends.select("src", "dst").unionByName(members).where("src <> dst").distinct()))
        known = connected_components(reduce(DataFrame.unionByName, edges))
        labels = placed.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        labels = cut_lineage(labels)
        named = at_level(labels, level).groupBy(*CELL).agg(F.min("component").alias("low"), F.max("component").alias("high"))
        rest = pairs.where("not linked").join(named.toDF("row_a", "col_a", "low_a", "high_a"), ["row_a", "col_a"]).join(named.toDF("row_b", "col_b", "low_b", "high_b"), ["row_b", "col_b"])
        rest = cut_lineage(rest.where("not (low_a = high_a and low_a = low_b and low_b = high_b)").select(*pairs.columns))
        work = rest.agg(F.sum("work")).first()[0] or 0
        if level == LEVELS - 1 or work <= PAIRS_PER_POINT * total:
            break
        above = rest
    met = opened(rest, labels, level, ["id", "lat", "lon", "component"]).where("component_a <> component_b")
    km = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"), radius)
    near = met.where(km < max_km).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    found = connected_components(reduce(DataFrame.unionByName, [*edges, near]))
    return placed.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
