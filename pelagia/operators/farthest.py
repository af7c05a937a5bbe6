"""Greatest distance within groups of positions: branch and bound over cells of the sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions.geo import EARTH_RADIUS_KM, unit_vector
from pelagia.session import cut_lineage

COARSEST = 64.0  # degrees
LEVELS = 12  # each level splits a cell in 4 x 4
FINEST = COARSEST / 4 ** (LEVELS - 1)
PAIRS_PER_POINT = 16  # few enough pairs of points to compare them all
ROUNDING = 1e-7  # of a bound; where the chord is near 2, a rounding error in its square is so much
AXES = "xyz"


def placed_points(points: DataFrame, group: str) -> DataFrame:
    """Distinct positions of a group as unit vectors, with their row and column in the finest grid."""
    known = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    x, y, z = unit_vector(F.col("lat"), F.col("lon"))
    return known.groupBy(group, "lat", "lon").agg(F.lit(1).alias("_one")).select(
        group, "lat", "lon", x.alias("x"), y.alias("y"), z.alias("z"),
        F.floor((F.col("lat") + 90) / FINEST).alias("_row"), F.floor((F.col("lon") + 180) / FINEST).alias("_col"),
    )


def opposite_groups(points: DataFrame, group: str) -> DataFrame:
    """(group) of those with two opposite positions, to nine digits of a degree; no two points are farther apart.

    A position and its opposite have one key, so they meet without a join.
    """
    turn = F.pmod(F.col("lon"), F.lit(360.0))
    north = (F.col("lat") > 0) | ((F.col("lat") == 0) & (turn < 180))
    mirrored = F.round(F.pmod(F.round(F.when(north, turn).otherwise(turn + 180), 9), F.lit(360.0)), 9)
    lon = F.when(F.abs("lat") < 90, mirrored).otherwise(0.0)
    met = points.where(F.col(group).isNotNull()).groupBy(group, F.round(F.abs("lat"), 9).alias("_lat"), lon.alias("_lon"))
    both = met.agg(F.bool_or(north).alias("_n"), F.bool_or(~north).alias("_s")).where("_n AND _s")
    return both.select(group).distinct()


def at_level(points: DataFrame, level: int) -> DataFrame:
    """Adds the cell of a level; finer cells lie within one coarser cell."""
    shift = 2 * (LEVELS - 1 - level)
    return points.withColumn("row", F.shiftright("_row", shift)).withColumn("col", F.shiftright("_col", shift))


def balls(points: DataFrame, group: str) -> DataFrame:
    """Number of points of a cell, their mean, the box around them, and a radius around the mean that holds the box."""
    corners = [f(c).alias(f"{c}_{name}") for c in AXES for f, name in ((F.min, "low"), (F.max, "high"), (F.avg, "mean"))]
    cells = points.groupBy(group, "row", "col").agg(F.count(F.lit(1)).alias("n"), *corners)
    off = [F.greatest(F.col(f"{c}_mean") - F.col(f"{c}_low"), F.col(f"{c}_high") - F.col(f"{c}_mean")) for c in AXES]
    return cells.withColumn("radius", length(off))


def length(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def side(cells: DataFrame, group: str, name: str) -> DataFrame:
    return cells.select(group, *[F.col(c).alias(f"{c}_{name}") for c in cells.columns if c != group])


def bounds() -> tuple[Column, Column]:
    """Least and greatest chord that the farthest points of two cells can have.

    Below: no two points are nearer than the means less both radii, and some are as far apart as the root mean square
    of all, which for unit vectors is sqrt(2 - 2 m·m'). Above: the means plus both radii, the outer faces of the boxes,
    and, for cells that face each other across the sphere, what a·b >= -1 leaves: chord^2 = 4 - |a + b|^2.
    """
    at = lambda name, s: [F.col(f"{c}_{name}_{s}") for c in AXES]
    mean_a, mean_b = at("mean", "a"), at("mean", "b")
    both = F.col("radius_a") + F.col("radius_b")
    apart = length([x - y for x, y in zip(mean_a, mean_b)])
    across = F.greatest(F.lit(0.0), length([x + y for x, y in zip(mean_a, mean_b)]) - both)
    dot = sum((x * y for x, y in zip(mean_a[1:], mean_b[1:])), mean_a[0] * mean_b[0])
    reach = [F.greatest(ha - lb, hb - la) for la, ha, lb, hb in zip(at("low", "a"), at("high", "a"), at("low", "b"), at("high", "b"))]
    least = F.greatest(apart - both, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)))
    return least, F.least(apart + both, length(reach), F.sqrt(F.greatest(F.lit(0.0), 4 - across * across)))


def candidates(points: DataFrame, group: str) -> tuple[DataFrame, int]:
    """Pairs of cells (row and column on both sides) that may hold the farthest two points, and their level.

    A pair stays while its upper bound reaches the greatest lower bound of its group. Cells are split until the pairs
    of points within the pairs of cells are a small multiple of the points. Pairs of cells are not shuffled by group: what
    the level above rules out is dropped as they are made, and the bounds, a row per group, are written before they meet.
    """
    total = points.count()
    kept = None
    for level in range(LEVELS):
        cells = balls(at_level(points, level), group)
        a, b = side(cells, group, "a"), side(cells, group, "b")
        ordered = F.struct("row_a", "col_a") <= F.struct("row_b", "col_b")
        if kept is None:
            pairs = a.join(b, group).where(ordered).withColumn("above", F.lit(0.0))
        else:
            over = kept.select(group, F.col("best").alias("above"), *[F.col(f"{c}_{s}").alias(f"up_{c}_{s}") for s in "ab" for c in ("row", "col")])
            for s, cell in (("a", a), ("b", b)):
                inside = cell.withColumn(f"up_row_{s}", F.shiftright(f"row_{s}", 2)).withColumn(f"up_col_{s}", F.shiftright(f"col_{s}", 2))
                over = over.join(inside, [group, f"up_row_{s}", f"up_col_{s}"])
            same = (F.col("up_row_a") == F.col("up_row_b")) & (F.col("up_col_a") == F.col("up_col_b"))
            pairs = over.where(~same | ordered)
        least, most = bounds()
        pairs = pairs.select(group, "row_a", "col_a", "row_b", "col_b", (F.col("n_a") * F.col("n_b")).alias("work"), F.greatest(least, "above").alias("least"), most.alias("most"), "above")
        pairs = cut_lineage(pairs.where(F.col("most") >= F.col("above") - ROUNDING).drop("above"))
        best = cut_lineage(pairs.groupBy(group).agg(F.max("least").alias("best")))
        kept = pairs.join(best, group).where(F.col("most") >= F.col("best") - ROUNDING).drop("least", "most")
        work = kept.agg(F.sum("work")).first()[0] or 0
        if work <= PAIRS_PER_POINT * total:
            break
    return kept.drop("best"), level


def farthest_km(points: DataFrame, group: str = "cluster_id") -> DataFrame:
    """(group, max_pairwise_km): the greatest great-circle distance between two positions of each group, exact.

    Equal positions count once; a group with one position has distance 0; null and NaN positions are left out. A group
    with two opposite positions is settled by them. Cells of another meet only where their bounds allow the farthest
    pair, so no group is gathered and a hot one spreads over its cells.
    """
    placed = cut_lineage(placed_points(points, group))
    opposite = cut_lineage(opposite_groups(placed, group))
    unsettled = placed.join(opposite, group, "left_anti").drop("lat", "lon")
    kept, level = candidates(unsettled, group)
    cells = at_level(unsettled, level).select(group, "row", "col", *AXES)
    met = kept.drop("work").join(side(cells, group, "a"), [group, "row_a", "col_a"]).join(side(cells, group, "b"), [group, "row_b", "col_b"])
    chord = sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in AXES), F.lit(0.0))
    far = met.groupBy(group).agg(F.max(chord).alias("_c"))
    chords = far.unionByName(opposite.select(group, F.lit(4.0).alias("_c")))
    return chords.select(group, (2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.col("_c") / 4)))).alias("max_pairwise_km"))
