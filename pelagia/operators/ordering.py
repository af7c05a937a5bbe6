"""Skew-safe ordering building blocks: positions, quantiles, ranks and top-n lists.

A plain ``row_number() over (partition by g order by x)`` sorts each group in one
task.  When one group can hold a third of all rows that task never ends, so every
ordered operator here works on (group, bucket) pieces.  The bucket is any
expression that never decreases along the order; bucket sizes are summed per group
and added to the position inside the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` that matches NULL to NULL and keeps one copy of the keys."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def ordered_index(
    df: DataFrame,
    group_cols: Sequence[str],
    bucket: Column,
    order_cols: Sequence[Column | str],
    name: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """Zero-based position of each row inside its group, without sorting a group in one task.

    ``bucket`` must not decrease along ``order_cols``; rows of one (group, bucket)
    piece are sorted together, so pick it fine enough that a piece fits in a task.
    ``total`` optionally names a column for the group size.
    """
    groups = list(group_cols)
    keys = [*groups, "_bucket"]
    staged = df.withColumn("_bucket", bucket)
    pieces = staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    columns = [*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")]
    if total:
        columns.append(F.sum("_size").over(Window.partitionBy(*groups)).alias(total))
    offsets = pieces.select(*columns)
    inside = Window.partitionBy(*keys).orderBy(*order_cols)
    local = staged.withColumn("_local", F.row_number().over(inside) - 1)
    joined = null_safe_join(local, offsets, keys)
    return joined.withColumn(name, F.col("_local") + F.col("_offset")).drop("_bucket", "_local", "_offset")


def block_pairs(rows: DataFrame, key: str, member: str, block: int = 2048) -> DataFrame:
    """Pairs of rows that share ``key``, once per two members: columns with ``_a`` and ``_b``, the lesser member in a.

    A key with more than ``block`` rows is dealt to g blocks by a hash of the member and joined as g(g+1)/2 pairs of
    blocks, so that no task reads more than two blocks of it. Each row is copied g + 1 times, others twice.
    ``member`` is unique within a key; rows with a null key meet nobody.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    hot = hot.select(key, F.ceil(F.col("_n") / block).cast("int").alias("_g"))
    dealt = rows.join(hot, key, "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_g")).cast("int"))
    others = [c for c in rows.columns if c != key]
    left = dealt.select(key, F.col("_own").alias("_first"), F.explode(F.sequence("_own", F.col("_g") - 1)).alias("_second"), *[F.col(c).alias(f"_{c}_x") for c in others])
    right = dealt.select(key, F.explode(F.sequence(F.lit(0), "_own")).alias("_first"), F.col("_own").alias("_second"), *[F.col(c).alias(f"_{c}_y") for c in others])
    x, y = F.col(f"_{member}_x"), F.col(f"_{member}_y")
    met = left.join(right, [key, "_first", "_second"]).where((x < y) | ((F.col("_first") < F.col("_second")) & (x > y)))
    pick = lambda c, this, that: F.when(x < y, F.col(f"_{c}_{this}")).otherwise(F.col(f"_{c}_{that}"))
    return met.select(key, *[pick(c, "x", "y").alias(f"{c}_a") for c in others], *[pick(c, "y", "x").alias(f"{c}_b") for c in others])


def coarse_key(value: Column) -> Column:
    """An integer that never decreases with ``value`` and keeps three significant digits."""
    size = F.abs(value)
    exponent = F.floor(F.log10(size))
    digits = F.floor(size / F.pow(F.lit(10.0), exponent - 2))
    key = (exponent + 400) * 1000 + digits
    return F.when(size == 0, F.lit(0)).when(value < 0, -key).otherwise(key).cast("long")


def _counts_by_value(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", coarse_key(F.col(value)))
    )


def _histogram(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per (group, bucket) counts with the count before the bucket and the group total."""
    by_bucket = counts.groupBy(*groups, "_bucket").agg(F.sum("_n").alias("_bn"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return by_bucket.select(
        *groups,
        "_bucket",
        "_bn",
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_before"),
        F.sum("_bn").over(Window.partitionBy(*groups)).alias("_total"),
    )


def cumulative_counts(df: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    """One row per (group, distinct value): ``n``, ``n_before`` (strictly smaller) and ``n_total``."""
    groups = list(group_cols)
    counts = _counts_by_value(df, groups, value)
    joined = null_safe_join(counts, _histogram(counts, groups), [*groups, "_bucket"])
    running = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *groups,
        value,
        F.col("_n").alias("n"),
        (F.col("_before") + F.coalesce(F.sum("_n").over(running), F.lit(0))).alias("n_before"),
        F.col("_total").alias("n_total"),
    )


def _target_ranks(total: Column, p: float, method: str) -> tuple[Column, Column]:
    """Zero-based lower rank and interpolation weight for a quantile of ``total`` sorted values."""
    if method == "inclusive":
        h = (total - 1) * F.lit(float(p))
        low = F.floor(h)
        return low, h - low
    if method == "exclusive":
        h = (total + 1) * F.lit(float(p))
        low = F.least(F.greatest(F.floor(h), F.lit(1)), F.greatest(total - 1, F.lit(1)))
        weight = F.when(total == 1, F.lit(0.0)).otherwise(h - low)
        return low - 1, weight
    if method == "upper":
        return F.floor(total * F.lit(float(p))), F.lit(0.0)
    raise ValueError(f"unknown quantile method {method!r}")


def exact_quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    metrics: dict[str, Column],
    probs: dict[str, float],
    method: str = "inclusive",
    counts: bool = False,
) -> DataFrame:
    """Exact interpolated quantiles of several metrics per group, in one pass over a histogram.

    Rows are first collapsed to (group, value) counts with map-side combine.  A coarse
    histogram finds the buckets that hold the wanted ranks and only those buckets are
    sorted, so a group of any size never meets in one task.  Columns are named
    ``{metric}_{prob}`` (just ``{metric}`` for an empty prob name) and ``n_{metric}``.
    """
    groups = list(group_cols)
    pairs = [F.struct(F.lit(m).alias("_metric"), c.cast("double").alias("_value")) for m, c in metrics.items()]
    long = df.select(*groups, F.inline(F.array(*pairs)))
    keys = [*groups, "_metric"]
    by_value = _counts_by_value(long, keys, "_value")
    hist = _histogram(by_value, keys)
    wanted = [_target_ranks(F.col("_total"), p, method) for p in probs.values()]
    ranks = [r for low, _ in wanted for r in (low, F.least(low + 1, F.col("_total") - 1))]
    holds = [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_bn")) for r in ranks]
    hist = hist.where(reduce(lambda a, b: a | b, holds))
    picked = null_safe_join(by_value, hist, [*keys, "_bucket"])
    running = Window.partitionBy(*keys, "_bucket").orderBy("_value")
    picked = picked.withColumn("_upto", F.col("_before") + F.sum("_n").over(running))

    def value_at(rank: Column) -> Column:
        here = (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
        return F.max(F.when(here, F.col("_value")))

    aggs = [F.max("_total").alias("_total")]
    for i, (low, _) in enumerate(wanted):
        aggs.append(value_at(low).alias(f"_lo{i}"))
        aggs.append(value_at(F.least(low + 1, F.col("_total") - 1)).alias(f"_hi{i}"))
    found = picked.groupBy(*keys).agg(*aggs)
    for i, (_, weight) in enumerate(wanted):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        found = found.withColumn(f"_q{i}", F.when(weight == 0, lo).otherwise(lo + (hi - lo) * weight))
    out = []
    for m in metrics:
        mine = F.col("_metric") == m
        for i, label in enumerate(probs):
            out.append(F.max(F.when(mine, F.col(f"_q{i}"))).alias(f"{m}_{label}" if label else m))
        if counts:
            out.append(F.coalesce(F.max(F.when(mine, F.col("_total"))), F.lit(0)).alias(f"n_{m}"))
    return found.groupBy(*groups).agg(*out)


def exact_medians(df: DataFrame, group_cols: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    """True medians per group, one column per metric."""
    return exact_quantiles(df, group_cols, metrics, {"": 0.5})


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the first row per key; a map-side combined ``min_by``, not a window."""
    row = F.struct(*values)
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def category_counts(df: DataFrame, group_cols: Sequence[str], category: str, label: str = "n") -> DataFrame:
    """Rows per (group, category), blank and NULL categories not counted."""
    return (
        df.where(F.col(category).isNotNull() & (F.col(category) != ""))
        .groupBy(*group_cols, category)
        .agg(F.count(F.lit(1)).alias(label))
    )


def top_categories(df: DataFrame, group_cols: Sequence[str], category: str, n: int) -> DataFrame:
    """The ``n`` most frequent categories per group (ties by label) as rows with a 1-based ``rank``."""
    counted = category_counts(df, group_cols, category)
    order = Window.partitionBy(*group_cols).orderBy(F.desc("n"), F.asc(category))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_categories_text(df: DataFrame, group_cols: Sequence[str], category: str, n: int, name: str) -> DataFrame:
    """``label (count); …`` text of the ``n`` most frequent categories per group."""
    ranked = top_categories(df, group_cols, category, n)
    entry = F.struct("rank", F.concat(F.col(category), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "; ")
    return ranked.groupBy(*group_cols).agg(text.alias(name))


def _long_category_counts(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows per (group, column, value) for several category columns in one pass; blanks not counted."""
    pairs = [F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v")) for c in columns]
    long = df.select(*groups, F.inline(F.array(*pairs))).where("_v IS NOT NULL AND _v <> ''")
    return long.groupBy(*groups, "_c", "_v").agg(F.count(F.lit(1)).alias("n"))


def top_categories_texts(df: DataFrame, group_cols: Sequence[str], names: dict[str, str], n: int) -> DataFrame:
    """:func:`top_categories_text` of several columns (column → output name) from one scan."""
    groups = list(group_cols)
    order = Window.partitionBy(*groups, "_c").orderBy(F.desc("n"), F.asc("_v"))
    counted = _long_category_counts(df, groups, list(names))
    ranked = counted.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    entry = F.struct("_r", F.concat(F.col("_v"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))
    out = []
    for column, name in names.items():
        mine = F.array_sort(F.collect_list(F.when(F.col("_c") == column, entry)))
        out.append(F.when(F.size(mine) > 0, F.array_join(F.transform(mine, lambda e: e["t"]), "; ")).alias(name))
    return ranked.groupBy(*groups).agg(*out)


def modal_values(df: DataFrame, group_cols: Sequence[str], names: dict[str, str]) -> DataFrame:
    """:func:`modal_value` of several columns (column → output name) from one scan."""
    counted = _long_category_counts(df, group_cols, list(names))
    order = F.struct(-F.col("n"), F.col("_v"))
    out = [F.min_by("_v", F.when(F.col("_c") == c, order)).alias(name) for c, name in names.items()]
    return counted.groupBy(*group_cols).agg(*out)


def modal_value(df: DataFrame, group_cols: Sequence[str], column: str, name: str | None = None) -> DataFrame:
    """The most frequent non-blank value per group, least label on ties."""
    counted = category_counts(df, group_cols, column)
    best = F.min_by(F.col(column), F.struct(-F.col("n"), F.col(column)))
    return counted.groupBy(*group_cols).agg(best.alias(name or column))
