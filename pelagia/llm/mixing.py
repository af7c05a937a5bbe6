"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.shared import let, materialize, running_total, word_count

LIMIT = 3  # a document is taken at most so many times


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = LIMIT) -> DataFrame:
    """Per source: place (by code point, null last), weight, source_size and target in words.

    The targets share the total by weight; one that would pass ``limit`` times its source's size stops there, and the
    excess is shared again among the rest. With the sources ordered by limit per weight, the stopped ones are a
    prefix, and the first place whose share fits sets the level for all after it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    listed = totals.withColumn("place", F.row_number().over(place) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    ).withColumn("most", F.col("source_size") * limit)
    ratio = Window.orderBy(F.col("most") / F.col("weight"), "place")
    whole = Window.partitionBy()
    levels = (
        listed.withColumn("before", F.coalesce(F.sum("most").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("share", (F.sum("source_size").over(whole) - F.col("before")) / F.col("open"))
        .withColumn("nth", F.row_number().over(ratio))
    )
    fits = F.when(F.col("share") <= F.col("most") / F.col("weight"), F.struct("nth", "share"))
    return levels.withColumn("level", F.min(fits).over(whole)["share"]).select(
        "source", "place", "weight", "source_size",
        F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Inverse-transform draw: how many of ``draws`` out of ``population`` are ``marked``, for a uniform ``u``.

    Probabilities follow their ratio recurrence over ten standard deviations around the mean.
    """
    def bounds(s):
        mean = F.when(s["n"] > 0, s["m"] * s["k"] / s["n"]).otherwise(F.lit(0.0))
        return let(F.struct(s["n"], s["k"], s["m"], mean.alias("mean")), lambda t: F.struct(
            t["mean"].alias("mean"),
            (F.sqrt(F.greatest(F.when(t["n"] > 1, t["mean"] * (1 - t["k"] / t["n"]) * (t["n"] - t["m"]) / (t["n"] - 1)), F.lit(0.0))) * 10 + 2).alias("reach"),
        ))

    def search(s, low, high):
        ratio = lambda x: (s["k"] - x) * (s["m"] - x) / ((x + 1) * (s["n"] - s["k"] - s["m"] + x + 1))
        steps = F.when(high > low, F.sequence(low.cast("long"), high.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
        return let(F.transform(steps, lambda x: ratio(x.cast("double"))), lambda ratios: walk(s, low, ratios))

    def walk(s, low, ratios):
        one = F.lit(1.0)
        total = F.aggregate(ratios, F.struct(one.alias("p"), one.alias("t")), lambda a, r: F.struct((a["p"] * r).alias("p"), (a["t"] + a["p"] * r).alias("t")))["t"]
        start = F.struct(one.alias("p"), one.alias("t"), low.alias("x"), (s["u"] * total).alias("stop"))
        return F.aggregate(ratios, start, lambda a, r: F.struct(
            (a["p"] * r).alias("p"), (a["t"] + a["p"] * r).alias("t"), F.when(a["t"] < a["stop"], a["x"] + 1).otherwise(a["x"]).alias("x"), a["stop"].alias("stop"),
        ))["x"]

    given = F.struct(population.cast("double").alias("n"), marked.cast("double").alias("k"), draws.cast("double").alias("m"), u.alias("u"))
    return let(given, lambda s: let(bounds(s), lambda b: let(
        F.struct(
            F.greatest(F.lit(0.0), s["m"] + s["k"] - s["n"], F.floor(b["mean"] - b["reach"]).cast("double")).alias("low"),
            F.least(s["m"], s["k"], F.ceil(b["mean"] + b["reach"]).cast("double")).alias("high"),
        ),
        lambda r: search(s, r["low"], r["high"]),
    ))).cast("long")


def split_quotas(root: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, quotas) of the 2^levels leaves below ``root`` (node, quotas array<long>, one entry a source).

    A node gives its left child half of its blocks, drawn without replacement: source by source, a hypergeometric
    draw from what is left of the node. The right child gets the rest, so quotas add up exactly at every level.
    """
    nodes = root
    for level in range(levels):
        size = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        empty = F.array().cast("array<long>")
        chance = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), i), F.lit(1 << 40)) + 0.5) / (1 << 40)
        start = F.struct(F.floor(size / 2).alias("draws"), size.alias("left"), empty.alias("out"))

        def draw(acc, entry):
            x = hypergeometric(acc["left"], entry["q"], acc["draws"], entry["u"])
            return F.struct((acc["draws"] - x).alias("draws"), (acc["left"] - entry["q"]).alias("left"), F.concat(acc["out"], F.array(x)).alias("out"))

        entries = F.transform("quotas", lambda q, i: F.struct(q.alias("q"), chance(i).alias("u")))
        nodes = nodes.withColumn("first", F.aggregate(entries, start, draw)["out"]).select(
            F.explode(F.array(
                F.struct((F.col("node") * 2).alias("node"), F.col("first").alias("quotas")),
                F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "first", lambda q, f: q - f).alias("quotas")),
            )).alias("n")
        ).select("n.*")
        if level == 9:
            nodes = nodes.repartition("node")
    return nodes.withColumnRenamed("node", "shard")


def first_fit(units: DataFrame, ends: DataFrame, seed: int) -> DataFrame:
    """One row per place of ``ends`` (place, need, next): place, what is ``left`` of its need, next, and the units ``out``.

    ``units`` (place, block, id, size, words) are tried in a seeded order of their own; each that fits is taken. They
    are those of a few blocks, so the list of a place is short.
    """
    order = F.struct(F.xxhash64(F.lit(seed + 1), F.col("id")).alias("h"), F.col("words").alias("w"), F.col("id").cast("long").alias("id"), "size", "block")
    listed = units.groupBy("place").agg(F.array_sort(F.collect_list(order)).alias("units"))
    start = F.struct(F.col("need").cast("double").alias("left"), F.expr("cast(array() as array<struct<id:bigint,size:bigint,block:bigint>>)").alias("out"))

    def fill(acc, unit):
        fits = unit["w"].cast("double") <= acc["left"]
        return F.struct(
            F.when(fits, acc["left"] - unit["w"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["out"], F.array(F.struct(unit["id"].alias("id"), unit["size"].alias("size"), unit["block"].alias("block"))))).otherwise(acc["out"]).alias("out"),
        )

    filled = F.coalesce(F.aggregate("units", start, fill), start).alias("f")
    return ends.join(listed, "place", "left").select("place", "next", filled).select("place", "next", "f.left", "f.out")


def fill_further(placed: DataFrame, first: DataFrame, last_blocks: int, seed: int) -> DataFrame:
    """(place, id, size, block) of the documents taken past the whole blocks; ``first`` is the fill at the edge.

    Until a source has no later document that fits: of those that fit, whole blocks as far as they go, then a first fit
    over the next ``last_blocks`` blocks. Documents longer than what is left drop out of all later rounds.
    """
    out = lambda part: part.select("place", F.explode("out").alias("u")).select("place", "u.id", "u.size", "u.block")
    taken = [out(first)]
    short = placed.join(first.drop("out"), "place").filter((F.col("size") > 0) & (F.col("size") <= F.col("left")) & (F.col("block") >= F.col("next")))
    rest = short.groupBy("place", "block", "left", "id", "size").agg((F.col("size") * F.count(F.lit(1))).alias("words"))
    while True:
        rest = materialize(rest.filter(F.col("words") <= F.col("left")), "rest")
        if rest.isEmpty():
            break
        sums = running_total(rest.groupBy("place", "block", "left").agg(F.sum("words").alias("words")), "place", "block", "words", "upto")
        edge = materialize(sums.filter("upto > left").groupBy("place").agg(
            F.min(F.struct("block", (F.col("left") - F.col("upto") + F.col("words")).alias("need"))).alias("edge")
        ).select("place", F.col("edge.need").alias("need"), F.col("edge.block").alias("edge"), (F.col("edge.block") + last_blocks).alias("next")), "edge")
        met = rest.drop("left").join(edge, "place", "left")
        taken.append(met.filter("edge is null or block < edge").select("place", "id", "size", "block"))
        units = met.filter("block >= edge and block < next").select("place", "block", "id", "size", "words")
        part = materialize(first_fit(units, edge.select("place", "need", "next"), seed), "filled")
        taken.append(out(part))
        rest = rest.drop("left").join(part.drop("out"), "place").filter("block >= next").drop("next")
    return reduce(DataFrame.unionByName, taken)


def mix_plan(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17, block_words: int = 16384, shard_blocks: int = 64, last_blocks: int = 4,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, shards (the output shard of each copy).

    Every source is cut into permuted blocks of about ``block_words`` words: the block of a document is a seeded hash
    of its id, so block numbers are a random order. A source's target takes whole passes over its blocks, then whole
    blocks in order, then every later document that still fits what is left, in order, over all blocks: whole blocks of
    those that fit, and ``last_blocks`` blocks at a time where they no longer do. A document is never taken more than
    three times. The block quotas are split over shards of about ``shard_blocks`` blocks by the tree, and the shards
    draw disjoint ranges of each source's blocks. Seeded hashes decide everything, so reruns agree.

    Null text has size 0 and null source is a source of its own; documents without words are never taken (no shards).
    Rows that repeat an id are taken alike. An empty table gives an empty plan; other columns are ignored.
    """
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    quota = source_targets(sizes, weights)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = materialize(
        quota.withColumn("passes", full.cast("long"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).cast("long")),
        "sources",
    )
    same_source = lambda a, b: a["source"].eqNullSafe(b["source"])
    placed = sizes.join(sources, same_source(sizes, sources)).drop(sources["source"])
    order = F.xxhash64(F.lit(seed), F.col("id"))
    placed = placed.withColumn("block", F.pmod(order, F.col("blocks")))

    filled = placed.groupBy("place", "block").agg(F.sum("size").alias("words"))
    every = sources.select("place", "rest", "passes", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    blocks = every.join(filled, ["place", "block"], "left").withColumn("words", F.coalesce("words", F.lit(0)))
    blocks = running_total(blocks, "place", "block", "words", "upto")
    edge = blocks.filter((F.col("upto") > F.col("rest")) & (F.col("rest") > 0)).groupBy("place").agg(
        F.min(F.struct("block", (F.col("rest") - F.col("upto") + F.col("words")).alias("need"))).alias("edge")
    )
    part = F.when(F.col("rest") <= 0, F.lit("none")).when(F.col("edge").isNull() | (F.col("block") < F.col("edge.block")), F.lit("whole")).when(
        F.col("block") < F.col("edge.block") + last_blocks, F.lit("cut")).otherwise(F.lit("none"))
    blocks = materialize(
        blocks.join(edge, "place", "left").select("place", "block", "passes", "blocks", "words", part.alias("part"), F.col("edge.need").alias("need")), "blocks"
    )

    cut = placed.join(blocks.filter("part = 'cut'").select("place", "block", "need"), ["place", "block"]).filter("size > 0")
    units = cut.groupBy("place", "block", "need", "id", "size").agg((F.col("size") * F.count(F.lit(1))).alias("words"))
    ends = edge.select("place", F.col("edge.need").alias("need"), (F.col("edge.block") + last_blocks).alias("next"))
    taken = fill_further(placed, materialize(first_fit(units, ends, seed), "filled"), last_blocks, seed)
    further = taken.select("place", "block", F.lit(True).alias("further")).distinct()
    blocks = materialize(
        blocks.join(further, ["place", "block"], "left").withColumn("part", F.when(F.col("further") & (F.col("part") == "none"), F.lit("cut")).otherwise(F.col("part"))).drop("further", "need"),
        "blocks",
    )
    chosen = taken.select(F.col("place").alias("place_"), F.col("id").alias("id_"), F.col("size").alias("size_"), F.lit(True).alias("chosen"))

    slots = blocks.withColumn("uses", F.col("passes") + (F.col("part") != "none").cast("long"))
    quotas = slots.groupBy("place").agg(F.sum("uses").alias("quota"))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    levels = max(0, (-(-total // shard_blocks) - 1).bit_length())
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "quota"))), lambda s: s["quota"])
    root = quotas.agg(listed.alias("quotas")).select(F.lit(0).cast("long").alias("node"), "quotas")
    leaves = split_quotas(root, levels, seed).select("shard", F.posexplode("quotas").alias("place", "drawn")).filter("drawn > 0")
    leaves = materialize(leaves, "leaves")
    leaves = running_total(leaves, "place", "shard", "drawn", "upto")
    ranges = leaves.select("place", "shard", F.explode(F.sequence(F.col("upto") - F.col("drawn"), F.col("upto") - 1)).alias("slot"))
    firsts = sources.select("place", "blocks")
    drawn = (
        ranges.join(firsts, "place")
        .select("place", F.pmod("slot", "blocks").alias("block"), F.floor(F.col("slot") / F.col("blocks")).alias("pass"), "shard")
        .groupBy("place", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda s: s["shard"]).alias("shards"))
    )
    marked = blocks.join(drawn, ["place", "block"]).select("place", "block", "passes", "part", "shards")

    rows = placed.join(marked.drop("passes"), ["place", "block"], "left")
    match = (rows["place"] == chosen["place_"]) & rows["id"].eqNullSafe(chosen["id_"]) & (rows["size"] == chosen["size_"])
    copies = F.when(F.col("size") == 0, 0).when(F.col("part") == "whole", F.col("passes") + 1).when(
        (F.col("part") == "cut") & F.col("chosen"), F.col("passes") + 1).otherwise(F.col("passes"))
    return rows.join(chosen, match, "left").select(
        "id", "source", "size", "source_size", "target", F.coalesce(F.slice("shards", F.lit(1), copies.cast("int")), F.array().cast("array<long>")).alias("shards")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: every taken copy as a row of ``docs``' columns plus ``shard``, shuffled within its shard.

    Rows are dealt to tasks by shard and ordered in it by a seeded hash of id and copy. Ids may be null or repeat: the
    plan takes rows of equal id, source and size alike, and each row of ``docs`` comes as often as the plan says for
    these three. Null and empty texts have no words and are never taken. A column of ``docs`` named ``shard`` comes
    back as it is, next to the new one; other names of any kind pass through. An empty table gives no rows.
    """
    plan = mix_plan(docs, weights, seed, id_col=id_col, text_col=text_col, source_col=source_col, **options).filter(F.size("shards") > 0)
    plan = plan.select(F.col("id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"), F.col("shards").alias("mix_shards"))
    plan = plan.dropDuplicates(["mix_id", "mix_source", "mix_size"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    same = rows["id"].eqNullSafe(plan["mix_id"]) & rows["source"].eqNullSafe(plan["mix_source"]) & (rows["size"] == plan["mix_size"])
    taken = rows.join(plan, same).select("row", "id", F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
    ordered = taken.withColumn("mix_order", F.xxhash64(F.lit(seed + 2), F.col("id"), F.col("mix_copy"))).repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order", "id")
    return ordered.select("row.*", F.col("mix_shard").alias("shard"))
