"""Splits one large JSON object into the records of one of its members, over byte ranges and without reading it whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# An escaped character, and a string once those are gone (the last one may be cut off).
ESCAPED = r"\\."
STRING = r'"[^"]*("|$)'
RANGE_BITS = 13  # a byte range is scanned in parts of so many pieces, as a power of two
RANGE = ["file", "block", "part"]


def opened_braces(text: Column, inside: bool) -> Column:
    """Braces that open outside of strings in a piece whose escapes are gone; ``inside``: the piece begins in a string."""
    bare = F.regexp_replace(F.concat(F.lit('"'), text) if inside else text, STRING, "")
    return F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))


def json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(RANGE, at, nth, value, in_string, depth, closes): the file cut behind every closing brace, with the state at each cut.

    Byte ranges of the file are read apart, in parts of a few thousand pieces. A part only knows its own quotes and
    braces, so it states them for both cases, that it begins in a string or not; the parts are then scanned in order, a
    row each, and hand every part its place ``at`` and first state. ``depth`` is that in front of the piece; ``closes``
    says whether the brace behind it is one. The object may lie in several files, in order of their paths, each of
    which but the last ends with a closing brace.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), "value"
    )
    raw = raw.withColumn("file", F.xxhash64("path")).withColumn("part", F.shiftright("nth", RANGE_BITS))
    named = raw.groupBy(*RANGE).agg(F.min("path").alias("path"))
    plain = raw.withColumn("plain", F.regexp_replace("value", ESCAPED, ""))
    quotes = F.length("plain") - F.length(F.replace("plain", F.lit('"'), F.lit("")))
    pieces = plain.select(
        *RANGE, "nth", "value", (quotes % 2).alias("odd"), opened_braces(F.col("plain"), False).alias("out_opens"), opened_braces(F.col("plain"), True).alias("in_opens")
    )
    in_range = Window.partitionBy(*RANGE).orderBy("nth")
    earlier = in_range.rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    pieces = pieces.withColumn("odd_before", none(F.sum("odd").over(earlier)) % 2)

    def moved(first: int) -> tuple[Column, Column]:
        """State and change of depth of a piece if its range begins outside (0) or inside (1) a string."""
        state = (F.col("odd_before") + first) % 2
        opens = F.when(state == 0, F.col("out_opens")).otherwise(F.col("in_opens"))
        return state, opens - ((state + F.col("odd")) % 2 == 0).cast("int")

    (_, out_step), (_, in_step) = moved(0), moved(1)
    stated = pieces.withColumn("out_step", out_step).withColumn("in_step", in_step)
    ranges = stated.groupBy(*RANGE).agg((F.sum("odd") % 2).alias("odd"), F.sum("out_step").alias("out_sum"), F.sum("in_step").alias("in_sum"))
    in_order = Window.orderBy("path", "block", "part")  # a row a part
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.join(named, RANGE).withColumn("at", F.row_number().over(in_order))
    ranges = ranges.withColumn("first", none(F.sum("odd").over(before)) % 2)
    ranges = ranges.withColumn("change", F.when(F.col("first") == 0, F.col("out_sum")).otherwise(F.col("in_sum")))
    ranges = ranges.select(*RANGE, "at", "first", none(F.sum("change").over(before)).alias("base"))
    known = stated.join(ranges, RANGE).withColumn("in_string", (F.col("odd_before") + F.col("first")) % 2)
    known = known.withColumn("step", F.when(F.col("first") == 0, F.col("out_step")).otherwise(F.col("in_step")))
    known = known.withColumn("closes", (F.col("in_string") + F.col("odd")) % 2 == 0)
    return known.select(*RANGE, "at", "nth", "value", "in_string", (F.col("base") + none(F.sum("step").over(earlier))).alias("depth"), "step", "closes")


def json_records(spark: SparkSession, path: str, member: str) -> tuple[DataFrame, DataFrame]:
    """(record) of the object ``member`` of the one object in a file, each as ``{"key":{...}}``, and (text) of what is around.

    ``member`` is an object of objects, named for the first time where it stands. A record ends with the brace that leads back to depth 2; pieces are numbered by
    the records closed before them and put together per record, so no task holds more than one record's text.
    """
    pieces = json_pieces(spark, path)
    after = F.col("depth") + F.col("step")
    pieces = pieces.withColumn("ends", (F.col("closes") & (after == 2)).cast("int")).withColumn("leaves", (F.col("closes") & (after == 1)).cast("int"))
    per_range = pieces.groupBy(*RANGE, "at").agg(F.sum("ends").alias("n"), F.sum("leaves").alias("m"))
    blocks = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(*RANGE, *[F.coalesce(F.sum(c).over(blocks), F.lit(0)).alias(f"{c}_base") for c in ("n", "m")])
    along = Window.partitionBy(*RANGE).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.join(offsets, RANGE).select(
        "at", "nth", "value", (F.col("n_base") + F.coalesce(F.sum("ends").over(along), F.lit(0))).alias("record"),
        (F.col("m_base") + F.coalesce(F.sum("leaves").over(along), F.lit(0))).alias("place"),
    )
    texts = numbered.groupBy("place", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "nth", "value"))), lambda p: p["value"]), "}").alias("text"))
    opening = rf'^[\s\S]*?"{member}"\s*:\s*\{{'
    # The first record of the member stands behind the member's name, the others behind a comma.
    head = texts.where(F.col("text").rlike(opening)).agg(F.min(F.struct("place", "record")).alias("h"))
    placed = texts.withColumn("h", head.scalar())
    is_head = (F.col("place") == F.col("h.place")) & (F.col("record") == F.col("h.record"))
    body = F.when(is_head, F.regexp_replace("text", opening, "")).otherwise(F.regexp_replace("text", r"^\s*,", ""))
    inside = placed.where((F.col("place") == F.col("h.place")) & (F.col("record") >= F.col("h.record")))
    # A record's text lacks the brace behind it; what follows the last record is blank.
    records = inside.select(F.concat(F.lit("{"), body, F.lit("}}")).alias("record")).where(F.col("record").rlike(r'^\{\s*"'))
    around = placed.where(is_head | F.col("h").isNull() | (F.col("place") != F.col("h.place")) | (F.col("record") < F.col("h.record")))
    return records, around.select(F.regexp_replace("text", rf'("{member}"\s*:\s*\{{)[\s\S]*$', "$1").alias("text"))
