"""Pieces the operators of this subpackage share: columns, written stages, tables."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.session import ensure_checkpoint_dir

# The six separators [\x20\x09-\x0D].
SEPARATORS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
BATCH_BYTES = 4 << 20  # of an Arrow batch, after small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts lineage for good: a lost executor re-reads the files, and later plans know their size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold at most ``BATCH_BYTES``, unless it has a lower limit already.

    An executor holds a batch outside its heap, twice while its buffers grow, and the worker holds it again; by rows
    alone, long texts make batches of tens of megabytes. No row is lost: a batch takes one row at least.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", (spark.conf.get(key, None) or "-1").strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Hand memory that a finished task no longer uses to the system; workers live on for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def giving_back(each: Callable, done: Callable = lambda: None) -> Callable:
    """``each`` for ``mapInArrow``, followed by ``done`` and :func:`give_back` once its own batches and arrays are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        done()
        give_back()

    return run


def without_separators(text: Column) -> Column:
    """The text with every separator deleted; null reads as empty."""
    out = F.coalesce(text, F.lit(""))
    for separator in SEPARATORS:
        out = F.replace(out, F.lit(separator), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    """How many maximal runs of non-separators a text holds; null reads as empty.

    Separators become spaces, each space becomes the pair ``\\n\\t``, and deleting the inner ``\\t\\n``
    leaves one ``\\n`` per run of separators, so the count needs no regular expression.
    """
    spaced = F.coalesce(text, F.lit(""))
    for separator in SEPARATORS[1:]:
        spaced = F.replace(spaced, F.lit(separator), F.lit(" "))
    runs = F.replace(F.replace(spaced, F.lit(" "), F.lit("\n\t")), F.lit("\t\n"), F.lit(""))
    gaps = F.octet_length(runs) - F.octet_length(F.replace(runs, F.lit("\n"), F.lit("")))
    first, last = runs.startswith(F.lit("\n")).cast("int"), runs.endswith(F.lit("\t")).cast("int")
    return F.when(F.octet_length(runs) == 0, F.lit(0)).otherwise(
        F.greatest(gaps + 1 - first - last, F.lit(0))
    ).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_total(df: DataFrame, key: str, position: str, amount: str, out: str, width: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over smaller or equal ``position`` (a long) within ``key``.

    Two levels: sums of runs of ``width`` positions, then rows within a run, so that a hot key is split.
    """
    run = F.floor(F.col(position) / width)
    within = Window.partitionBy(key, "run_").orderBy(position)
    rows = df.withColumn("run_", run)
    before = (
        rows.groupBy(key, "run_").agg(F.sum(amount).alias("sum_"))
        .withColumn("before_", F.coalesce(
            F.sum("sum_").over(Window.partitionBy(key).orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(key, "run_", "before_")
    )
    return (
        rows.join(before, [key, "run_"])
        .withColumn(out, F.col("before_") + F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("run_", "before_")
    )
