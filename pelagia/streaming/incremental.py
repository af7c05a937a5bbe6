"""Hit batches folded into best-hit and assignment tables as they land.

A search runs in batches, and each finished batch lands as files.  The best hit per
target and the assignment upsert are folds that do not depend on how rows are cut into
batches, so a table brought up to date per micro-batch equals the one computed at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pelagia.operators.hits import HIT_VALUES


def merge_best_hits(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Least e-value, then greatest bits, then least query per target over old rows and a batch."""
    columns = ["target", "query", *HIT_VALUES]
    rows = batch.select(*columns)
    if current is not None:
        rows = current.select(*columns).unionByName(rows)
    order = F.struct("evalue", -F.col("bits"), "query", "pident", "qcov", "tcov")
    picked = rows.groupBy("target").agg(F.min_by(F.struct("query", *HIT_VALUES), order).alias("_b"))
    return picked.select("target", "_b.*")


def fold_batches(
    source: DataFrame,
    table_dir: str,
    checkpoint: str,
    merge: Callable[[DataFrame | None, DataFrame], DataFrame] = merge_best_hits,
) -> StreamingQuery:
    """Run ``merge`` for every micro-batch of ``source``.

    Each batch id writes its own version folder from the version before it, so a replayed
    batch overwrites its own version and counts once.
    """

    def version(batch_id: int) -> str:
        return f"{table_dir}/version={batch_id}"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = spark.read.parquet(version(batch_id - 1)) if batch_id else None
        merge(current, batch).write.mode("overwrite").parquet(version(batch_id))

    return (
        source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, table_dir: str) -> DataFrame:
    """The newest version of a folded table."""
    versions = spark.read.option("basePath", table_dir).parquet(table_dir)
    newest = versions.agg(F.max("version").alias("v"))
    return versions.where(F.col("version") == newest.scalar()).drop("version")
