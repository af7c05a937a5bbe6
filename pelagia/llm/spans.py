"""Byte spans to remove from texts: first occurrences among rows with equal hashes, and the cut itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.byte_kernels import LAST_ID, flat


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with null ids as the greatest long and null texts as empty; other columns are left behind."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def later_ones(keys: tuple[np.ndarray, ...], ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (keys, id, place), and which of its rows stand after the first (id, place) of their keys."""
    order = np.lexsort((places, ids, *reversed(keys)))
    fresh = np.ones(len(order), dtype=bool)
    if len(order):
        fresh[1:] = False
        for k in keys:
            fresh[1:] |= k[order[1:]] != k[order[:-1]]
    head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    return order, (ids[order] != ids[head]) | (places[order] != places[head])


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): the bytes of each text that no span covers.

    ``docs`` is (id, text) and ``spans`` (id, start, end), overlapping or not; a document's own list of spans is at
    most as long as its text. ``spans`` of the result are the maximal removed runs.
    """
    listed = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    joined = docs.join(listed, "id", "left").select("id", "text", F.col("cuts.start").alias("starts"), F.col("cuts.end").alias("ends"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            starts, ends = batch.column(2), batch.column(3)
            removed, runs, kept = [], [], []
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]]
                if not starts[i].is_valid:
                    removed.append(0)
                    runs.append([])
                    kept.append(text.tobytes())
                    continue
                a, b = merged(np.asarray(starts[i].values), np.asarray(ends[i].values))
                cover = np.zeros(len(text) + 1, dtype=np.int8)
                cover[a] += 1
                cover[b] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b)])
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return joined.mapInArrow(each, "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, not touching spans with the same union."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    head = np.ones(len(starts), dtype=bool)
    head[1:] = starts[1:] > ends[:-1]
    last = np.r_[np.flatnonzero(head)[1:] - 1, len(starts) - 1]
    return starts[head], ends[last]


def digest_columns(cut: DataFrame) -> DataFrame:
    """The counts of a cut, and the digest of what it keeps."""
    return cut.select(
        F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed",
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
