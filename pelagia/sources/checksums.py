"""MD5 and SHA-256 of large files: blocks are read apart and hashed in rounds, which hand on the state of each digest."""

from __future__ import annotations

import _hashlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.session import cut_lineage, ensure_checkpoint_dir

BLOCK = 64 << 20  # bytes of a file that are hashed in one round; smaller files are hashed whole

# Endings at which Spark's readers of lines decompress, what they drop at the start of a file, sizes of digests.
COMPRESSED = r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd|lzo|lzo_deflate|xz)$"
MARK = b"\xef\xbb\xbf"
SIZES = {"MD5": 16, "SHA256": 32}
CONTEXT = 256  # at least the size of either state in OpenSSL

STATE = "file long, total long, size long, seen long, md5 binary, sha256 binary"


class Digest:
    """A digest whose state can be stored, which hashlib does not allow; by the OpenSSL that hashlib is linked with."""

    def __init__(self, name: str, state: bytes | None):
        library = ctypes.CDLL(_hashlib.__file__)
        self.name, self.state = name, ctypes.create_string_buffer(state or b"", CONTEXT)
        self.start, self.add, self.end = (getattr(library, f"{name}_{step}") for step in ("Init", "Update", "Final"))
        self.add.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t]
        if state is None:
            self.start(self.state)

    def update(self, data: pa.Buffer) -> None:
        self.add(self.state, data.address, data.size)

    def digest(self) -> bytes:
        out = ctypes.create_string_buffer(SIZES[self.name])
        self.end(out, self.state)
        return out.raw


def hashed_apart() -> Column:
    """Is a row's file hashed block by block? Only of facts that Spark has from listing it, so that it opens no other file."""
    return (F.col("_metadata.file_size") > BLOCK) & ~F.col("_metadata.file_path").rlike(COMPRESSED)


def file_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, n, piece, round) of the large files: the bytes of lines, each with a line feed, in order of block and nth.

    Byte ranges are read as lines, whose bytes Spark keeps as they are. A mark at the start of the file is lost, and a
    line feed is added to a last line without one; the sum of ``n`` shows both.
    """
    lines = spark.read.option("lineSep", "\n").text(path).where(hashed_apart())
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            file, block = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (block[1:] != block[:-1])][: len(file)]).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(file)]):
                piece = b"\n".join([*batch.column(2).slice(i, j - i).to_pylist(), b""])
                row = {"file": int(file[i]), "block": int(block[i]), "nth": nth, "n": len(piece), "piece": piece}
                yield pa.RecordBatch.from_pylist([row], pa.schema([(k, pa.binary() if k == "piece" else pa.int64()) for k in row]))
                nth += 1

    pieces = lines.mapInArrow(each, "file long, block long, nth long, n long, piece binary")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    pieces.withColumn("round", F.floor(F.col("block") / BLOCK)).write.partitionBy("round").parquet(folder)
    return spark.read.schema("file long, block long, nth long, n long, piece binary, round long").parquet(folder)


def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of files after their next pieces; before the pieces of a file comes the row with its state."""
    names = [field.split()[0] for field in STATE.split(", ")]
    state: dict = {}
    digests: list[Digest] = []

    def row() -> pa.RecordBatch:
        if digests:
            ended = state["seen"] == state["total"]
            state["md5"], state["sha256"] = (d.digest() if ended else d.state.raw for d in digests)
        return pa.RecordBatch.from_pylist([state], pa.schema([(k, pa.binary() if k in ("md5", "sha256") else pa.int64()) for k in names]))

    for batch in batches:
        for i, fields in enumerate(batch.drop_columns(["piece"]).to_pylist()):
            if fields["block"] < 0:
                if state:
                    yield row()
                state, digests = {k: fields[k] for k in names}, []
                continue
            extra = state["total"] - state["size"]
            data = batch.column("piece")[i].as_buffer()
            if not digests:
                digests = [Digest("MD5", state["md5"]), Digest("SHA256", state["sha256"])]
            if state["seen"] == 0 and extra < -1:
                for d in digests:
                    d.update(pa.py_buffer(MARK))
            state["seen"] += fields["n"]
            if state["seen"] == state["total"] and extra in (1, 1 - len(MARK)):
                data = data.slice(0, data.size - 1)
            for d in digests:
                d.update(data)
    if state:
        yield row()


def chained_digests(spark: SparkSession, path: str, large: DataFrame) -> DataFrame:
    """(file, md5, sha256) of the ``large`` files (file, size) under ``path``, whose blocks are hashed in rounds.

    A task of a round reads one block of each of its files and the states that the round before has left, so what it
    reads does not grow with a file.
    """
    pieces = file_pieces(spark, path)
    totals = pieces.groupBy("file").agg(F.sum("n").alias("total"))
    empty = [F.lit(None).cast("binary").alias(name) for name in ("md5", "sha256")]
    known = (F.col("total") - F.col("size")).isin(0, 1, -len(MARK), 1 - len(MARK))
    checked = F.when(known, F.col("total")).otherwise(F.raise_error(F.lit("a file changed while it was read")))
    states = cut_lineage(large.join(totals, "file").select("file", checked.cast("long").alias("total"), "size", F.lit(0).cast("long").alias("seen"), *empty))
    files, longest = states.agg(F.count(F.lit(1)), F.max("size")).first()
    for nth_round in range((longest or 0) // BLOCK + 1):
        rows = pieces.where(F.col("round") == nth_round).drop("round").unionByName(
            states.withColumn("block", F.lit(-1).cast("long")).withColumn("nth", F.lit(-1).cast("long")), allowMissingColumns=True
        )
        dealt = rows.repartition(max(1, files), "file").sortWithinPartitions("file", "block", "nth")
        states = cut_lineage(dealt.mapInArrow(advance, STATE))
    return states.select("file", *[F.lower(F.hex(c)).alias(c) for c in ("md5", "sha256")])
