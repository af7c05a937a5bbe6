"""Greedy clusters of similar sequences: every member is within the cut of its own representative."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.functions.text import kmers
from pelagia.operators.ordering import ordered_index
from pelagia.session import cut_lineage


def ranked_sets(sequences: DataFrame, k: int, min_shared: float) -> DataFrame:
    """(r, id, n, length, kmers, prefix) of sequences (id, sequence) that have a k-mer.

    ``r`` counts sequences by falling number of k-mers, ties in digest order of the id. ``prefix`` holds a sequence's
    n - ceil(min_shared * n) + 1 rarest k-mers: who shares the wanted part of them all shares one of these. K-mers of
    one sequence alone, which nobody shares, count in ``n`` but are left out of ``kmers`` and ``prefix``.
    """
    sequences = cut_lineage(sequences.select("id", "sequence"))
    hashed = F.array_distinct(F.transform(kmers(F.col("sequence"), k), lambda m: F.xxhash64(m)))
    sets = sequences.select("id", F.length("sequence").alias("length"), hashed.alias("kmers")).withColumn("n", F.size("kmers")).where("n > 0")
    opened = sets.select("id", F.explode("kmers").alias("k"))
    frequency = opened.groupBy("k").agg(F.count(F.lit(1)).alias("df"))
    rare = opened.join(frequency, "k").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("e"))
    wanted = F.size("e") - F.ceil(F.round(F.size("e") * F.lit(min_shared), 9)).cast("int") + 1
    met = lambda e: F.transform(F.filter(e, lambda x: x["df"] > 1), lambda x: x["k"])
    held = rare.select("id", met(F.col("e")).alias("kmers"), met(F.slice("e", F.lit(1), wanted)).alias("prefix"))
    sets = cut_lineage(sets.select("id", "length", "n"))
    digest = F.md5(F.col("id").cast("string"))
    numbered = ordered_index(
        sets.select("id", "n").withColumn("d", digest), [], F.struct(-F.col("n"), F.substring("d", 1, 2)), [-F.col("n"), "d", "id"], "r"
    )
    return cut_lineage(sets.join(numbered.select("id", "r"), "id").join(held, "id"))


CHUNK = 2048  # rows of a length class that meet those of another chunk in one task
CHUNK_BYTES = 8 << 20  # of their bitmaps
PAIRS_PER_ROW = 4  # few enough pairs of open sequences to verify them all
BATCH_BYTES = 8 << 20  # of texts handed to a Python worker at once


def hashed_kmers(sequence: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the substrings of length ``k``."""
    letters = np.frombuffer(sequence.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(letters) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(letters) - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + letters[j : j + len(h)] + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def class_width(min_length_ratio: float) -> float:
    """Width of a length class on the scale of logarithms: lengths within the ratio are at most one class apart."""
    return max(-math.log(min_length_ratio), 1e-7) * (1 + 1e-9) if min_length_ratio > 0 else math.inf


def class_bits(number: int, width: float) -> int:
    """Bits of a class: a power of two, at least twice its greatest length."""
    longest = math.exp((number + 1) * width) if width < math.inf else 1 << 16
    return 1 << max(6, math.ceil(math.log2(2 * longest)))


def marked_sets(texts: DataFrame, k: int, width: float) -> DataFrame:
    """(id, length, n, class, bits) of texts that have a k-mer: their number of k-mers, a class of lengths, and a bitmap.

    The k-mers stay in the task; a bit of the bitmap is set if one of them hashes to it.
    """

    def mark(batches):
        for batch in batches:
            rows = []
            for key, sequence in zip(batch["id"], batch["sequence"]):
                h = hashed_kmers(sequence, k)
                if len(h):
                    number = int(math.log(len(sequence)) / width)
                    bits = np.zeros(class_bits(number + 1, width), np.uint8)
                    bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
                    rows.append((key, len(sequence), len(h), number, np.packbits(bits, bitorder="little").tobytes()))
            yield pd.DataFrame(rows, columns=["id", "length", "n", "class", "bits"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInPandas(mark, f"id {kind}, length int, n int, class int, bits binary")


def candidates(rows: DataFrame, min_length_ratio: float, pairs: bool) -> DataFrame:
    """(r, m) of the rows marked ``later`` that may resemble m earlier ones marked ``earlier``, or all such (r, rep).

    What a sequence lacks of another is at least what its bitmap lacks of the other's; so no pair is missed. Rows meet in
    the class of the longer one. A class is dealt to chunks, and each pair of chunks is one group.
    """
    width = class_width(min_length_ratio)
    at = F.inline(F.array(*[F.struct((F.col("class") + i).alias("key"), F.lit(i == 0).alias("own")) for i in (0, 1)]))
    placed = rows.select("r", "n", "need", "length", "bits", "later", "earlier", at)
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.length("bits")).alias("b"))
    chunk = F.least(F.lit(CHUNK), F.greatest(F.lit(1), F.floor(F.lit(CHUNK_BYTES) / F.col("b"))))
    dealt = placed.join(sizes.select("key", F.ceil(F.col("m") / chunk).cast("int").alias("g")), "key")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("r"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("g", "other")

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("r").combine_chunks()
        r, n, need, length, own, later, earlier, chunk = (
            table[c].to_numpy(zero_copy_only=False) for c in ("r", "n", "need", "length", "own", "later", "earlier", "chunk")
        )
        size = class_bits(int(table["key"][0].as_py()), width) // 8
        bits = np.empty((len(r), size // 8), np.uint64)
        for x, value in enumerate(table["bits"]):
            words = np.frombuffer(value.as_buffer(), np.uint64)
            while len(words) > size // 8:
                words = words[: len(words) // 2] | words[len(words) // 2 :]
            bits[x] = words
        cross = table["i"][0].as_py() != table["j"][0].as_py()
        u = np.flatnonzero(earlier)
        r_u, length_u, own_u, chunk_u, without = r[u], length[u], own[u], chunk[u], ~bits[u]
        out = ([], [])
        for x in np.flatnonzero(later):
            p = int(np.searchsorted(r_u, r[x]))
            fits = np.minimum(length[x], length_u[:p]) / np.maximum(length[x], length_u[:p]) >= min_length_ratio
            fits &= own_u[:p] | own[x]
            if cross:
                fits &= chunk_u[:p] != chunk[x]
            fits = np.flatnonzero(fits)
            if len(fits):
                lacks = np.bitwise_count(without[fits] & bits[x]).sum(1, dtype=np.int64)
                near = fits[lacks <= n[x] - need[x]]
                if len(near):
                    out[0].append(np.full(len(near), r[x]) if pairs else r[x : x + 1])
                    out[1].append(r_u[near] if pairs else np.array([len(near)]))
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in out]
        return pa.table({"r": columns[0], "rep" if pairs else "m": columns[1]})

    found = dealt.groupBy("key", "i", "j").applyInArrow(meet, "r long, rep long" if pairs else "r long, m long")
    return found if pairs else found.groupBy("r").agg(F.sum("m").alias("m"))


def similar_to(later: DataFrame, reps: DataFrame, texts: DataFrame, k: int, min_length_ratio: float) -> DataFrame:
    """(r, rep) of the sequences in ``later`` and the earlier ones in ``reps`` that they resemble, verified on whole sets."""
    marked = lambda df, is_later: df.withColumn("later", F.lit(is_later)).withColumn("earlier", F.lit(not is_later))
    found = candidates(marked(later, True).unionByName(marked(reps, False)), min_length_ratio, True)
    return verified(found, later, reps, texts, k)


def verified(pairs: DataFrame, later: DataFrame, reps: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Those of the ``pairs`` (r, rep) whose sets of k-mers are as near as wanted."""
    found = cut_lineage(pairs)
    mine = found.join(later.select("r", "id", "need"), "r").join(texts, "id").select("r", "need", "rep", "sequence")
    other = reps.select(F.col("r").alias("rep"), "id").join(texts, "id").select("rep", F.col("sequence").alias("sequence_b"))

    def verify(batches):
        last, held = None, None
        for batch in batches:
            kept = []
            for rep, need, a, b in zip(batch["rep"], batch["need"], batch["sequence"], batch["sequence_b"]):
                if rep != last:
                    last, held = rep, hashed_kmers(b, k)
                wanted = hashed_kmers(a, k)
                at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                kept.append(int((held[at] == wanted).sum()) >= need)
            yield batch.loc[kept, ["r", "rep"]]

    return mine.join(other, "rep").mapInPandas(verify, "r long, rep long")


def greedy_representatives(sets: DataFrame, texts: DataFrame, k: int, min_length_ratio: float) -> DataFrame:
    """(r) of the representatives: in order of ``r``, each sequence that resembles no earlier representative.

    In a round, a sequence that by its bitmap resembles no earlier open one resembles none that is not settled yet, so it
    is a representative; what resembles it is settled too. A large group of copies is not verified against itself: all its
    members meet their representative in the round in which that one is found. Once the open ones have few pairs that may
    be near, all of these are verified and the rest follows from them.
    """
    open_ = sets
    found = []
    while True:
        both = open_.withColumn("later", F.lit(True)).withColumn("earlier", F.lit(True))
        waiting = cut_lineage(candidates(both, min_length_ratio, False))
        total = waiting.agg(F.sum("m")).first()[0] or 0
        if total <= PAIRS_PER_ROW * open_.count():
            near = verified(candidates(both, min_length_ratio, True), open_, open_, texts, k)
            return reduce(DataFrame.unionByName, [*found, first_of_neighbours(open_.select("r"), near)])
        new = open_.join(waiting, "r", "left_anti")
        later = open_.join(waiting, "r", "left_semi")
        found.append(cut_lineage(new.select("r")))
        settled = similar_to(later, new, texts, k, min_length_ratio).select("r").distinct()
        open_ = cut_lineage(later.join(settled, "r", "left_anti"))


def first_of_neighbours(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(r) of the representatives among ``rows``, when all their pairs (r, rep) that resemble each other are listed."""
    near = cut_lineage(near)
    found = [rows.join(near, "r", "left_anti")]
    while not near.isEmpty():
        # Whoever has no earlier open neighbour is a representative; their neighbours leave with all their pairs.
        first = near.select(F.col("rep").alias("r")).distinct().join(near.select("r"), "r", "left_anti")
        gone = cut_lineage(near.join(first.withColumnRenamed("r", "rep"), "rep", "left_semi").select("r").distinct())
        rest = near.join(gone, "r", "left_anti").join(gone.withColumnRenamed("r", "rep"), "rep", "left_anti")
        rest = cut_lineage(rest)
        # Of those that stay, who lost the last earlier neighbour is free.
        free = near.select("r").distinct().join(gone, "r", "left_anti").join(rest.select("r"), "r", "left_anti")
        found.append(cut_lineage(free))
        near = rest
    return reduce(DataFrame.unionByName, found)


def cluster_by_kmers(
    sequences: DataFrame, key: str, k: int = 8, min_shared: float = 0.8, min_length_ratio: float = 0.9
) -> DataFrame:
    """Clusters of similar sequences: (member, rep), a row per row of ``sequences``.

    In order of falling k-mer count, a sequence joins the first representative that it resembles, else it becomes one.
    Two sequences resemble each other when the shorter set has ``min_shared`` of its distinct k-mers in the other and
    the lengths are within ``min_length_ratio``; this is not alignment identity. Every member resembles its own
    representative. Equal sequences count once and share it; the least id stands for them. Sequences shorter than ``k``
    and nulls (as empty) stand alone with their equals.
    """
    mine = sequences.select(F.col(key).alias("member"), F.coalesce("sequence", F.lit("")).alias("sequence"))
    mine = mine.withColumn("_h", F.sha2("sequence", 256))
    named = cut_lineage(mine.groupBy("_h").agg(F.min("member").alias("id")))
    one = mine.join(named, "_h").where(F.col("member") == F.col("id")).dropDuplicates(["id"]).select("id", "sequence")
    one.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    texts = cut_lineage(one)
    marked = cut_lineage(marked_sets(texts, k, class_width(min_length_ratio)))
    digest = F.md5(F.col("id").cast("string"))
    numbered = ordered_index(
        marked.select("id", "n").withColumn("d", digest), [], F.struct(-F.col("n"), F.substring("d", 1, 2)), [-F.col("n"), "d", "id"], "r"
    )
    need = F.ceil(F.round(F.col("n") * F.lit(min_shared), 9)).cast("int")
    sets = cut_lineage(marked.withColumn("need", need).join(numbered.select("id", F.col("r").cast("long").alias("r")), "id"))
    chosen = cut_lineage(greedy_representatives(sets, texts, k, min_length_ratio))
    reps = sets.join(chosen, "r", "left_semi")
    others = sets.join(chosen, "r", "left_anti")
    first = similar_to(others, reps, texts, k, min_length_ratio).groupBy("r").agg(F.min("rep").alias("rep"))
    ids = sets.select(F.col("r").alias("rep"), F.col("id").alias("rep_id"))
    placed = sets.select("r", "id").join(first, "r").join(ids, "rep").select("id", "rep_id")
    by_text = named.join(placed, "id", "left").select("_h", F.coalesce("rep_id", "id").alias("rep"))
    return mine.select("member", "_h").join(by_text, "_h").select("member", "rep")
