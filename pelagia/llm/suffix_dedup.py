"""Suffix-array dedup of repeated byte strings, over whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.byte_kernels import Prefixes, flat, ids_of, mix, sliding_first_minimum, slices
from pelagia.llm.shared import materialize
from pelagia.llm.spans import cut_spans, later_ones, numbered

LENGTH, ANCHOR = 100, 40
CHUNK = 50_000  # contexts sorted at once
ANCHORS = "key long, context long, id long, place long, later boolean"
CONTEXTS = "key long, id long, pos int, left int, right int, before binary, after binary"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, context hash, position, left, right) of the anchors of every ``length``-byte string.

    The anchor of a string is its first ``anchor``-byte stretch of least hash, so equal strings have equal anchors at
    equal offsets. Its context is all bytes that a string with this anchor can hold: up to ``length - anchor`` on
    either side, within the text.
    """
    reach = length - anchor
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    prefix = Prefixes.of_bytes(data)
    start = np.arange(len(data) - anchor + 1)
    values = mix(prefix.stretch(start, start + anchor))
    least = sliding_first_minimum(values, reach + 1)
    text = np.searchsorted(offsets, np.arange(len(least)), "right") - 1
    inside = offsets[text + 1] - np.arange(len(least)) >= length
    place = np.unique(least[inside])
    text = np.searchsorted(offsets, place, "right") - 1
    left = np.minimum(reach, place - offsets[text])
    right = np.minimum(reach, offsets[text + 1] - place - anchor)
    context = mix(prefix.stretch(place - left, place + anchor + right) + (left * 1000 + right).astype(np.uint64))
    return text, values[place], context, place - offsets[text], left, right


def anchor_rows(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """Anchors of all texts; within a batch, rows after the first of equal contexts are marked as later ones."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rows, data, offsets in slices(iter([batch])):
                text, value, context, pos, left, right = anchors(data, offsets, length, anchor)
                found.append((value.astype(np.uint64), context.astype(np.uint64), ids_of(rows)[text], pos << 16 | left << 8 | right))
            if not found:
                continue
            value, context, ids, place = (np.concatenate(x) for x in zip(*found))
            order, later = later_ones((value, context), ids, place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (value[order].view(np.int64), context[order].view(np.int64), ids[order], place[order], later)],
                names=["key", "context", "id", "place", "later"],
            )

    return docs.mapInArrow(each, ANCHORS)


def common_extension(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b: binary search over their prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), hashes.shape[1] - 1)
    for _ in range(int(hashes.shape[1]).bit_length()):
        mid = (low + high + 1) >> 1
        same = hashes[a, mid] == hashes[b, mid]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_order(classes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equal-length rows within their classes, and each one's common prefix with the one before it.

    ``classes`` ascends. A bottom-up mergesort places every element by binary search in the run next to its own; two
    suffixes are compared by their common extension and the byte behind it. The extensions of neighbours are then
    checked against the bytes; should a hash have lied, the class is ordered by its bytes.
    """
    n, width = texts.shape
    prefix = Prefixes.of_bytes(texts.reshape(-1))
    at = np.arange(n)[:, None] * width
    hashes = prefix.stretch(np.broadcast_to(at, (n, width + 1)), at + np.arange(width + 1))
    padded = np.concatenate([texts.astype(np.int16), np.full((n, 1), -1, np.int16)], axis=1)
    begin = np.searchsorted(classes, classes, "left")
    size = np.searchsorted(classes, classes, "right") - begin
    order = np.arange(n)
    run = 1
    while n and run < size.max():
        slot = np.flatnonzero(size > run)  # places of classes that are not one run yet
        within = slot - begin[slot]
        own = within // run
        other = begin[slot] + (own ^ 1) * run
        end = begin[slot] + size[slot]
        low, high = np.minimum(other, end), np.minimum(other + run, end)
        base = low.copy()
        right_side = (own & 1) == 1
        for _ in range(int(run).bit_length()):
            open_ = np.flatnonzero(low < high)
            mid = (low[open_] + high[open_]) >> 1
            mine, theirs = order[slot[open_]], order[mid]
            k = common_extension(hashes, mine, theirs)
            x, y = padded[mine, k], padded[theirs, k]
            before = np.where(right_side[open_], y <= x, y < x)
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        target = begin[slot] + (own >> 1) * 2 * run + (within - own * run) + (low - base)
        placed = order.copy()
        placed[target] = order[slot]
        order, run = placed, run * 2
    shared = np.zeros(n, np.int64)
    if n > 1:
        claimed = common_extension(hashes, order[1:], order[:-1])
        differs = texts[order[1:]] != texts[order[:-1]]
        shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        if (claimed != shared[1:]).any():
            order = np.lexsort((*[texts[:, j] for j in range(width - 1, -1, -1)], classes))
            differs = texts[order[1:]] != texts[order[:-1]]
            shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        shared[1:][classes[1:] != classes[:-1]] = -1
    shared[:1] = -1
    return order, shared


def groups_at(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """Number of the group of rows that share a class and their first ``depth`` bytes, from the suffix order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def padded_rows(column: pa.Array, width: int, reverse: bool) -> np.ndarray:
    data, offsets = flat(column.cast(pa.large_binary()).view(pa.large_string()))
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    out[row, np.repeat(size, size) - 1 - place if reverse else place] = data
    return out


def covered(chunk: pa.Table, length: int, anchor: int) -> pa.RecordBatch:
    """(id, start, end): for each context, the bytes of its strings that an earlier context of its class holds."""
    reach = length - anchor
    chunk = chunk.combine_chunks().sort_by([("key", "ascending"), ("id", "ascending"), ("pos", "ascending")])
    col = lambda name: chunk[name].combine_chunks()
    key, ids, pos = (col(c).to_numpy() for c in ("key", "id", "pos"))
    left, right = col("left").to_numpy(), col("right").to_numpy()
    after = padded_rows(col("after"), length, False)
    after_order, after_shared = suffix_order(key, after)
    before_order, before_shared = suffix_order(key, padded_rows(col("before"), reach, True))
    high, low = np.full(len(key), -1), np.full(len(key), length)
    for t in range(reach + 1):  # strings that begin t bytes before the anchor
        row = np.flatnonzero((left >= t) & (right >= reach - t))
        if not len(row):
            continue
        pair = groups_at(before_order, before_shared, t)[row] * (len(key) + 1) + groups_at(after_order, after_shared, length - t)[row]
        _, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
        head = row[first[inverse]]
        row = row[(ids[row] != ids[head]) | (pos[row] != pos[head])]
        high[row] = np.maximum(high[row], t)
        low[row] = np.minimum(low[row], t)
    hit = np.flatnonzero(high >= 0)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[hit]), pa.array((pos[hit] - high[hit]).astype(np.int64)), pa.array((pos[hit] - low[hit] + length).astype(np.int64))], names=["id", "start", "end"]
    )


def compare_contexts(contexts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Suffix-sorts the contexts of each class; a task holds its rows by class and works off about CHUNK at once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= CHUNK:
                whole = pa.Table.from_batches(held)
                keys = whole["key"].combine_chunks().to_numpy()
                to = int(np.searchsorted(keys, keys[-1]))
                if to:
                    yield covered(whole.slice(0, to), length, anchor)
                    held = whole.slice(to).to_batches()
        if held:
            yield covered(pa.Table.from_batches(held), length, anchor)

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(each, "id long, start long, end long")


def cut_contexts(docs: DataFrame, wanted: DataFrame, length: int, anchor: int) -> DataFrame:
    """The bytes around each wanted anchor: ``before`` it, and from it on."""
    listed = wanted.groupBy("id").agg(F.collect_list(F.struct("key", "place")).alias("w"))
    joined = docs.join(listed, "id").select("id", "text", F.col("w.key").alias("keys"), F.col("w.place").alias("places"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            keys, places = rows.column(2), rows.column(3)
            count = np.diff(np.asarray(keys.offsets))
            text = np.repeat(np.arange(len(rows)), count)
            key, place = keys.flatten(), places.flatten().to_numpy()
            pos, left, right = place >> 16, place >> 8 & 255, place & 255
            at = offsets[text] + pos
            whole = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [key, pa.array(ids_of(rows)[text]), *[pa.array(x.astype(np.int32)) for x in (pos, left, right)],
                 pa.array([whole[a - b : a] for a, b in zip(at, left)], pa.binary()),
                 pa.array([whole[a : a + anchor + b] for a, b in zip(at, right)], pa.binary())],
                names=["key", "id", "pos", "left", "right", "before", "after"],
            )

    return joined.mapInArrow(each, CONTEXTS)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(id, start, end): spans whose union is every byte of a ``length``-byte string that also starts earlier."""
    both = Window.partitionBy("key")
    first = F.min(F.struct("id", "place")).over(Window.partitionBy("key", "context"))
    rows = anchor_rows(docs, length, anchor).withColumn("key", F.when(F.col("later"), F.xxhash64("id", "place")).otherwise(F.col("key")))
    rows = rows.repartition("key")  # serves both windows
    rows = rows.withColumn("again", F.col("later") | (F.struct("id", "place") > first)).withColumn(
        "mixed", ~F.col("later") & (F.min(F.when(~F.col("later"), F.col("context"))).over(both) != F.max(F.when(~F.col("later"), F.col("context"))).over(both))
    )
    rows = materialize(rows.filter("again or mixed").select("key", "id", "place", "again"), "anchors")
    pos, left, right = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    whole = rows.filter("again").select("id", (pos - left).alias("start"), (pos + anchor + right).alias("end"))
    contexts = cut_contexts(docs, rows.filter("not again").select("key", "id", "place"), length, anchor)
    return whole.unionByName(materialize(compare_contexts(contexts, length, anchor), "spans"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): texts without the bytes of strings that start earlier as well.

    A ``length``-byte string counts as repeated if it also starts at a smaller id, or earlier in the same text. Every
    string is filed under its anchor. Anchors whose whole context is equal need no comparison: all but the first
    lose it. Where one anchor has several contexts, the contexts of the class are suffix-sorted on both sides of the
    anchor, and a string is repeated if an earlier context shares its bytes to the left and to the right.

    Null and empty texts give empty bytes, texts under ``length`` bytes stay; null ids count as the last id; rows that
    repeat an id hold the same places and do not remove each other. An empty table gives an empty result.
    """
    rows = numbered(docs, id_col, text_col)
    return cut_spans(rows, repeated_spans(rows, length, anchor))
