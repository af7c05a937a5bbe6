"""Periodic runs of words: Lyndon roots from the first phase of a suffix sorter, extended on both sides."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.byte_kernels import Prefixes, mix
from pelagia.llm.sentencepiece_codec import text_batches
from pelagia.llm.shared import give_back

EXPONENT = 4  # a run holds its period at least so often
LEAST = 6  # and at least so many words
RUNS = "array<struct<start:long,length:long,period:long>>"


def lyndon_lengths(codes: list[int]) -> list[int]:
    """For each place, the length of the longest Lyndon word that begins there.

    Places are kept in groups, ordered by what the places of a group begin with; at first that is one symbol. Groups are
    worked off from the greatest down. From each place of the group, the nearest earlier place of a smaller group is
    looked up; that place's text goes on with the group's text, as often as it was found. Places found equally often
    leave their group for one right above it, those found more often higher up. In the end all places of a group begin
    with the same Lyndon word, their longest.
    """
    n = len(codes)
    order = {c: g for g, c in enumerate(sorted(set(codes)))}
    group = [order[c] for c in codes]
    members: list[list[int]] = [[] for _ in order]
    for place, g in enumerate(group):
        members[g].append(place)
    live = [len(m) for m in members]
    size = [1] * len(members)
    above = [*range(1, len(members)), -1]
    below = [*range(-1, len(members) - 1)]
    open_ = list(range(n + 1))  # place i stands at i + 1; a finished one points to its left
    g = len(members) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        for i in mine:
            open_[i + 1] = i
        found: dict[int, int] = defaultdict(int)
        for i in mine:
            j = i
            while open_[j] != j:
                open_[j] = open_[open_[j]]
                j = open_[j]
            if j:
                found[j - 1] += 1
        moves: dict[tuple[int, int], list[int]] = defaultdict(list)
        for j, times in found.items():
            moves[times, group[j]].append(j)
        for times, old in sorted(moves, reverse=True):
            moved = moves[times, old]
            if len(moved) == live[old]:  # all go: the group itself becomes the new one
                size[old] += times * size[g]
                continue
            new, over = len(members), above[old]
            members.append(moved)
            live.append(len(moved))
            live[old] -= len(moved)
            size.append(size[old] + times * size[g])
            above.append(over)
            below.append(old)
            above[old] = new
            if over >= 0:
                below[over] = new
            for j in moved:
                group[j] = new
        g = below[g]
    return [size[g] for g in group]


def extension(prefix: Prefixes, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How far the sequences at places ``a`` and ``b`` agree, up to ``most``, to the right (step 1) or the left (-1)."""
    low, high = np.zeros(len(a), dtype=np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        if step > 0:
            same = prefix.stretch(a, a + middle) == prefix.stretch(b, b + middle)
        else:
            same = prefix.stretch(a - middle, a) == prefix.stretch(b - middle, b)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def plain_extension(codes: np.ndarray, begin: int, end: int, a: int, period: int) -> tuple[int, int]:
    """The same run by comparing symbols: where the period ``period`` around ``a`` holds within [begin, end)."""
    left, right = a, a + period
    while right < end and codes[right] == codes[right - period]:
        right += 1
    while left > begin and codes[left - 1] == codes[left - 1 + period]:
        left -= 1
    return left, right


def repeated_stretches(codes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of one document's words outside which no run reaches.

    A run of period q and length L >= max(6, 4q) has L - 2 triples of neighbouring words; each comes back q words later,
    and so occurs three times or more in the run (for q = 1: four times). So a run lies within a stretch all of whose
    triples occur three times or more in the document, and every run that begins in a stretch ends in it.
    """
    if len(codes) < LEAST:
        return []
    value = codes.astype(np.uint64)
    triple = mix(value[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix(value[1:-1] + np.uint64(1)) + mix(value[2:] * np.uint64(0xC2B2AE3D27D4EB4F) + doc[2:].astype(np.uint64)))
    order = np.argsort(triple)
    ordered = triple[order]
    third = np.flatnonzero(ordered[2:] == ordered[:-2])  # a hash met by others only widens a stretch
    often = np.zeros(len(triple), dtype=bool)
    for shift in range(3):
        often[order[third + shift]] = True
    often &= doc[:-2] == doc[2:]
    edge = np.diff(np.concatenate([[0], often.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 2
    out = []
    for a, b in zip(begin.tolist(), end.tolist()):
        cuts = [a, *(np.flatnonzero(np.diff(doc[a:b])) + a + 1).tolist(), b]
        out.extend((x, y) for x, y in zip(cuts, cuts[1:]) if y - x >= LEAST)
    return out


def runs_of(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of the documents laid end to end, ordered by start, then period.

    Every run holds a place from which its period is the longest Lyndon word, under the order of the symbols or its
    reverse, so extending these words to both sides finds all runs.
    """
    found = []
    for begin, end in repeated_stretches(codes, doc):
        part = codes[begin:end].tolist()
        for symbols in (part, [-c for c in part]):
            period = np.array(lyndon_lengths(symbols))
            at = np.flatnonzero((period * EXPONENT <= end - begin) & (np.arange(len(part)) + period < len(part)))
            found.append(np.column_stack([at + begin, period[at], np.full(len(at), begin), np.full(len(at), end)]))
    roots = np.concatenate(found) if found else np.empty((0, 4), dtype=np.int64)
    if not len(roots):
        return np.empty((0, 3), dtype=np.int64)
    roots = roots[codes[roots[:, 0]] == codes[roots[:, 0] + roots[:, 1]]]
    at, lengths, begin, end = roots.T
    prefix = Prefixes(mix(codes.astype(np.uint64) + np.uint64(1)))
    starts = at - extension(prefix, at, at + lengths, at - begin, -1)
    stops = at + lengths + extension(prefix, at, at + lengths, end - at - lengths, 1)
    keep = stops - starts >= np.maximum(LEAST, EXPONENT * lengths)
    runs = np.unique(np.column_stack([starts, stops, lengths, begin, end])[keep], axis=0)
    out = []
    for start, stop, period, begin, end in runs.tolist():
        if not np.array_equal(codes[start : stop - period], codes[start + period : stop]):  # two words' hashes met
            for a in at[(starts == start) & (stops == stop) & (lengths == period)].tolist():
                left, right = plain_extension(codes, begin, end, a, period)
                if right - left >= max(LEAST, EXPONENT * period):
                    out.append((left, right, period))
        else:
            out.append((start, stop, period))
    return np.array(sorted(set(out), key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)


def tail_of(seed: int | None, n: int) -> tuple[int, int] | None:
    """From which word on, and with which period, a seed divisible by ten has the tail of ``n`` words repeat."""
    if seed is None or seed % 10 or not n:
        return None
    g = seed // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def work(texts: list[str | None], seeds: list[int | None]) -> tuple[list[int], list[list[dict]], list[str]]:
    """For each text: its number of words, its runs, and its words without the repetitions."""
    cut = [(t or "").encode().split() for t in texts]  # of bytes, split() knows the six separators alone
    counts = np.array([len(c) for c in cut], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    codes = pa.array([w for c in cut for w in c], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    for i, seed in enumerate(seeds):
        tail = tail_of(seed, int(counts[i]))
        if tail is not None:
            a, p = tail
            back = np.arange(counts[i])
            back[a:] = a + (back[a:] - a) % p
            codes[bounds[i] : bounds[i + 1]] = codes[bounds[i] : bounds[i + 1]][back]
            words = cut[i]
            cut[i] = [words[j] for j in back.tolist()]
    runs = runs_of(codes, np.repeat(np.arange(len(cut)), counts))
    of = np.searchsorted(bounds, runs[:, 0], "right") - 1
    listed: list[list[dict]] = [[] for _ in cut]
    gone = np.zeros(len(codes) + 1, dtype=np.int64)
    for i, (start, stop, period) in zip(of.tolist(), runs.tolist()):
        listed[i].append({"start": start - int(bounds[i]), "length": stop - start, "period": period})
        gone[start + period] += 1
        gone[stop] -= 1
    kept = np.cumsum(gone) == 0
    left = [b" ".join(c if not r else [w for w, k in zip(c, kept[b : b + len(c)].tolist()) if k]).decode() for c, r, b in zip(cut, listed, bounds.tolist())]
    return counts.tolist(), listed, left


def periodic_runs(docs: DataFrame, seed: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) of every whole text.

    ``runs`` lists each stretch of words with a least period q and a length of at least max(6, 4q) that no neighbouring
    word extends, by start, then period. ``collapsed`` has the words, joined by one space, that no run holds behind its
    first q words. ``seed`` has the tails of some texts repeat first (``tail_of``), so that there is something to find.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows with null or repeated ids are worked
    each; an empty table gives no rows; other columns are not read. Equal words are equal bytes. Nothing is shuffled, and memory is set
    by the longest text.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.lit(None) if seed is None else seed).cast("long").alias("seed"))
    kind = chosen.schema["id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            counts, runs, left = work(texts, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, shape), pa.array(left, pa.string())], names=["id", "n_words", "runs", "collapsed"]
            )
        give_back()

    return chosen.mapInArrow(each, f"id {kind}, n_words long, runs {RUNS}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text); without runs the four are null."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    first = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return first.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.least")).alias("length"),
        F.col("best.period").alias("period"), F.expr("(-1000 * best.least) div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
