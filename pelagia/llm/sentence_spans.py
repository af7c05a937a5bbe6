"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.byte_kernels import Prefixes, Words, ids_of, mix, sliding_first_minimum, slices
from pelagia.llm.spans import cut_spans, later_ones, numbered

SENTENCES_IN_RUN = 3
MOST_WORDS = 16
LEAST_WORDS = 8
RUNS = "key long, id long, start int, end int, later boolean"
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[0x21, 0x2E, 0x3F]] = True  # ! . ?


def content_cuts(hashes: np.ndarray, begins: np.ndarray, most: int) -> np.ndarray:
    """Which words begin a sentence: those of ``begins``, and in longer sentences each word after a least one.

    In every ``most`` consecutive words of a sentence, one is cut behind the first word of least hash. Stretches of equal
    words are so cut at equal places, whatever stands before them, and no piece is longer than ``most`` words.
    """
    n = len(hashes)
    begins = begins.copy()
    if n <= most:
        return begins
    least = sliding_first_minimum(hashes, most)
    sentence = np.cumsum(begins)
    whole = sentence[: len(least)] == sentence[most - 1 :]
    # A sentence of exactly ``most`` words is not too long.
    longer = np.bincount(sentence, minlength=sentence[-1] + 1)[sentence[: len(least)]] > most
    cut = least[whole & longer] + 1
    begins[cut[cut < n]] = True
    return begins


def extended_runs(first: np.ndarray, next_word: np.ndarray, text: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first sentence, last sentence) of the shortest runs of ``run`` sentences and ``least`` words at least.

    The shortest from each sentence on and the shortest up to each sentence, so that a passage is covered to both ends.
    """
    place = np.arange(len(first))
    tail = np.maximum(place + run - 1, np.searchsorted(next_word, first + least, "left"))
    head = np.minimum(place - run + 1, np.searchsorted(first, next_word - least, "right") - 1)
    on, back = tail < len(first), head >= 0
    pairs = np.unique(np.column_stack([np.r_[place[on], head[back]], np.r_[tail[on], place[back]]]), axis=0)
    pairs = pairs[text[pairs[:, 0]] == text[pairs[:, 1]]]
    return pairs[:, 0], pairs[:, 1]


def sentence_runs(data: np.ndarray, offsets: np.ndarray, run: int, most: int, least: int, by_content: bool = False) -> tuple[np.ndarray, ...]:
    """(text number, hash, start, end) of every run of ``run`` consecutive sentences of at least ``least`` words.

    A sentence ends with a word that ends in ``.``, ``!`` or ``?``, at a line break, and after ``most`` words at the
    latest; with ``by_content``, longer sentences are cut by ``content_cuts`` and short runs go on to ``least`` words.
    The hash is over the words, so white space does not count; the bytes reach to the next sentence.
    """
    words = Words(data, offsets)
    n = len(words.hash)
    if not n:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    ends = np.zeros(n, dtype=bool)
    ends[:-1] = _STOPS[data[words.end[:-1] - 1]] | (lines[words.start[1:]] > lines[words.end[:-1]]) | (words.text[1:] != words.text[:-1])
    begins = np.ones(n, dtype=bool)
    begins[1:] = ends[:-1]
    if by_content:
        first = np.flatnonzero(content_cuts(words.hash, begins, most))
    else:
        place = np.arange(n)
        since = place - np.maximum.accumulate(np.where(begins, place, 0))
        first = np.flatnonzero(since % most == 0)
    text = words.text[first]
    next_word = np.r_[first[1:], n]
    next_byte = np.where(np.r_[text[1:], -1] == text, np.r_[words.start[first[1:]], 0], offsets[text + 1])
    if by_content:
        head, tail = extended_runs(first, next_word, text, run, least)
    else:
        head = np.arange(max(0, len(first) - run + 1))
        tail = head + run - 1
        keep = (text[head] == text[tail]) & (next_word[tail] - first[head] >= least)
        head, tail = head[keep], tail[keep]
    value = mix(Prefixes(words.hash).stretch(first[head], next_word[tail]) + (next_word[tail] - first[head]).astype(np.uint64))
    base = offsets[text[head]]
    return text[head], value, words.start[first[head]] - base, next_byte[tail] - base


def repeated_runs(docs: DataFrame, run: int, most: int, least: int, by_content: bool = False) -> DataFrame:
    """(id, start, end) of every run that an earlier place (smaller id, or earlier in the text) holds too.

    Each batch first finds the later ones among its own rows; only the first row of a hash goes to the join, so a hash
    sends one row a batch, however often it occurs.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rows, data, offsets in slices(iter([batch])):
                text, value, start, end = sentence_runs(data, offsets, run, most, least, by_content)
                found.append((value.astype(np.uint64), ids_of(rows)[text], start, end))
            if not found:
                continue
            value, ids, start, end = (np.concatenate(x) for x in zip(*found))
            order, later = later_ones((value,), ids, start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (value[order].view(np.int64), ids[order], start[order].astype(np.int32), end[order].astype(np.int32), later)],
                names=["key", "id", "start", "end", "later"],
            )

    runs = docs.mapInArrow(each, RUNS).withColumn("key", F.when(F.col("later"), F.xxhash64("id", "start")).otherwise(F.col("key")))
    same = Window.partitionBy("key", "later")
    first = F.min(F.struct("id", "start")).over(same)
    return runs.withColumn("first", first).filter(F.col("later") | (F.struct("id", "start") > F.col("first"))).select("id", "start", "end")


def sentence_dedup(
    docs: DataFrame, run: int = SENTENCES_IN_RUN, most: int = MOST_WORDS, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text",
    by_content: bool = False,
) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): every text without the sentences of runs that occurred before.

    Runs of ``run`` consecutive sentences are hashed over their words and joined over all documents. The first place
    of a run (least id, then position) stays; the sentences of every other are removed, up to the next sentence.
    ``least`` words a run keep chance repeats of tiny sentences; sentences are cut after ``most`` words, so a long
    passage without stops has runs too. With ``by_content`` such cuts depend on the words around them alone, so passages
    meet at any offset, and a run of tiny sentences goes on until it has ``least`` words. Texts with fewer sentences stay whole. Null and empty texts give empty bytes;
    rows with null ids count as the last id; rows that repeat an id hold the same place and do not remove each other.
    """
    rows = numbered(docs, id_col, text_col)
    return cut_spans(rows, repeated_runs(rows, run, most, least, by_content))
