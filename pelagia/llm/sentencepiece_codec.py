"""SentencePiece encoding and decoding for merge-type vocabularies."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.shared import giving_back

SPACE = "▁"  # fixed value: what a vocabulary writes for a space
CACHE_SEGMENTS = 250_000  # segments in one generation of a task's memory, which so never grows with the data
FEWER_SEGMENTS = 100_000  # the same where a job goes on in the same workers: more time, less memory
LIBRARY_BATCH = 4096
SHORT = 32  # symbols
NO_PAIR = 1 << 40  # above every rank


class Codec:
    """Encodes and decodes with one merge-type vocabulary with byte pieces.

    A text is cut where no piece can reach across: before a run of spaces, around white space that occurs in no longer
    piece, and between a word and a mark that follows a letter in no piece. Within a segment, an agenda of adjacent symbol pairs ordered by (score, place) yields the next
    merge. Each segment is worked out once per task and then remembered.
    """

    def __init__(self, model_file: str, remembered: int | None = None):
        import sentencepiece

        self.remembered = remembered or CACHE_SEGMENTS
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        self.end_id = lib.eos_id()
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.pieces: list[bytes] = []
        self.byte_ids = [0] * 256
        longer: set[str] = set()
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            self.scores.append(lib.get_score(i))
            if lib.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.pieces.append(bytes([value]))
            elif lib.is_control(i):
                self.pieces.append(b"")
            elif lib.is_unknown(i):
                self.pieces.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.pieces.append(piece.replace(SPACE, " ").encode())
                if len(piece) > 1:
                    longer.update(piece)
                    if SPACE in piece.lstrip(SPACE):
                        raise ValueError("a piece holds a space after another character")
        alone = "".join(re.escape(c) for c in "\n\r\t\x0b\x0c" if c not in longer)
        after_letter = set(re.findall(r"(?<=[^\W\d_])[!-/:-@\[-`{-~]", "\n".join(self.ids)))
        ends = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after_letter and c != "_")
        word = f"{SPACE}*+[^\\W\\d_]++(?=[{ends}])|" if ends else ""
        self.segments = re.compile(f"{word}[{alone or chr(0xFFFF)}]|{SPACE}++[^{SPACE}{alone}]*+|[^{SPACE}{alone}]++").findall
        levels = {score: rank for rank, score in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.ranks = {piece: levels[self.scores[i]] for piece, i in self.ids.items()}
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self.controls = {i for i, piece in enumerate(self.pieces) if not piece}
        self.spaced = {i for i in range(len(self.pieces)) if lib.id_to_piece(i).startswith(SPACE)}
        self.memory: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment, from the agenda.

        An entry is one integer, the pair's rank above its place, so the best score comes first and then the leftmost
        place. An entry counts only if the pair that now stands at its place has its rank.
        """
        symbols = list(segment)
        n = len(symbols)
        if n <= SHORT:
            self.merge_short(symbols)
            return self.ids_of(symbols)
        rank_of = self.ranks.get
        pair = [*map(rank_of, map(str.__add__, symbols, symbols[1:])), None]  # rank of the pair that begins at a place
        agenda = [rank << 32 | i for i, rank in enumerate(pair) if rank is not None]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & 0xFFFFFFFF
            if pair[i] != entry >> 32:
                continue
            j = right[i]
            merged = symbols[i] = symbols[i] + symbols[j]
            symbols[j] = pair[i] = pair[j] = None
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                rank = pair[i] = rank_of(merged + symbols[after])
                if rank is not None:
                    heapq.heappush(agenda, rank << 32 | i)
            before = left[i]
            if before >= 0:
                rank = pair[before] = rank_of(symbols[before] + merged)
                if rank is not None:
                    heapq.heappush(agenda, rank << 32 | before)
        return self.ids_of([x for x in symbols if x is not None])

    def merge_short(self, symbols: list[str]) -> None:
        """The same for few symbols, whose agenda is a plain list in order of place: its least is found faster than a heap is kept."""
        rank_of = self.ranks.get
        agenda = [*map(rank_of, map(str.__add__, symbols, symbols[1:]), repeat(NO_PAIR))]
        while agenda:
            least = min(agenda)
            if least == NO_PAIR:
                return
            i = agenda.index(least)
            merged = symbols[i] + symbols.pop(i + 1)
            symbols[i] = merged
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank_of(merged + symbols[i + 1], NO_PAIR)
            if i:
                agenda[i - 1] = rank_of(symbols[i - 1] + merged, NO_PAIR)

    def ids_of(self, symbols: list[str]) -> list[int]:
        out = []
        for symbol in symbols:
            found = self.ids.get(symbol)
            if found is not None:
                out.append(found)
            else:
                out.extend([self.byte_ids[b] for b in symbol.encode()])
        return out

    def learn(self, segments: list[str]) -> None:
        """Encode new segments by the agenda and hold the ids against the library."""
        head = self.library.encode("\n", num_threads=1)
        for at in range(0, len(segments), LIBRARY_BATCH):
            part = segments[at : at + LIBRARY_BATCH]
            # The "\n" in front keeps the library's own prefix apart from the segment's spaces.
            theirs = self.library.encode(["\n" + s for s in part], num_threads=1)
            for segment, known in zip(part, theirs):
                ids = self.merge(segment)
                if head + ids != known:
                    raise ValueError(f"segment {segment[:80]!r}: agenda gives {ids[:20]}, the library {known[len(head):][:20]}")
                self.memory[segment] = array("i", ids).tobytes()

    def cut(self, text: str) -> list[str]:
        return self.segments(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, the end id last.

        Two generations of memory: when the young one is full it becomes the old one, from which segments that are
        met again return.
        """
        cuts = [self.cut(t or "") for t in texts]
        if len(self.memory) > self.remembered:
            self.old, self.memory = self.memory, {}
        new = set().union(*cuts).difference(self.memory)
        met = new.intersection(self.old)
        self.memory.update((s, self.old[s]) for s in met)
        self.learn(list(new - met))
        memory, end = self.memory, array("i", [self.end_id]).tobytes()
        return [np.frombuffer(b"".join([memory[s] for s in c]) + end, dtype=np.int32) for c in cuts]

    def forget(self) -> None:
        """Drop the memory: workers outlive a task, and what is rare in one task is as rare in the next."""
        self.memory, self.old = {}, {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text followed by the end id."""
        return self.encode_batch([text])[0].tolist()

    def written(self, ids: np.ndarray) -> str:
        """Decimal ids joined by one space."""
        return " ".join([self.decimals[i] for i in ids.tolist()])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces in order, each invalid byte as U+FFFD, without the space put before the first piece."""
        ends = [k for k, i in enumerate(ids) if i in self.controls]  # a control piece ends a run of bytes
        begins = [0, *[k + 1 for k in ends]]
        text = "".join([b"".join([self.pieces[i] for i in ids[a:b]]).decode("utf-8", "each_byte") for a, b in zip(begins, [*ends, len(ids)])])
        first = next((i for i in ids if i not in self.controls), None)
        return text[1:] if first in self.spaced else text


def each_byte(error: UnicodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("each_byte", each_byte)


@lru_cache(maxsize=4)
def codec(model_file: str, remembered: int | None = None) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec(model_file, remembered)


def digest_of(model: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    listed = ids.tolist()
    return len(listed), hashlib.sha256(model.written(ids).encode()).hexdigest(), hashlib.sha256(model.decode(listed).encode()).hexdigest()


DIGESTS = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def pieces(column: pa.ChunkedArray | pa.Array, size: int = 500_000) -> Iterator[list[str | None]]:
    """Texts in lists of about ``size`` characters, so that a batch of long texts stays small."""
    out, held = [], 0
    for value in column:
        text = value.as_py()
        out.append(text)
        held += len(text or "")
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def text_batches(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        at = 0
        for texts in pieces(batch.column(batch.schema.get_field_index(text_col))):
            yield batch.slice(at, len(texts)), texts
            at += len(texts)


def run(docs: DataFrame, text_col: str, keep: dict[str, str], extra: str, work: Callable, done: Callable = lambda: None) -> DataFrame:
    """``docs`` through ``work(texts) -> arrays``; ``keep`` maps source columns to the names they get.

    ``done`` is called at the end of every task.
    """
    chosen = docs.select(F.col(text_col).alias("text_in_"), *[F.col(f"`{a}`").alias(b) for a, b in keep.items()])
    fields = [f for f in chosen.schema.fields if f.name != "text_in_"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [extra])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text_in_"):
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text_in_"]
            names = [n for n in batch.schema.names if n != "text_in_"]
            new = work(texts)
            yield pa.RecordBatch.from_arrays(kept + list(new.values()), names=names + list(new))

    return chosen.mapInArrow(giving_back(each, done), schema)


def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, decoded from its ids.

    Null and empty texts have the end id alone and decode to nothing. Rows with null or repeated ids are worked each; an
    empty table gives no rows; other columns are not read. Batches are cut by characters, so memory is set by the
    longest text.
    """

    def work(texts: list[str | None]) -> dict[str, pa.Array]:
        model = codec(model_file)
        rows = [digest_of(model, ids) for ids in model.encode_batch(texts)]
        return {f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(DIGESTS)}

    return run(docs, text_col, {id_col: "id"}, "n_tokens long, ids_sha256 string, decoded_sha256 string", work, lambda: codec(model_file).forget())


def encode_texts(docs: DataFrame, model_file: str, text_col: str = "text", remembered: int = FEWER_SEGMENTS) -> DataFrame:
    """``docs`` without its text, plus ``ids`` (end id last) and ``decoded``.

    Every text is encoded whole; null and empty texts give the end id alone and an empty ``decoded``. All other columns
    pass through; a column of ``docs`` named ``ids`` or ``decoded`` is kept as ``ids_in`` or ``decoded_in``. Workers keep
    ``remembered`` segments a generation, and nothing of the vocabulary once a task has ended.
    """

    def work(texts: list[str | None]) -> dict[str, pa.Array]:
        model = codec(model_file, remembered)
        rows = model.encode_batch(texts)
        ends = np.cumsum([0, *[len(i) for i in rows]], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], pa.int32()))
        return {"ids": ids, "decoded": pa.array([model.decode(i.tolist()) for i in rows], pa.string())}

    keep = {c: f"{c}_in" if c in ("ids", "decoded") else c for c in docs.columns if c != text_col}
    return run(docs, text_col, keep, "ids array<int>, decoded string", work, codec.cache_clear)


def decode_ids(tokens: DataFrame, model_file: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with ``ids_col`` decoded into ``out``, which replaces a column of that name.

    Null ids give null, an empty list an empty text; all other columns and repeated rows pass through; an empty table
    gives no rows.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields if f.name != out] + [f"`{out}` string"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != out]
            values = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            text = pa.array([None if v is None else codec(model_file).decode(v) for v in values], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [text], names=[*names, out])

    return tokens.mapInArrow(each, schema)
