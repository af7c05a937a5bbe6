"""BPE encoding and decoding with word-end vocabularies: a backtracking encoder and an offset-table decoder."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pelagia.llm.sentencepiece_codec import run

FINAL = 0x1000  # added to the code of a word's last symbol, so that "ends a word" is part of the symbol
CACHE_WORDS = 120_000  # words in one generation of a worker's memory, which so never grows with the data
CACHE_PAIRS = 500_000  # entries of the pair table before it is begun anew
CACHE_LENGTH = 64  # longer words are worked out each time
GATHER = 1 << 16  # ids decoded at once
PLANES = 0x40000  # code points above are no letters, numbers or spaces


def byte_symbols() -> list[str]:
    """How byte-level vocabularies write a byte: printable Latin-1 characters stand for themselves, others follow 0x100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def offset_table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All entries in one run of bytes, and where each begins; entry i ends where i + 1 begins."""
    offsets = np.zeros(len(entries) + 1, dtype=np.int64)
    np.cumsum([len(e) for e in entries], out=offsets[1:])
    return np.frombuffer(b"".join(entries), dtype=np.uint8), offsets


def look_up(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    """The entries of ``ids`` one after the other."""
    data, offsets = table
    out = []
    for at in range(0, len(ids), GATHER):
        part = ids[at : at + GATHER]
        begin, size = offsets[part], offsets[part + 1] - offsets[part]
        after = np.cumsum(size)
        out.append(data[np.repeat(begin - after + size, size) + np.arange(after[-1])].tobytes())
    return b"".join(out)


def ranges(members: set[str]) -> str:
    """Members of a bracket expression."""
    codes = np.array(sorted(map(ord, members)))
    cuts = np.flatnonzero(np.diff(codes) > 1) + 1
    return "".join([f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in np.split(codes, cuts)])


def library_characters() -> tuple[dict[str, set[str]], dict[str, str]]:
    """Which characters the library takes for letters, numbers and spaces, and those that it lowers in its own way."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    known = [chr(c) for c in range(PLANES) if not 0xD800 <= c < 0xE000]
    every = "".join(known)
    classes = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        found = pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(every)
        classes[name] = set("".join([part for part, _ in found]))
    lower = normalizers.Lowercase().normalize_str("\n".join(known)).split("\n")
    lower[10:12] = ["\n"]  # the line feed itself was two cuts
    return classes, {c: to for c, to in zip(known, lower) if to != c.lower()}


class BpeCodec:
    """Encodes and decodes with one merge vocabulary whose words end in a suffix.

    A word is taken apart from the left: the longest token that begins at a place (from an Aho-Corasick pass) is tried
    first, then ever shorter ones. A token is taken if it may stand behind the one before and its end is not known as
    dead; if none may, the place is dead and the token before is taken back. Two tokens may stand side by side if
    merging their symbols alone would yield them, and a row of tokens of which all neighbours may is exactly what the
    merges give. Each place dies once, so a word takes time in proportion to its length.
    """

    def __init__(self, file: str):
        import ahocorasick
        import regex
        from tokenizers import normalizers

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or level["type"] != "ByteLevel" or not suffix:
            raise ValueError("not a lower-case vocabulary with word ends")
        self.compose = normalizers.NFC().normalize_str
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        classes, self.lowered = library_characters()
        every = "".join(map(chr, range(PLANES)))
        self.odd = set(self.lowered)  # what the library's edition of Unicode takes otherwise than the one here
        for name, members in classes.items():  # each stands in brackets
            self.odd |= members.symmetric_difference(regex.findall(name, every))
            pattern = pattern.replace(name, ranges(members))
        self.odd_words = re.compile(pattern).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

        letters = byte_symbols()
        self.forms: dict[int, str] = {}
        for b, letter in enumerate(letters):
            for text, form in ((letter, chr(b)), (letter + suffix, chr(b + FINAL))):
                if text in vocabulary:
                    self.forms[vocabulary[text]] = form
        self.rank = dict.fromkeys(self.forms, -1)  # merge that makes a token
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if left not in self.forms or right not in self.forms or made in self.forms:
                raise ValueError("merges must follow the tokens that they join, and each make a new one")
            self.forms[made] = self.forms[left] + self.forms[right]
            self.rank[made], self.parts[made], self.pairs[left, right] = rank, (left, right), rank
        # A token that its own symbols would not merge into stands in no encoding.
        usable = set()
        for token in self.forms:
            if token not in self.parts or usable.issuperset(self.parts[token]) and self.meet(*self.parts[token], self.rank[token]):
                usable.add(token)
        by_form = self.whole = {self.forms[t]: t for t in usable}
        self.shorter: dict[int, int | None] = {}  # the longest other token that a token begins with
        self.finder = ahocorasick.Automaton()
        for form, token in by_form.items():
            self.shorter[token] = next((by_form[form[:n]] for n in range(len(form) - 1, 0, -1) if form[:n] in by_form), None)
            self.finder.add_word(form, (len(form), token))
        self.finder.make_automaton()
        self.length = {t: len(self.forms[t]) for t in usable}
        self.compatible: dict[int, bool] = {}

        names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        top = max(names) + 1
        self.texts = offset_table([names[i].encode() + b" " if i in names else b"" for i in range(top)])
        self.decimals = offset_table([b"%d " % i for i in range(top)])
        self.memory: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def meet(self, x: int, y: int, before: int | None = None) -> bool:
        """Do ``x`` and ``y`` stay apart under all merges (of a rank below ``before``)?

        Their merges are undone, the latest first. On the way the symbols on both sides of the seam are those that stood
        there at that time; if they have a merge that comes earlier than the one just undone, it would have joined them.
        Of equal merges the left one comes first.
        """
        limit = len(self.pairs) + 1 if before is None else before
        while True:
            if self.pairs.get((x, y), limit) < limit:
                return False
            if self.rank[x] > self.rank[y]:
                limit = min(limit, self.rank[x])
                x = self.parts[x][1]
            elif y in self.parts:
                limit = min(limit, self.rank[y] + 1)
                y = self.parts[y][0]
            else:
                return True

    def may_follow(self, x: int, y: int) -> bool:
        """``meet`` from the pair table, which is filled as pairs come up and begun anew when it is full."""
        key = x << 32 | y
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) >= CACHE_PAIRS:
                self.compatible = {}
            found = self.compatible[key] = self.meet(x, y)
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word."""
        raw = word.encode()
        symbols = raw[:-1].decode("latin-1") + chr(raw[-1] + FINAL)
        whole = self.whole.get(symbols)
        if whole is not None:
            return [whole]
        n = len(symbols)
        longest = [0] * n
        for end, (size, token) in self.finder.iter(symbols):  # ends go up, so the longest comes last
            longest[end - size + 1] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + self.length[token]
            if not dead[end] and (not out or self.may_follow(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else token
                continue
            shorter = self.shorter[token]
            while shorter is None:  # nothing may stand here
                dead[at] = 1
                last = out.pop()
                at -= self.length[last]
                shorter = self.shorter[last]
            token = shorter
        return out

    def parts_of(self, text: str) -> list[str]:
        """Words of a text after normalisation, and the special tokens that it spells out."""
        if self.specials is None:
            return self.normal_words(text)
        out: list[str] = []
        for i, part in enumerate(self.specials(text)):
            out.extend([part] if i % 2 else self.normal_words(part))
        return out

    def normal_words(self, text: str) -> list[str]:
        if text.isascii():
            return self.words(text.lower())
        # Lower case goes character by character, so a sigma never becomes a final one.
        text = self.compose(text).replace("Σ", "σ")
        if self.odd.isdisjoint(text):
            return self.words(text.lower())
        return self.odd_words("".join([self.lowered.get(c) or c.lower() for c in text]))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. Words are remembered in two generations; one that is met again moves to the young one."""
        cuts = [self.parts_of(t) if t else [] for t in texts]
        if len(self.memory) > CACHE_WORDS:
            self.old, self.memory = self.memory, {}
        known = self.memory
        long: dict[str, bytes] = {}
        for word in set().union(*cuts).difference(known):
            ids = self.old.get(word)
            if ids is None:
                ids = array("i", [self.special[word]] if word in self.special else self.encode_word(word)).tobytes()
            (known if len(word) <= CACHE_LENGTH else long)[word] = ids
        if long:
            return [np.frombuffer(b"".join([known[w] if w in known else long[w] for w in c]), dtype=np.int32) for c in cuts]
        return [np.frombuffer(b"".join([known[w] for w in c]), dtype=np.int32) for c in cuts]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Tokens as the vocabulary writes them, one space between two, special ones included."""
        return look_up(self.texts, ids)[:-1]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; ids that the vocabulary does not have are left out."""
        wanted = np.array(ids, dtype=np.int64)
        return self.decode_bytes(wanted[(wanted >= 0) & (wanted < len(self.texts[1]) - 1)]).decode()


@lru_cache(maxsize=2)
def bpe_codec(file: str) -> BpeCodec:
    """One codec per worker and vocabulary."""
    return BpeCodec(file)


def bpe_digests(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, decoded from its ids.

    Null and empty texts, and texts of white space only, have no ids: 0 and the digests of the empty string. Rows with null or repeated
    ids are worked each; an empty table gives no rows; other columns are not read. Batches are cut by characters, so
    memory is set by the longest text.
    """

    def work(texts: list[str | None]) -> dict[str, pa.Array]:
        codec = bpe_codec(file)
        ids = codec.encode_batch(texts)
        listed = [hashlib.sha256(look_up(codec.decimals, i)[:-1]).hexdigest() for i in ids]
        decoded = [hashlib.sha256(codec.decode_bytes(i)).hexdigest() for i in ids]
        return {"n_tokens": pa.array([len(i) for i in ids], pa.int64()), "ids_sha256": pa.array(listed, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    return run(docs, text_col, {id_col: "id"}, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def bpe_encode(docs: DataFrame, file: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` in place of its text; null and empty texts give no ids.

    All other columns pass through; one named ``ids`` is kept as ``ids_in``.
    """

    def work(texts: list[str | None]) -> dict[str, pa.Array]:
        ids = bpe_codec(file).encode_batch(texts)
        ends = np.cumsum([0, *[len(i) for i in ids]], dtype=np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else [], pa.int32()))}

    return run(docs, text_col, {c: "ids_in" if c == "ids" else c for c in docs.columns if c != text_col}, "ids array<int>", work)


def bpe_decode(tokens: DataFrame, file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with its ids decoded into ``out`` (which replaces a column of that name); null ids give null."""
    kept = [f for f in tokens.schema.fields if f.name != out]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{out}` string"])
    names = [f.name for f in kept]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe_codec(file)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            texts = pa.array([codec.decode(v.as_py()) if v.is_valid else None for v in column], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], texts], names=[*names, out])

    return tokens.mapInArrow(each, schema)
