"""The BPE codec against the tokenizers library, and the merges worked off one by one."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from pelagia.llm import bpe_codec, queries

SF = "/root/testdata/sf0.01"
PIECES = ["a", "b", "e", "th", "in", " ", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|", "é", "É", "Σ", "ΑΣ ", "İ", "ß", "中文", "😀", "\x85",
    "\x1c", " ", "1", "23", "²", "Ⅷ", "_", "!!!", "</w>", "\n", "\t", "ing", "\x00", "aaaa", "᫃́", "Ᲊ", "Ꟛ", "\U00010d40", "ก็", "ﷺ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.word_vocabulary())


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.bpe_codec(queries.word_vocabulary())


def by_merges(codec, word):
    """One merge after the other, the earliest rank first and of those the leftmost."""
    raw = word.encode()
    symbols = raw[:-1].decode("latin-1") + chr(raw[-1] + bpe_codec.FINAL)
    by_form = {codec.forms[t]: t for t in codec.forms}
    out = [by_form[s] for s in symbols]
    while True:
        found = [(codec.pairs[p], i) for i, p in enumerate(zip(out, out[1:])) if p in codec.pairs]
        if not found:
            return out
        _, i = min(found)
        out[i : i + 2] = [next(t for t in [by_form[codec.forms[out[i]] + codec.forms[out[i + 1]]]])]


def test_equals_the_library(codec, library):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(0, 0x7F), rnd.randint(0, 0x2FFF), rnd.randint(0xE000, 0x1FFFF)])) for _ in range(12)) for _ in range(2000)]
    texts += ["x" * 5000, "ab" * 4000, "aaaaab" * 1500, "the " * 9000]
    for text, got, want in zip(texts, codec.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids, ascii(text)
        assert codec.decode(got.tolist()) == library.decode(want.ids, skip_special_tokens=False)


def test_equals_merging_step_by_step(codec):
    rnd = random.Random(6)
    for _ in range(400):
        word = "".join(rnd.choices("aeinrstthéabab", k=rnd.randint(1, 14)))
        assert codec.encode_word(word) == by_merges(codec, word), word


def test_memory_stays_bounded(codec, library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe_codec, "CACHE_PAIRS", 7)
    rnd = random.Random(7)
    for _ in range(40):
        texts = [" ".join("".join(rnd.choices("abcde", k=3)) for _ in range(4)) for _ in range(3)]
        assert [g.tolist() for g in codec.encode_batch(texts)] == [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]
        assert len(codec.compatible) <= 8


def test_query_over_whole_documents(spark, library):
    rows = {r.doc_id: r for r in queries.QUERIES["op13_bpe_codec"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_round_trip_with_nulls_repeats_and_clashing_columns(spark, codec):
    rows = [(1, "The  Cat", "a", [9]), (1, "The  Cat", "a", [9]), (None, None, None, None), (2, "", "b", []), (3, "w " * 40_000, "c", [1]), (4, " \n", "d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    tokens = bpe_codec.bpe_encode(docs, queries.word_vocabulary())
    assert tokens.columns == ["doc_id", "decoded", "ids_in", "ids"]
    back = bpe_codec.bpe_decode(tokens, queries.word_vocabulary()).collect()
    assert sorted((r.decoded for r in back), key=len) == ["", "", "", "the</w> cat</w>", "the</w> cat</w>", " ".join(["w</w>"] * 40_000)]
    assert sorted(r.ids_in or [] for r in back) == [[], [], [], [1], [9], [9]]
    assert bpe_codec.bpe_digests(docs.limit(0), queries.word_vocabulary()).count() == 0
    found = bpe_codec.bpe_digests(docs, queries.word_vocabulary()).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sum(r.n_tokens == 0 and r.ids_sha256 == r.decoded_sha256 == empty for r in found) == 3 and len(found) == 6
    nulls = spark.createDataFrame([(None,), ([],), ([5, 70_000, -1],)], "ids array<int>")
    assert {r.decoded for r in bpe_codec.bpe_decode(nulls, queries.word_vocabulary()).collect()} == {None, "", codec.decode([5])}
