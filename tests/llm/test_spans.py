"""Suffix and sentence-span dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from pelagia.llm import sentence_spans, spans, suffix_dedup

SCHEMA = "doc_id long, text string, key string, start long"


def brute_bytes(docs, length):
    """Removed bytes per document id; docs is [(id, text)] without repeated ids."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = set(), {}
    for doc, text in order:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in seen:
                gone[i : i + length] = True
            seen.add(piece)
        out[doc] = (data, gone)
    return out


def expected(docs, length):
    rows = []
    for doc, (data, gone) in brute_bytes(docs, length).items():
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if len(data) else b""
        rows.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=repr)


def random_docs(seed, n=60, alphabet="abcé"):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choices(alphabet + " ", k=k))
    passages = [word(rnd.choice([20, 39, 40, 41, 60, 99, 100, 101, 130, 250])) for _ in range(12)]
    docs = []
    for i in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.6 else word(rnd.randint(0, 120)) for _ in range(rnd.randint(0, 6))]
        docs.append((i * 3, "".join(parts)))
    docs += [(1, None), (4, ""), (7, "a" * 450), (10, "ab" * 200), (None, docs[5][1]), (13, docs[8][1])]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup_matches_brute_force(spark, seed):
    docs = random_docs(seed)
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], SCHEMA).repartition(5)
    got = spans.digest_columns(suffix_dedup.suffix_dedup(df))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(docs, 100)


def test_suffix_dedup_small_alphabet_and_windows(spark):
    docs = [(i, t) for i, (_, t) in enumerate(random_docs(9, 80, "ab"))]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], SCHEMA).repartition(3)
    got = spans.digest_columns(suffix_dedup.suffix_dedup(df, length=30, anchor=12))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(docs, 30)


def test_suffix_order_sorts_and_survives_lying_hashes(monkeypatch):
    rng = np.random.default_rng(5)
    texts = rng.integers(97, 99, (400, 12), dtype=np.uint8)
    classes = np.sort(rng.integers(0, 7, 400))

    def check():
        order, shared = suffix_dedup.suffix_order(classes, texts)
        rows = [(classes[i], bytes(texts[i])) for i in order]
        assert rows == sorted(rows)
        for i in range(1, 400):
            a, b = rows[i - 1], rows[i]
            want = -1 if a[0] != b[0] else next((k for k in range(12) if a[1][k] != b[1][k]), 12)
            assert shared[i] == want

    check()
    monkeypatch.setattr(suffix_dedup, "common_extension", lambda h, a, b: np.minimum(3, np.zeros(len(a), np.int64) + 3))
    check()


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(4).choices("abcdef ", k=300))
    df = spark.createDataFrame([(1, text, "k", 1), (1, text, "k", 1), (2, text, "k", 1)], SCHEMA)
    got = sorted((r.doc_id, r.n_removed) for r in spans.digest_columns(suffix_dedup.suffix_dedup(df)).collect())
    assert got == [(1, 0), (1, 0), (2, 300)]
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert sentence_spans.sentence_dedup(empty).count() == 0


def brute_sentences(text, most=16):
    """[(words, start byte, end byte)] of the sentences of a text."""
    data = (text or "").encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    out, held = [], []
    for i, (a, b) in enumerate(words):
        held.append((a, b))
        gap = data[b : words[i + 1][0]] if i + 1 < len(words) else b""
        if data[b - 1 : b] in (b".", b"!", b"?") or b"\n" in gap or len(held) == most or i + 1 == len(words):
            out.append(held)
            held = []
    starts = [s[0][0] for s in out] + [len(data)]
    return [(tuple(data[a:b] for a, b in s), starts[i], starts[i + 1]) for i, s in enumerate(out)], data


def brute_runs(docs, run=3, least=8):
    seen, rows = {}, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        sentences, data = brute_sentences(text)
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(sentences) - run + 1):
            words = sum((s[0] for s in sentences[i : i + run]), ())
            if len(words) < least:
                continue
            if words in seen:
                gone[sentences[i][1] : sentences[i + run - 1][2]] = True
            seen[words] = 1
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if len(data) else b""
        rows.append((doc, len(data), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_sentence_spans_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    bag = [" ".join(rnd.choices(["la", "le", "ö", "x,", "un"], k=rnd.randint(1, 5))) + rnd.choice([".", "!", " ?", "\n", ".  "]) for _ in range(25)]
    long = [" ".join(f"w{rnd.randint(0, 99)}" for _ in range(70)) for _ in range(3)]
    docs = [(i, " ".join(rnd.choices(bag + long, k=rnd.randint(0, 12)))) for i in range(120)] + [(None, "a b. " * 9), (500, None), (501, "")]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], SCHEMA).repartition(4)
    got = [tuple(r) for r in spans.digest_columns(sentence_spans.sentence_dedup(df)).drop("n_spans").collect()]
    assert sorted(got, key=repr) == brute_runs(docs)


def test_passages_without_stops_are_caught(spark):
    rnd = random.Random(3)
    words = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    passage = words(55)
    df = spark.createDataFrame([(i, f"{words(20)}.\n{passage}\n{words(30)}.", "k", 1) for i in range(4)] + [(9, words(90), "k", 1)], SCHEMA)
    got = {r.doc_id: r.n_removed for r in spans.digest_columns(sentence_spans.sentence_dedup(df)).collect()}
    assert got[0] == got[9] == 0 and all(got[i] >= len(passage) for i in (1, 2, 3))


def test_passages_are_caught_at_any_offset(spark):
    rnd = random.Random(8)
    words = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    passage = words(70)
    stopped = [w + "." if i % 20 == 19 else w for i, w in enumerate(words(70))]
    rows = [(100 * k + i, " ".join([*words(3 + 5 * i), *p, *words(7)])) for k, p in enumerate((passage, stopped)) for i in range(9)]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], SCHEMA).repartition(3)
    got = {r.id: r for r in sentence_spans.sentence_dedup(df, by_content=True).collect()}
    for doc, text in rows:
        p = passage if doc < 100 else stopped
        left = [w for w in p if w in got[doc].kept.decode().split()]
        assert len(left) == 70 if doc % 100 == 0 else len(left) <= 32
        assert set(text.split()) - set(p) <= set(got[doc].kept.decode().split())


def test_lists_of_tiny_lines_are_caught_to_both_ends(spark):
    menu = "Home\nNews\nOur team\nMap\nJobs\nPress\nHelp\nSign in\nTerms\nRSS\n"
    rows = [(i, f"A first line that only document {i} has here{i}\n{menu}And a last one of number {i} alone{i}\n", "k", 1) for i in range(3)]
    rows.append((7, "Home\nNews\nMap\n", "k", 1))
    got = {r.id: r.kept.decode() for r in sentence_spans.sentence_dedup(spark.createDataFrame(rows, SCHEMA), by_content=True).collect()}
    assert menu in got[0] and got[7] == rows[3][1]
    assert all(got[i] == rows[i][1].replace(menu, "") for i in (1, 2))
