"""Runs against trying every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pelagia.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    out, n = set(), len(words)
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(6, 4 * q) and not any(q % d == 0 and words[start : end - d] == words[start + d : end] for d in range(1, q)):
                out.add((start, end - start, q))
            start = max(start + 1, end - q + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
    return (doc_id, len(runs), *four, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def longest_lyndon(s):
    n, out = len(s), []
    for i in range(n):
        # the next smaller suffix ends the longest Lyndon word
        out.append(next((j for j in range(i + 1, n) if s[j:] < s[i:]), n) - i)
    return out


def test_lyndon_lengths():
    rnd = random.Random(1)
    for _ in range(3000):
        s = [rnd.randint(0, rnd.choice([1, 2, 4])) for _ in range(rnd.randint(1, 24))]
        assert periodic_runs.lyndon_lengths(s) == longest_lyndon(s), s
    s = [0, 1] * 300 + [0, 0, 1] * 200 + [5] * 100
    assert periodic_runs.lyndon_lengths(s) == longest_lyndon(s)


def periodic_words(rnd):
    out = []
    for _ in range(rnd.randint(1, 4)):
        base = [rnd.choice("abcd") for _ in range(rnd.randint(1, 6))]
        out += base * rnd.randint(1, 8) + [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 4))]
    return out * rnd.choice([1, 1, 5])


def test_runs_of_many_texts_at_once():
    rnd = random.Random(2)
    texts = [periodic_words(rnd) for _ in range(400)] + [[], ["a"], ["a"] * 5, ["a"] * 6, list("aabaabaabaab"), ["x"] * 3000]
    counts, runs, left = periodic_runs.work([" ".join(t) for t in texts], [None] * len(texts))
    for words, n, found, kept in zip(texts, counts, runs, left):
        want = brute_runs(words)
        assert n == len(words) and [tuple(r.values()) for r in found] == want
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert kept == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_a_wrong_hash_is_noticed(monkeypatch):
    rnd = random.Random(3)
    texts = [periodic_words(rnd) for _ in range(60)]
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x & np.uint64(1))  # most words share a hash
    _, runs, _ = periodic_runs.work([" ".join(t) for t in texts], [None] * len(texts))
    assert [[tuple(r.values()) for r in found] for found in runs] == [brute_runs(t) for t in texts]


def test_query_equals_brute_force(spark):
    rows = queries.QUERIES["op11_periodic_runs"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    long = [d for d in docs if len(d.text or "") > 20_000]
    got = {r.doc_id: tuple(r) for r in rows}
    assert len(rows) == len(docs)
    for d in docs:
        if d not in long:
            assert got[d.doc_id] == brute(d.doc_id, d.text)


@pytest.mark.parametrize("seeded", [True, False])
def test_nulls_repeats_clashes_and_long_texts(spark, seeded):
    long = "p q r " * 30_000 + "end"
    rows = [(7, "a b " * 9, "x"), (7, "a b " * 9, "x"), (None, "z\x0bz\tz z\nz z z", "y"), (8, None, "y"), (9, "", None), (10, long, "q"), (11, "a\x1cb a\x1cb", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    from pyspark.sql import functions as F

    found = periodic_runs.periodic_runs(docs, F.crc32(F.col("doc_id").cast("string")) if seeded else None)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.id, []).append(([tuple(x) for x in r.runs], r.collapsed))
    assert by_id[None] == [([(0, 7, 1)], "z")]
    assert by_id[8] == by_id[9] == [([], "")]
    assert len(by_id[7]) == 2 and by_id[7][0] == by_id[7][1]
    if not seeded:
        assert by_id[7][0] == ([(0, 18, 2)], "a b") and by_id[10] == [([(0, 90_000, 3)], "p q r end")]
        assert by_id[11] == [([], "a\x1cb a\x1cb")]
    digests = periodic_runs.run_digests(found).collect()
    assert all(r.runs_sha256 and r.collapsed_sha256 for r in digests)
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(docs.limit(0))).count() == 0
