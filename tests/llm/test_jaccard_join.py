"""N-gram Jaccard join against brute force."""

import random
import re
from fractions import Fraction

import pytest

from pelagia.llm import jaccard_join
from pelagia.llm.jaccard_join import drop_near_copies, jaccard_components

SCHEMA = "doc_id long, text string, part string, leaf string"


def brute(docs, n, threshold):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for doc, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        k = min(n, len(words))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * threshold.denominator >= threshold.numerator * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def corpus(seed, n=220):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "A", "b"]
    bases = [[rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 60, 150, 400]))] for _ in range(30)]
    docs = []
    for i in range(n):
        text = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            at = rnd.randrange(len(text) + 1)
            if rnd.random() < 0.4 and text:
                text[at % len(text)] = rnd.choice(words)
            elif rnd.random() < 0.5:
                text.insert(at, rnd.choice(words))
            elif len(text) > 1:
                text.pop(at % len(text))
        docs.append((i * 7 % 1009, rnd.choice([" ", "  ", "\n"]).join(text)))
    return docs + [(2000, None), (2001, ""), (2002, " \t\n")]


@pytest.mark.parametrize("seed,n,threshold,leaf", [(1, 4, Fraction(85, 100), 512), (2, 5, Fraction(4, 5), 512), (3, 4, Fraction(85, 100), 6), (4, 2, Fraction(4, 5), 5)])
def test_matches_brute_force(spark, monkeypatch, seed, n, threshold, leaf):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA).repartition(4)
    got = sorted((r.id, r.n_shingles, r.component) for r in jaccard_components(df, n, threshold).collect())
    assert got == brute(docs, n, threshold)


def test_one_document_of_each_class_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "p", "l"), (2, text + " end", "p", "l"), (3, "other words here", "p", "l"), (4, None, "p", "l"), (5, "", "p", "l"), (None, "alone at last", "p", "l")]
    kept = drop_near_copies(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "part", "leaf"]
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [1, 3, 4, 5, None]
    assert drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_vectors_bound_the_overlap_at_every_width():
    import numpy as np

    rnd = np.random.default_rng(3)
    base = rnd.integers(1, 1 << 62, 30_000).astype(np.uint64)
    sets = [np.unique(np.r_[base[: int(n * 0.7)], rnd.integers(1, 1 << 62, n - int(n * 0.7)).astype(np.uint64)]) for n in (5, 300, 1023, 1025, 1300, 4000, 4200, 17_000, 0)]
    sizes = np.array([len(s) for s in sets])
    text = np.repeat(np.arange(len(sets)), sizes)
    vectors = jaccard_join.short_vectors(text, np.concatenate(sets), sizes)
    assert [len(v) // 4 for v in vectors] == [64, 64, 64, 256, 256, 256, 1024, 4096, 64]
    held = jaccard_join.ShortVectors(vectors)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    true = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    bound = held.shared(i, j)
    assert (bound >= true).all() and (bound[i == j] == sizes).all()
    unlike = [np.unique(rnd.integers(1, 1 << 62, 3000).astype(np.uint64)) for _ in range(2)]
    pair = jaccard_join.ShortVectors(jaccard_join.short_vectors(np.repeat([0, 1], 3000), np.concatenate(unlike), np.array([3000, 3000])))
    assert pair.shared(np.array([0]), np.array([1]))[0] < 0.88 * 3000


def test_signing_takes_little_memory(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from pelagia.llm import byte_kernels

    monkeypatch.setattr(byte_kernels, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])

    class Docs:
        def mapInArrow(self, each, schema):
            return each

    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(300)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    tracemalloc.start()
    signed = {i for out in jaccard_join.signature_rows(Docs(), 5, Fraction(4, 5))(iter([batch])) for i in out.column(1).to_pylist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert signed == set(range(len(texts))) and peak < 30e6
