"""Dedup, search, tokens, mixing, rollups and scores against brute force and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.llm import exact_dedup, mixing, quality, sentencepiece_codec, shared, token_rollup, topk, toxicity
from pelagia.llm.labelled import logistic
from pelagia.llm.queries import piece_model

DOCS = "doc_id long, text string, source string, lang string, digest string, size long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "clash", 7) for i, t, s in rows], DOCS)


def test_word_count(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(["a", "é", " ", "\t", "\n", "\x0b", "\r", "  "], k=rnd.randint(0, 12))) for _ in range(400)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.n for r in df.select("id", shared.word_count(F.col("text")).alias("n")).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_groups(spark, fan_in):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a b", "ab ", "a\nb", "", " ", None, "é", "abc", "a  b"]), "s") for i in range(200)] + [(None, "ab", "s"), (3, "zz", "s"), (3, "zz", "s")]
    got = exact_dedup.exact_groups(docs(spark, rows).repartition(7), fan_in=fan_in).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    want = {hashlib.sha256(k.encode()).digest(): (min(v), len(v)) for k, v in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        best, size = want[bytes(r.digest)]
        assert (r.keep_id, r.group_size) == (None if best[1] else best[2], size)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_drop_exact_copies_keeps_columns_and_one_row(spark):
    rows = [(1, "a b", "x"), (2, "ab", "y"), (5, "q", "z"), (5, "q", "z"), (None, None, None), (9, "", "s")]
    kept = exact_dedup.drop_exact_copies(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "lang", "digest", "size"]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([(1, "a b"), (5, "q"), (9, "")], key=str)


def test_top_k_with_ties_gaps_and_bad_vectors(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(rnd.choice([4, 4, 6]))]) for i in range(90)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (204, []), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sparse = topk.sparse_rows(df, "vec_id", "embedding")
    got = sorted(map(tuple, topk.exact_top_k(sparse.filter("id % 10 = 0"), sparse, 5, query_block=3, block=16).collect()))
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and i not in (200, 201, 202, 203)}
    want = []
    for q in good:
        if q % 10 == 0:
            scored = sorted((-int(sum(a * b for a, b in zip(good[q], good[c]))), c) for c in good if c != q)[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    assert got == sorted(want)
    few = topk.sparse_rows(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert topk.exact_top_k(few, few, 5).count() == 2
    assert topk.exact_top_k(few.limit(0), few, 5).count() == 0


TEXTS = ["", " ", "a  b", "▁x", "\n\nab\t", "é😀\x00 x", "</s> <0x41>", "The, cat. sat!? on", "x" * 3000, " " * 50, "中文 。", "Ünd²a,b", None]


def test_codec_equals_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    codec = sentencepiece_codec.Codec(piece_model())
    rnd = random.Random(4)
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choices(["a", "th", " ", "\n", "▁", "é", "!", ", ", "。", "\x00", "q.com"], k=rnd.randint(0, 30))) for _ in range(500)]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids)
        assert codec.written(codec.encode_batch([text])[0]) == " ".join(map(str, ids))
    for _ in range(500):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(259)]) for _ in range(rnd.randint(0, 9))]
        assert codec.decode(ids) == library.decode(ids)


def test_codec_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHE_SEGMENTS", 5)
    codec = sentencepiece_codec.Codec(piece_model())
    for text in ["one two three four", "five six seven", "one two eight nine ten", "one five"] * 3:
        assert codec.encode(text) == codec.library.encode(text, add_eos=True)


def test_encode_round_trip(spark):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(TEXTS)]).withColumn("ids", F.lit("clash"))
    tokens = sentencepiece_codec.encode_texts(df, piece_model())
    assert "ids_in" in tokens.columns
    back = sentencepiece_codec.decode_ids(tokens, piece_model(), out="again").collect()
    assert {r.doc_id: r.again for r in back} == {r.doc_id: r.decoded for r in back} == {i: (t or "").replace("▁", " ") for i, t in enumerate(TEXTS)}
    rows = sentencepiece_codec.encode_digests(df, piece_model()).collect()
    assert {r.id: r.n_tokens for r in rows} == {r.doc_id: len(r.ids) for r in back}
    assert sentencepiece_codec.encode_texts(docs(spark, []), piece_model()).count() == 0


def water_level(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, out, left = set(order), {}, sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mix_targets_and_limits(spark):
    rnd = random.Random(5)
    source = lambda: rnd.choice(["a", "a", "a", "a", "b", "c", "Z", None, "é"])
    rows = [(i, " ".join("w" * rnd.randint(0, 60)), source()) for i in range(600)] + [(1000, None, "a"), (1001, "", "void"), (1002, "one two", "tiny")]
    df = docs(spark, rows).repartition(3)
    plan = mixing.mix_plan(df, block_words=512, shard_blocks=4).collect()
    again = mixing.mix_plan(df.repartition(5), block_words=512, shard_blocks=4).collect()
    key = lambda r: r.id
    assert sorted(plan, key=key) == sorted(again, key=key)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = water_level(sizes), dict.fromkeys(sizes, 0)
    for r in plan:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and len(r.shards) <= 3
        taken[r.source] += r.size * len(r.shards)
    for s in sizes:
        assert want[s] - 60 <= taken[s] <= want[s] + 1e-6
    shards = [x for r in plan for x in r.shards]
    assert len(set(shards)) > 4 and min(shards) >= 0
    assert mixing.mix_plan(docs(spark, [])).count() == 0


def test_a_long_document_does_not_end_the_fill(spark):
    rows = [(i, "w " * 100, "a") for i in range(400)] + [(400, "w " * 20000, "a")] + [(500 + i, "w " * 100, "b") for i in range(600)]
    for seed in (1, 2, 3, 4):
        plan = mixing.mix_plan(docs(spark, rows), weights=(1, 2), seed=seed, block_words=512, shard_blocks=8).collect()
        taken = sum(r.size * len(r.shards) for r in plan if r.source == "a")
        assert len(plan) == len(rows) and 40000 - 100 <= taken <= 40000


def test_mix_rows(spark):
    rows = [(i, f"word{i} b c", "a" if i % 3 else "b") for i in range(60)]
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "lang", "digest", "size", "shard"]
    plan = mixing.mix_plan(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.id for r in plan for _ in r.shards)


def test_mix_rows_with_null_and_repeated_ids(spark):
    rnd = random.Random(8)
    text = lambda: "w " * rnd.randint(0, 40)
    rows = [(i, text(), rnd.choice("aab")) for i in range(60)] + [(None, "p q", "a"), (None, "r", "b"), (7, "one two three", "b"), (7, "x y", "a"), (7, "x y", "a"), (None, None, None)]
    df = spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], "doc_id long, text string, source string, shard string")
    for seed in (1, 2, 3):
        plan = mixing.mix_plan(df, seed=seed, block_words=64, shard_blocks=4).collect()
        mixed = mixing.mix(df, seed=seed, block_words=64, shard_blocks=4)
        count = {}
        for r in mixed.toDF("doc_id", "text", "source", "own", "shard").collect():
            key = (r.doc_id, r.source, len((r.text or "").split()))
            count[key] = count.get(key, 0) + 1
            assert r.own == "clash"
        want = {}
        for r in plan:
            if r.shards:
                want[r.id, r.source, r.size] = want.get((r.id, r.source, r.size), 0) + len(r.shards)
        assert count == want


def test_splitting_tree_keeps_quotas(spark):
    quotas = [0, 1, 7, 300, 41]
    root = spark.createDataFrame([(0, quotas)], "node long, quotas array<long>")
    leaves = mixing.split_quotas(root, 3, 1).collect()
    assert len(leaves) == 8 and [sum(c) for c in zip(*(r.quotas for r in leaves))] == quotas
    assert max(sum(r.quotas) for r in leaves) - min(sum(r.quotas) for r in leaves) <= 1
    assert all(q >= 0 for r in leaves for q in r.quotas)


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rows = [(i, "a b, c" * (i % 4), "s" if i % 3 else None) for i in range(50)]
    counts = token_rollup.counted(docs(spark, rows))
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    insert = token_rollup.change(counts, "insert")
    assert rollup.commit(0, insert) and not rollup.commit(0, insert)
    gone = token_rollup.change(counts.filter("id < 10"), "delete")
    more = token_rollup.change(counts.filter("id >= 40").withColumn("tokens", F.col("tokens") + 5), "revise", F.col("tokens") - 5)
    rollup.commit(1, gone)
    (tmp_path / "r" / "batch-2").mkdir()  # a job that was lost before its end
    before = sorted(map(tuple, rollup.totals().collect()), key=str)
    assert rollup.commit(2, more) and not rollup.commit(2, more)
    want = counts.filter("id >= 10").withColumn("tokens", F.col("tokens") + F.when(F.col("id") >= 40, 5).otherwise(0)).groupBy("source", "lang", "tokenizer").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    total = lambda: sorted(map(tuple, rollup.totals().collect()), key=str)
    assert total() == sorted(map(tuple, want.collect()), key=str) != before
    rollup.fold(1)
    rollup.fold(1)
    assert total() == sorted(map(tuple, want.collect()), key=str) and not rollup.commit(1, gone)
    assert rollup.commit(3, insert.limit(0)) and total() == sorted(map(tuple, want.collect()), key=str)
    with pytest.raises(ValueError):
        token_rollup.change(counts, "replace")


def test_grammar_reads_clauses():
    lexicon = toxicity.Lexicon({"zork": 6.0})
    feature = lambda text: {k for k, v in zip(toxicity.FEATURES, lexicon.features(text)) if v} - {"clauses", "aimed", "plain", "softened"}
    assert feature("you are an idiot") == {"insult_at"}
    assert feature("you are not an idiot.") == {"insult_negated"}
    assert feature("he said the idiot left") == {"insult_reported"}
    assert feature("an idiot, you know") == {"insult"}
    assert feature("I will kill you") == {"threat_at"}
    assert feature("I will kill time") == set()
    assert feature("I will never hurt you") == {"threat_negated"}
    assert feature("a zorkling walks") == {"insult"}
    assert feature("") == feature(None) == feature("clean words only") == set()


def test_strength_goes_by_what_the_grammar_puts_out():
    lexicon = toxicity.Lexicon({"zork": 6.0})
    rows = [lexicon.features(t) for t in ("you are a zorkling", "you are not a zorkling", "he said you are a zorkling", "the zorkling sleeps")]
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert [r[at["aimed"]] > 0 for r in rows] == [True, False, False, False]
    assert [r[at["softened"]] > 0 for r in rows] == [False, True, True, False]
    assert rows[3][at["plain"]] > rows[1][at["softened"]] > 0 and rows[0][at["aimed"]] > rows[3][at["plain"]]
    z = [toxicity.PRIOR[0] + sum(w * v for w, v in zip(toxicity.PRIOR[1:], r)) for r in rows]
    assert z[0] > z[3] > max(z[1], z[2])


def test_composed_machine_equals_its_parts_in_turn():
    rnd = random.Random(9)
    kinds = [*toxicity.KINDS, "word"]
    for _ in range(2000):
        symbols = [rnd.choice(kinds) for _ in range(rnd.randint(0, 12))]
        out, weight = symbols, [1.0] * len(symbols)
        for machine in (toxicity.negation_machine(), toxicity.report_machine(), toxicity.target_machine()):
            step = machine.run(out)
            out, weight = [o for o, _ in step], [a * b for a, (_, b) in zip(weight, step)]
        assert toxicity.grammar().run(symbols) == list(zip(out, weight))


def test_spelling_machines_equal_a_look_up():
    stems = {"zork": 6.0, "abc": 4.0, "abcd": 5.0, "idio": 3.0}
    lexicon = toxicity.Lexicon(stems)
    rnd = random.Random(10)
    words = [*toxicity.INSULTS, *toxicity.THREATS, *toxicity.TARGETS, *toxicity.REPORTS, "zork", "zorks", "zor", "abx", "abcdz", "idiots", "kills", "yo", "é"]
    words += ["".join(rnd.choices("abczorkid", k=rnd.randint(1, 6))) for _ in range(500)]
    for word in words:
        stem = min((s for s in stems if word.startswith(s)), key=len, default=None)
        kind = next((k for k in ("insult", "threat", "report", "negation", "target") if word in toxicity.KINDS[k]), "word")
        want = ("insult", stems[stem]) if stem else (kind, toxicity.SEED_WEIGHT if kind in ("insult", "threat") else 0.0)
        assert lexicon.read(word) == want, word


def test_drop_toxic_by_id(spark):
    rows = [(1, "you are a brakka idiot", "s"), (1, "clean words", "s"), (2, "clean words", "s"), (2, "clean words", "s"), (None, "you idiot", "s"), (3, None, "s"), (4, "", "s")]
    kept = toxicity.drop_toxic(docs(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect() if r.text) == [(-1, "you idiot"), (2, "clean words"), (2, "clean words")]
    assert kept.count() == 5 and toxicity.drop_toxic(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def labelled(spark, make, n=400):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        y = int(rnd.random() < 0.4)
        rows.append((i, make(rnd, y), "s"))
        labels.append((i, y))
    return docs(spark, [*rows, (n, None, "s"), (n + 1, "", "s"), (None, "some words", None)]), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, y int")


def test_toxicity_learns_new_stems(spark):
    def make(rnd, y):
        words = [f"w{rnd.choice('aeiou')}{rnd.choice('bcdfg')}" for _ in range(20)]
        if y:
            words.insert(rnd.randrange(20), f"brakk{rnd.choice('abcdefgh')}")
        return " ".join(words)

    df, labels = labelled(spark, make)
    got = {r.id: r for r in toxicity.toxicity_scores(df, labels, label="y").collect()}
    truth = {r.doc_id: r.y for r in labels.collect() if r.y is not None}
    held = [i for i in truth if i is not None and got[i].held_out]
    assert len(held) > 50 and sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert got[400].predicted == got[401].predicted == got[None].predicted == 0 and not got[None].held_out
    bare = toxicity.toxicity_scores(df.limit(5), labels.limit(0), label="y").collect()
    assert len(bare) == 5 and all(0 <= r.score <= 1 for r in bare)
    assert toxicity.toxicity_scores(docs(spark, []), labels, label="y").count() == 0


def test_quality_rules(spark):
    def make(rnd, y):
        words = [f"word{rnd.randint(0, 300)}" for _ in range(rnd.randint(10, 40))]
        return " ".join(words) + "." if y else " ".join(w.upper() + "!!" for w in words) if rnd.random() < 0.5 else " ".join(w for w in words for _ in range(5))

    df, labels = labelled(spark, make)
    got = {r.id: r for r in quality.quality_scores(df, labels, label="y").collect()}
    truth = {r.doc_id: r.y for r in labels.collect() if r.y is not None}
    held = [i for i in truth if i is not None and got[i].held_out]
    assert len(held) > 40 and sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 403
    assert {r.score for r in quality.quality_scores(df.limit(3), labels.limit(0), label="y").collect()} == {0.5}


def test_quality_with_repeated_ids_and_an_empty_table(spark):
    good, bad = "Some words stand here in a plain row.", "BUY!!! BUY!!! BUY!!! NOW!!!"
    rows = [(i, (good if i % 2 else bad) + f" {i} {n}", "s") for i in range(300) for n in range(5)] + [(None, None, None), (400, "", "s"), (401, "word " * 200_000, "s")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, y int")
    got = quality.quality_scores(docs(spark, rows), labels, label="y", sample=100).collect()
    assert len(got) == len(rows) and all(r.predicted == r.id % 2 for r in got if r.id is not None and r.id < 300)
    assert quality.quality_scores(docs(spark, []), labels, label="y").count() == 0


def test_compiled_rules_score_as_the_rules_themselves(spark):
    def make(rnd, y):
        return " ".join(f"word{rnd.randint(0, 30 if y else 300)}" for _ in range(rnd.randint(5, 40)))

    df, labels = labelled(spark, make)
    got = quality.quality_scores(df, labels, label="y").collect()
    keep = {r.doc_id: r.y for r in labels.collect() if r.y is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = sorted((keep[r.id], *[r[n] for n in quality.STATISTICS]) for r in got if r.id in keep)
    table = np.array(rows, dtype=float)
    intercept, rules = quality.fit_rules(table[:, 1:], table[:, 0], np.ones(len(table)), quality.STATISTICS)
    for r in got:
        z = intercept + sum(w for w, rule in rules if all(low < r[name] <= high for name, low, high in rule.bounds))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_lasso_drops_useless_rules():
    rng = np.random.default_rng(1)
    m = rng.integers(0, 2, (2000, 12)).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(3 * m[:, 0] - 1.5)))).astype(float)
    intercept, weights = quality.lasso_logistic(m, y, 0.03)
    assert weights[0] > 1 and (weights[1:] == 0).sum() >= 9


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_small_samples_keep_the_share_of_the_labels(spark, scores):
    rnd = random.Random(12)
    rows = [(i, " ".join(f"word{rnd.randint(0, 50)}" for _ in range(rnd.randint(10, 40))), "s") for i in range(5000)]
    for share in (0.9, 0.1):
        labels = spark.createDataFrame([(i, int(rnd.random() < share)) for i in range(5000)], "doc_id long, y int")
        got = [r.score for r in scores(docs(spark, rows), labels, label="y", sample=300).collect()]
        assert abs(np.mean(got) - share) < 0.1


def test_a_weighted_row_counts_as_so_many_rows():
    rng = np.random.default_rng(2)
    x, y, times = rng.random((300, 3)), rng.integers(0, 2, 300), rng.integers(1, 5, 300)
    many = (np.repeat(x, times, axis=0), np.repeat(y, times))
    assert np.allclose(logistic(x, y, stands_for=times), logistic(*many))
    a, b = quality.lasso_logistic(x, y, 0.01, times=times), quality.lasso_logistic(*many, 0.01)
    assert np.isclose(a[0], b[0]) and np.allclose(a[1], b[1])
