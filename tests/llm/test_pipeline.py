"""The pipeline's stages on the smallest table, each held against a brute-force version of its decision."""

import hashlib
import re
import weakref
from fractions import Fraction

import pyarrow as pa
import pytest

import corpus_pipeline
from pelagia.llm import mixing, sentencepiece_codec, shared, toxicity
from pelagia.llm.queries import piece_model
from test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["start"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "sentencepiece"]
    for name in ("toxicity", "exact_dedup", "jaccard_join", "mixing"):
        assert stages[name].columns == stages["start"].columns


def test_toxic_documents_go(spark, stages):
    scores = toxicity.toxicity_scores(stages["start"], spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(texts(stages["toxicity"])) == {r.id for r in scores.filter("predicted = 0").collect()}


def test_one_of_equal_texts_stays(stages):
    groups = {}
    for doc, text in texts(stages["toxicity"]).items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc))
    assert set(texts(stages["exact_dedup"])) == {min(g)[1] for g in groups.values()}


def test_one_of_near_copies_stays(stages):
    found = brute(list(texts(stages["exact_dedup"]).items()), 5, Fraction(4, 5))
    assert set(texts(stages["jaccard_join"])) == {doc for doc, size, component in found if not size or doc == component}


def test_mix_takes_the_planned_copies(stages):
    plan = mixing.mix_plan(stages["jaccard_join"]).collect()
    want = sorted(r.id for r in plan for _ in r.shards)
    assert sorted(r.doc_id for r in stages["mixing"].collect()) == want


def test_ids_are_the_library_s(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    by_id = texts(stages["mixing"])
    rows = stages["sentencepiece"].collect()
    assert len(rows) == stages["mixing"].count()
    for r in rows:
        ids = library.encode(by_id[r.doc_id] or "", add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_stages_with_nulls_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, long, "en", "a", 1, "x", [1], "y"), (2, long + " more", "en", "a", 2, None, None, None), (None, None, None, None, None, None, None, None), (3, "", "en", "b", 0, "x", [], "y")]
    rows += [(4, "one two three four five six", "en", "b", 27, "x", [2], "z")] * 2 + [(None, "q r s", "de", None, 5, "x", [2], "z"), (5, " \n ", "en", "c", 3, "x", [2], "z")]
    rows += [(10 + i, " ".join(f"w{i}x{j}" for j in range(20)), "en", "abc"[i % 3], 100, "x", [3], "z") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, ids array<int>, decoded string")
    for start in (df, df.limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns or name == "sentencepiece"
            out.write.parquet(f"{tmp_path}/{start is df}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{start is df}-{name}")
            if name == "jaccard_join" and start is df:
                kept = {r.doc_id for r in docs.collect()}
                assert 1 in kept and 2 not in kept and 4 in kept and set(range(10, 40)) <= kept
        assert (docs.count() > 20) == (start is df)


def test_a_task_gives_memory_back_after_its_own_arrays_are_gone():
    class Held:
        pass

    seen, alive = [], []

    def each(batches):
        for batch in batches:
            held = Held()
            seen.append(weakref.ref(held))
            yield batch

    run = shared.giving_back(each, lambda: alive.append([r() is not None for r in seen]))
    assert list(run(iter([1, 2]))) == [1, 2] and alive == [[False, False]]
    assert [len(p) for p in sentencepiece_codec.pieces(pa.array(["x" * 300_000] * 5))] == [2, 2, 1]


def test_the_pipeline_sends_small_batches_and_every_row(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, docs = spark.conf.get(key), spark.range(0, 3_000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000 + id) AS text")

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    try:
        for name in ("toxicity", "jaccard_join", "sentencepiece"):
            spark.conf.unset(key)
            start = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
            dict(corpus_pipeline.STAGES)[name](spark, start, SF)
            n, most = docs.mapInArrow(each, "n long, bytes long").selectExpr("sum(n)", "max(bytes)").first()
            assert n == 3_000 and most < 1.1 * shared.BATCH_BYTES, name
        for lower, after in (("100k", "100k"), ("64m", str(shared.BATCH_BYTES))):
            spark.conf.set(key, lower)
            shared.small_batches(spark)
            assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, before)


def test_an_encoding_task_keeps_few_segments_and_leaves_no_vocabulary(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(sentencepiece_codec, "run", lambda *a: taken.extend(a))
    sentencepiece_codec.encode_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), piece_model(), remembered=5)
    work, done = taken[-2:]
    model = sentencepiece_codec.codec(piece_model(), 5)
    for text in ["one two three four five six", "seven eight nine", "one two ten", "six eleven"] * 2:
        assert work([text])["ids"][0].as_py() == model.library.encode(text, add_eos=True)
        assert len(model.memory) + len(model.old) <= 20
    done()
    assert sentencepiece_codec.codec.cache_info().currsize == 0
