from pelagia.operators.hits import best_hit_per_target
from pelagia.streaming.incremental import fold_batches, latest

SCHEMA = "query string, target string, evalue double, bits double, pident double, qcov double, tcov double"


def test_batches_equal_one_pass(spark, frame, tmp_path):
    rows = [(f"q{i % 5}", f"t{i % 7}", (i * 13 % 11) / 10, float(i * 7 % 31), 50.0, 0.9, 0.9) for i in range(120)]
    landed = str(tmp_path / "hits")
    for n in range(3):
        frame(rows[n::3], SCHEMA).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(landed)
    fold_batches(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {r["target"]: (r["query"], r["evalue"], r["bits"]) for r in latest(spark, str(tmp_path / "table")).collect()}
    whole = best_hit_per_target(frame(rows, SCHEMA))
    assert got == {r["target_id"]: (r["best_query"], r["evalue"], r["bits"]) for r in whole.collect()}
