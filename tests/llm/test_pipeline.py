from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import awkward, prose
from tickloom.llm import decontam, near_dedup, packing, repetition, secrets


def test_stages_and_run(spark, tmp_path):
    import random

    rng = random.Random(8)
    rows = [*awkward(), (50, prose(rng, 40) + " token=abcdef123456"), (51, prose(rng, 30) + " the benchmark item has more than ten words in all of it " + prose(rng, 3))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "the benchmark item has more than ten words in all of it")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step = docs
    kept = {r["doc_id"] for r in repetition.repetition(docs).where("kept").collect()}
    for name, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
    left = {r["doc_id"]: r for r in step.collect()}
    chosen = {r["doc_id"] for r in near_dedup.near_duplicates(docs.where(F.col("doc_id").isin(*[k for k in kept if k is not None]) | F.col("doc_id").isNull())).where("kept").collect()}
    clean = {r["doc_id"] for r in decontam.contamination(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).where("n_hit = 0").collect()}
    assert set(left) == (kept & chosen & clean) - {None} and 51 not in left and left[50]["text"].endswith(" [SECRET]") and left[50]["n_chars"] == len(left[50]["text"])
    assert secrets.redact(docs.where("doc_id = 5")).first()["text"] == dict(rows)[5]
    got = corpus_pipeline.run(spark, str(tmp_path))
    want = packing.pack_documents(step)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
