"""The pipeline: every stage on what the one before it kept."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from flowsieve.llm import decontaminate, minhash, toxicity
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "benchmark_decontamination", "best_fit_packing"]

    clean = stages["toxicity"](spark, docs, SF).cache()
    bad = {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 1").collect()}
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad

    single = stages["near_duplicates"](spark, clean, SF).cache()
    groups = brute([(r.doc_id, r.text) for r in clean.collect()], 5)
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, (_, c) in groups.items() if c == d)

    fresh = stages["benchmark_decontamination"](spark, single, SF).cache()
    found = {r.doc_id for r in decontaminate.find_contamination(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert fresh.columns == columns
    assert {r.doc_id for r in fresh.collect()} == {r.doc_id for r in single.collect()} - found

    packed = stages["best_fit_packing"](spark, fresh, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in fresh.collect()}


def test_odd_rows_pass_the_filters(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (None, "a b", "en", "s", 3), (1, None, None, None, None), (2, "", "en", "s", 0),
            (5, "one two three four five six", "en", "s", 1), (5, "one two three four five six", "en", "s", 1), (6, "one two three four five six", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "None", "None"]
    assert corpus_pipeline.benchmark_decontamination(spark, docs, SF).count() == len(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_are_judged_by_their_own_text(spark):
    """Two rows of one id, and rows without an id: only the toxic one, or the one with an item, goes."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = "a quiet note on rivers and hills"
    rows = [(1, clean, "en", "s", 1), (1, f"start {item} end", "en", "s", 1), (None, item, "en", "s", 1), (None, clean, "en", "s", 1), (2, clean, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], f"{SCHEMA}, row_key int")
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, SF)
    assert sorted((str(r.doc_id), r.text, r.row_key) for r in kept.collect()) == [("1", clean, 7), ("2", clean, 7), ("None", clean, 7)]

    larger = SF.replace("0.001", "0.01")
    table = spark.read.parquet(f"{larger}/documents.parquet")
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    scored = toxicity.score_documents(table, labels).where("held_out").orderBy("score", "doc_id").collect()
    texts = {r.doc_id: r.text for r in table.collect()}
    # held out, so that the rows below do not change the model
    good, bad = scored[0].doc_id, scored[-1].doc_id
    more = spark.createDataFrame([(good, texts[bad], "en", "s", 1), (None, texts[bad], "en", "s", 1), (None, texts[good], "en", "s", 1), (None, None, None, None, None)], SCHEMA)
    both = table.unionByName(more).withColumns({"row": F.lit(1), "features": F.lit("x"), "margin": F.lit(2.0), "score": F.lit(None).cast("double")})
    left = corpus_pipeline.toxicity_filter(spark, both, larger)
    model = {r.doc_id for r in left.where("doc_id IS NOT NULL").collect()}
    assert left.columns == both.columns and good in model
    assert not left.where((F.col("doc_id").isNull() | (F.col("doc_id") == good)) & (F.col("text") == texts[bad])).count()
    assert {r.text for r in left.where("doc_id IS NULL").collect()} == {texts[good], None}


def test_filtering_equals_scoring(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 0").collect()} and len(kept) < docs.count()
    assert toxicity.keep_clean(docs, labels.where("toxic = 0")).count() == docs.count()
    assert toxicity.keep_clean(docs, labels.where("toxic = 1")).count() == 0


def test_empty_table(spark, tmp_path):
    import os

    for name in ("labels", "benchmark"):
        os.symlink(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
