"""Toxicity features, odd rows and held-out accuracy."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from flowsieve.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op7_toxicity_trees(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = sorted((r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels)
    toxic = [s for s, t in held if t]
    clean = [s for s, t in held if not t]
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean)
    assert wins / (len(toxic) * len(clean)) > 0.96
    assert sum(s >= 0.5 for s in toxic) > 0.8 * len(toxic) and sum(s >= 0.5 for s in clean) < 0.02 * len(clean)


def test_plain_forms():
    assert toxicity.plain_form('"Idiot!!"') == ("idiot", False)
    assert toxicity.plain_form("1d10t") == ("1d10t", False)  # more digits than letters stay as they are
    assert toxicity.plain_form("idi0t") == ("idiot", True)
    assert toxicity.plain_form("$tupid") == ("tupid", False) or toxicity.plain_form("$tupid")[0] in ("stupid", "tupid")
    assert toxicity.plain_form("st.up.id") == ("stupid", True)
    assert toxicity.plain_form("2024") == ("2024", False)


def test_odd_rows(spark):
    text = "you are an idiot and a worthless clown " * 3
    docs = [(i, text if i % 2 else "the sun is warm and the sea is calm today") for i in range(200)]
    docs += [(None, None), (500, ""), (501, None), (502, "z" * 400_000), (503, "a b " * 100_000), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit("x"), "label": F.lit(1), "toxic": F.lit(0)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 150)] + [(None, 1), (3, 0), (4, None)], "doc_id long, toxic int")
    rows = toxicity.score_documents(df, labels).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 200)
    none = toxicity.score_documents(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score_documents(df.limit(0), labels).count() == 0
