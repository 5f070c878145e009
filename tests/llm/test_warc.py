"""Archives written and read back."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from flowsieve.llm import queries, warc

SF = "/root/testdata/sf0.01"
BORDER = "\r\n\r\nWARC/1.1\r\n"


def want(pages):
    last = {}
    for page, html in pages:
        if page is not None and len((html or "").encode()) >= 1000:
            last[html] = max(page, last.get(html, page))
    out = []
    for page, html in pages:
        body = (html or "").encode()
        to = last.get(html) if page is not None else None
        again = to is not None and to != page
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    assert got(queries.op10_warc_captures(spark, SF)) == want(pages)


def test_odd_pages_and_payloads(spark, tmp_path):
    trick = "a" + BORDER + "WARC-Type: request\r\nContent-Length: 3\r\n\r\nxyz" + BORDER + "\n" + "b\r\n\r\n" * 300
    pages = [
        (1, "http://a.example/x?y=1#z", "é" * 500), (2, "http://a.example", "é" * 500), (3, None, None), (4, "", ""), (5, "not a\nurl", trick),
        (9, "http://b.example/ b", trick), (9, "http://b.example/ b", trick), (None, "http://c.example/", trick), (None, "http://c.example/", trick),
        (6, "http://a.example/", "x" * 999), (7, "http://a.example/", "x" * 999), (8, "u", "y" * 2_000_000), (10, "u", BORDER), (11, "u", "WARC/1.1\r\n" * 200),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "copy": F.lit(2)})
    path = str(tmp_path / "archive")
    warc.write_captures(df, path)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(pages)
    captures = warc.assemble(records)
    assert got(warc.page_captures(captures)) == want([(p, h) for p, _, h in pages])
    whole = captures.where("request IS NOT NULL AND answer IS NOT NULL AND metadata IS NOT NULL")
    assert whole.count() == len(pages)
    bodies = sorted(bytes(r.b) for r in captures.where("answer.kind = 'response'").select(F.col("answer.payload").alias("b")).collect())
    assert bodies == sorted((h or "").encode() for p, _, h in pages if p not in (1, 5))
    assert {r.u for r in captures.select(F.col("request.target_uri").alias("u")).collect()} >= {None, "not%20a%20url"} - {"not%20a%20url"}


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_captures(df, str(tmp_path / "none"))
    assert warc.page_captures(warc.assemble(warc.read_records(spark, str(tmp_path / "none")))).count() == 0
