"""WARC archives of pages, and captures assembled from their records.

A capture is three records: the request, the response (or a revisit, when the payload is that of
another page) and metadata. Request and metadata name the response or revisit they belong to in
WARC-Concurrent-To; the reader joins them again through it.

Archives are written as text whose lines are captures: a capture's last line feed is the line
separator of the writer. They are read record by record, so a task holds one record at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the format.
VERSION = "WARC/1.1\r\n"
BETWEEN = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_REVISIT_BYTES = 1000
CAPTURES_PER_FILE = 20_000
_RECORDS = (
    "record_id string, kind string, concurrent_to string, refers_to string, target_uri string, date string,"
    " payload_bytes long, payload_digest string, fields array<struct<name: string, value: string>>, payload binary"
)


def _record_id(kind: str, page: Column, copy: Column) -> Column:
    code = F.md5(F.concat_ws(":", F.lit(kind), page.cast("string"), copy.cast("string")))
    parts = [F.substring(code, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], body: Column, end: str = BETWEEN) -> Column:
    """A record; headers whose value is null are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in headers]
    length = F.octet_length(body).cast("string")
    return F.concat(F.lit(VERSION), *lines, F.lit("Content-Length: "), length, F.lit("\r\n\r\n"), body, F.lit(end))


def _revisits(pages: DataFrame) -> DataFrame:
    """(page_id, refers_to) of pages whose payload a page with a larger id has."""
    light = pages.where(F.octet_length("html") >= LEAST_REVISIT_BYTES).select("page_id", F.sha1("html").alias("digest"))
    last = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first"))
    shared = last.where("first < refers_to").select("digest", "refers_to")
    return light.join(shared, "digest").where("page_id < refers_to").select("page_id", "refers_to", "digest").distinct()


def write_captures(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write request, response or revisit, and metadata of every page as gzipped WARC files.

    `pages` has page_id, url and html; other columns play no part. The payload is the html as
    UTF-8, and a null is empty. Of pages with equal payloads of at least LEAST_REVISIT_BYTES the
    one with the largest id is the response and the others revisit it. A page without an id is a
    response. Rows that repeat an id are captures of their own. Line breaks and blanks in a url
    are written as %20; without a url the records have no target.
    """
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # the one shuffle of payloads: the join below has the same keys
    digested = pages.withColumn("digest", F.sha1("html"))
    copies = Window.partitionBy("page_id", "digest").orderBy("url")
    numbered = digested.withColumn("copy", F.row_number().over(copies))
    roles = numbered.join(_revisits(pages), ["page_id", "digest"], "left")
    page, copy = F.col("page_id"), F.col("copy")
    own = F.concat_ws(":", page.cast("string"), "digest")
    main = _record_id("capture", own, copy)
    uri = F.regexp_replace("url", r"\s", "%20")
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri)]
    payload_bytes = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), payload_bytes, F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    host = F.coalesce(F.regexp_extract(uri, r"^[a-z]+://([^/?#]+)", 1), F.lit(""))
    target = F.when(F.length(F.regexp_extract(uri, r"^[a-z]+://[^/?#]+(/[^#]*)", 1)) > 0,
                    F.regexp_extract(uri, r"^[a-z]+://[^/?#]+(/[^#]*)", 1)).otherwise(F.lit("/"))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id("request", own, copy)), *common,
         ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    answer = _record(
        [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", main), *common,
         ("WARC-Profile", F.when(revisit, PROFILE)),
         ("WARC-Refers-To", F.when(revisit, _record_id("capture", F.concat_ws(":", F.col("refers_to").cast("string"), "digest"), F.lit(1)))),
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))))
    # the writer's line separator is the last line feed
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id("metadata", own, copy)), *common,
         ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("page-id: "), page.cast("string"), F.lit("\r\n")), F.lit("")), end=BETWEEN[:-1])
    lines = roles.select(F.concat(request, answer, metadata).alias("value"))
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path)


def _headers(block: bytes) -> list[tuple[str, str]]:
    lines = [line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line]
    return [(name.strip(), value.strip()) for name, _, value in lines]


def _parsed(pieces: Iterator[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of every record, from what lies between record borders.

    A block may itself hold what looks like a border; Content-Length then says that it goes on.
    """
    border = (BETWEEN + VERSION).encode()
    for piece in pieces:
        head, _, block = piece.removeprefix(VERSION.encode()).partition(b"\r\n\r\n")
        headers = _headers(head)
        length = int(next((v for n, v in headers if n.lower() == "content-length"), 0))
        if len(block) < length:
            parts, have = [block], len(block)
            while have < length:
                following = next(pieces, None)
                if following is None:
                    raise ValueError("a WARC record ends before its Content-Length")
                parts += [border, following]
                have += len(border) + len(following)
            block = b"".join(parts)
        yield headers, block[:length]


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under `path`.

    payload_bytes and payload_digest are those of the whole payload: of a response they are counted
    from the block that was read (a digest that differs from the record's own is an error), of a
    revisit they are what the record states. `fields` are those of a metadata block.
    """
    import hashlib

    def run(batches):
        raw = (piece for batch in batches for piece in batch.column(0).to_pylist())
        rows: list[tuple] = []
        held = 0
        for headers, block in _parsed(raw):
            named = {name.lower(): value for name, value in headers}
            kind = named.get("warc-type")
            size = digest = body = None
            fields: list[tuple[str, str]] = []
            if kind in ("response", "revisit"):
                http, _, body = block.partition(b"\r\n\r\n")
                stated = named.get("warc-payload-digest", "").removeprefix("sha1:")
                if kind == "response":
                    size, digest = len(body), hashlib.sha1(body).hexdigest()
                    if stated and stated != digest:
                        raise ValueError(f"payload of {named.get('warc-record-id')} does not match its digest")
                else:
                    sizes = [v for n, v in _headers(http) if n.lower() == "content-length"]
                    size, digest, body = int(sizes[0]) if sizes else None, stated, None
            elif kind == "metadata":
                fields = _headers(block)
            rows.append((named.get("warc-record-id"), kind, named.get("warc-concurrent-to"), named.get("warc-refers-to"),
                         named.get("warc-target-uri"), named.get("warc-date"), size, digest, fields, body if payloads else None))
            held += len(body or b"") if payloads else 0
            if len(rows) == 2000 or held > 8 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        field = pa.struct([("name", pa.string()), ("value", pa.string())])
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.list_(field), pa.binary()]
        columns = [list(c) for c in zip(*rows, strict=True)]
        columns[8] = [[{"name": n, "value": v} for n, v in fields] for fields in columns[8]]
        names = [part.split()[0] for part in _RECORDS.replace("name: string, value: string", "").split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    text = spark.read.option("lineSep", BETWEEN + VERSION).text(path)
    # a file is read by one task from its start, so the pieces of a record follow each other
    return text.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, _RECORDS)


def assemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One nested row per capture: (capture_id, request, answer, metadata).

    Records are brought together by the id that they are concurrent to, or their own. A capture
    without a request or metadata has null there, and one whose response is missing has a null
    answer. Of several records of one kind that name the same capture the one with the smallest
    record id is taken.
    """
    shared = ["record_id", "target_uri", "date"]
    of_kind = {
        "request": (["request"], shared),
        "answer": (["response", "revisit"], [*shared, "kind", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads]),
        "metadata": (["metadata"], [*shared, "fields"]),
    }
    found = [
        F.min(F.when(F.col("kind").isin(kinds), F.struct(*fields))).alias(name) for name, (kinds, fields) in of_kind.items()
    ]
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(*found)


def page_captures(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) with page ids from the metadata."""
    stated = F.expr("try_element_at(filter(metadata.fields, f -> f.name = 'page-id'), 1).value").cast("long")
    flat = captures.select(
        "capture_id", stated.alias("page_id"), F.col("answer.payload_bytes").alias("payload_bytes"),
        F.col("answer.payload_digest").alias("payload_digest"), F.col("answer.kind").alias("record_type"),
        F.col("answer.refers_to").alias("target"))
    named = flat.select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"))
    # only revisits look for their response, and one response may have very many
    first = flat.where("target IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    again = flat.where("target IS NOT NULL").join(named, "target", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.select(*columns).unionByName(again.select(*columns))
