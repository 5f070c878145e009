"""Benchmark items in documents, as they are and re-parameterised."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from flowsieve.llm import decontaminate, queries

SF = "/root/testdata/sf0.01"
QUESTION = ("A train leaves the old station at 7 and travels 120 km toward Springfield while Alice waits 45 minutes there"
            " before she drives 120 km back home")
OTHER = QUESTION.replace("120", "310").replace("45", "20").replace("Alice", "Bob").replace("Springfield", "Riverton").replace("7", "9")
# the two distances were one value and are two
BROKEN = OTHER.replace("310", "311", 1)


def pairs(df):
    return {(r.doc_id, r.item_id): r for r in df.collect()}


def test_query_finds_whole_items_and_nothing_else(spark):
    def tokens(text):
        return re.findall(r"[^\W\d_]+|\d+(?:[.,:]\d+)*", text.lower())

    items = {r.item_id: " ".join(tokens(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        body = f" {' '.join(tokens(r.text))} "
        want |= {(r.doc_id, i) for i, t in items.items() if f" {t} " in body}
    got = pairs(queries.op9_template_decontamination(spark, SF))
    assert want and set(got) == want


def test_reparameterised_questions(spark):
    clean = "Some other text about a train that leaves a station at 7 and nothing else of the question at all"
    docs = spark.createDataFrame([
        (1, f"Intro words. {QUESTION}. More words"), (2, f"Intro words.\n{OTHER}.\n"), (3, BROKEN), (4, clean), (5, None), (6, ""),
        (7, "x " * 200_000 + OTHER), (None, QUESTION), (1, "again")], "doc_id long, text string").withColumns({"slots": F.lit(1), "hash": F.lit("x")})
    bench = spark.createDataFrame([(10, QUESTION), (11, None), (12, ""), (13, "short item of six words"), (14, "1 2 3 4 5 6 7 8 9"), (None, QUESTION)],
                                  "item_id long, text string")
    got = pairs(decontaminate.find_contamination(docs, bench))
    assert set(got) == {(1, 10), (2, 10), (7, 10)}
    assert got[1, 10].changed_slots == 0 and got[1, 10].slots > 0
    assert got[2, 10].changed_slots == 5 and got[2, 10].first_token == 2
    short = spark.createDataFrame([(1, "say: short item of six words now"), (2, "short item of seven words")], "doc_id long, text string")
    assert set(pairs(decontaminate.find_contamination(short, bench))) == {(1, 13)}


def test_several_passes_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, QUESTION), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, QUESTION)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "HASHES_PER_PASS", 3)
    assert set(pairs(decontaminate.find_contamination(docs, bench))) == {(1, 10)}
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).count() == 0


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron nu xi pi rho sigma tau upsilon phi chi psi".split()


def test_places_are_counted_once(spark):
    phrase = " ".join(ITEM[4:12])
    changed = [*ITEM[:11], "other", *ITEM[12:]]
    short = [*ITEM[:10], "other", *ITEM[11:20]]
    docs = spark.createDataFrame([
        (1, f"{phrase} and some words between them {phrase}"), (2, " ".join(changed)), (3, " ".join(short)),
        (4, f"{' '.join(ITEM[:14])} | {' '.join(ITEM[6:])}"), (5, " ".join(ITEM[:12]))], "doc_id long, text string")
    bench = spark.createDataFrame([(22, " ".join(ITEM)), (20, " ".join(ITEM[:20]))], "item_id long, text string")
    got = pairs(decontaminate.find_contamination(docs, bench))
    assert {k: (r.shared_tokens, r.item_tokens) for k, r in got.items()} == {
        (2, 22): (21, 22), (2, 20): (19, 20), (3, 20): (19, 20), (3, 22): (19, 22), (4, 22): (22, 22), (4, 20): (20, 20)}


def template(text):
    """(template, slot) of every token; a slot is 'kind:token'."""
    out, before = [], None
    for token in re.findall(r"[^\W\d_]+|\d+(?:[.,:]\d+)*|[.!?\n]", text):
        kind = "break" if token in ".!?\n" else "number" if token[0].isdigit() else "name" if token[0].isupper() and len(token) > 1 else "word"
        slot = 1 if kind == "number" else 2 if token in decontaminate.UNITS and before == "number" else 3 if kind == "name" and before not in (None, "break") else 0
        if kind != "break":
            out.append((f"<{slot}>", f"{slot}:{token}") if slot else (token.lower(), None))
        before = kind
    return out


def brute(docs, items):
    want = {}
    for doc, text in docs:
        a = template(text)
        for item, item_text in items:
            b = template(item_text)
            size = min(decontaminate.WINDOW, len(b))
            lines = {}
            for i in range(len(b) - size + 1):
                if 2 * sum(s is None for _, s in b[i : i + size]) < size:
                    continue
                for j in range(len(a) - size + 1):
                    if all(x[0] == y[0] for x, y in zip(a[j : j + size], b[i : i + size])):
                        lines.setdefault(j - i, []).append((i, j))
            covered = set()
            for found in lines.values():
                met = {(b[i + n][1], a[j + n][1]) for i, j in found for n in range(size) if b[i + n][1]}
                if len({x for x, _ in met}) == len(met) == len({y for _, y in met}):
                    covered |= {i + n for i, _ in found for n in range(size)}
            if len(covered) >= min(decontaminate.LEAST_SHARED, len(b)) and covered:
                want[doc, item] = len(covered)
    return want


def test_random_questions_against_every_pair(spark):
    import random

    draw = random.Random(6)
    words = "the a train pump fills tank with water and Carol Dave Quito Oslo leaves for at then 3 7 12 km hours litres . !".split()
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(5, 40)))) for i in range(25)]
    swap = {"Carol": "Dave", "Dave": "Carol", "3": "99", "7": "3", "12": "1.5", "km": "litres", "Quito": "Lima"}
    docs = []
    for i in range(60):
        body = draw.choice(items)[1].split()
        if i % 2:
            body = [swap.get(w, w) for w in body]
        for _ in range(i % 4):
            body[draw.randrange(len(body))] = draw.choice(words)
        docs.append((i, " ".join([*draw.choices(words, k=draw.randrange(30)), *body, *draw.choices(words, k=5), *(body if i % 7 == 0 else [])])))
    got = pairs(decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    want = brute(docs, items)
    assert len(want) > 20 and {k: r.shared_tokens for k, r in got.items()} == want


def test_chunks_are_forgotten_and_read_again(monkeypatch):
    monkeypatch.setattr(decontaminate, "REMEMBERED", 3)
    texts = ["Ann has 3 km.\nBob has 4", "x  y\tz 5,000.5kg (Ann)", "", "Ann has 3 km.\nBob has 4"]
    reader = decontaminate.Templates()
    for text in texts:
        (codes,) = reader.codes([text])
        assert [reader.names[c] for c in codes] == re.findall(r"[^\W\d_]+|\d+(?:[.,:]\d+)*|[.!?\n]", text)
        kept, _, slots = reader.template(codes)
        assert [(f"{s}:{reader.names[c]}" if s else None) for c, s in zip(kept, slots)] == [s for _, s in template(text)]
