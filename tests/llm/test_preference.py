"""Preference pairs: rendering, masks and odd turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.llm import preference

TURNS = "pair_id long, turn long, role string, text string"


def parts(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.pair_id, r.part, r.place)):
        text, learned = out.setdefault((r.pair_id, r.part), ["", ""])
        assert r.start == len(text)
        text += r.rendered
        learned += text[r.loss_start : r.loss_start + r.loss_length]
        out[r.pair_id, r.part] = [text, learned]
    return out


def test_prompt_once_and_masked_completions(spark):
    both = [(1, 0, "system", "s"), (1, 1, "user", "q")]
    chosen = both + [(1, 2, "assistant", "good"), (1, 3, "user", "and?"), (1, 4, "assistant", "fine")]
    rejected = both + [(1, 2, "assistant", "bad")]
    got = parts(preference.format_preferences(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS)))
    assert got == {
        (1, "prompt"): ["<|start|>system\ns<|end|>\n<|start|>user\nq<|end|>\n", ""],
        (1, "chosen"): ["<|start|>assistant\ngood<|end|>\n<|start|>user\nand?<|end|>\n<|start|>assistant\nfine<|end|>\n", "good<|end|>\nfine<|end|>\n"],
        (1, "rejected"): ["<|start|>assistant\nbad<|end|>\n", "bad<|end|>\n"],
    }


def test_odd_turns(spark):
    chosen = [(1, 0, None, None), (1, None, "assistant", "x"), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 5, "assistant", ""), (None, 0, "user", "q")]
    rejected = [(1, 0, None, None), (1, 1, "assistant", "y" * 200_000), (2, 0, "user", "same"), (2, 0, "user", "same"), (4, 0, "user", "only here")]
    a, b = (spark.createDataFrame(rows, TURNS).withColumns({"place": F.lit(0), "part": F.lit("x")}) for rows in (chosen, rejected))
    got = parts(preference.format_preferences(a, b))
    assert set(got) == {(1, "prompt"), (1, "chosen"), (1, "rejected"), (2, "prompt"), (3, "chosen"), (4, "rejected")}
    assert got[1, "prompt"][0] == "<|start|>\n<|end|>\n" and got[1, "rejected"][1] == "y" * 200_000 + "<|end|>\n"
    assert got[2, "prompt"][0].count("same") == 2 and got[3, "chosen"][1] == "<|end|>\n"
    assert preference.format_preferences(a.limit(0), b.limit(0)).count() == 0


def order(turn):
    """Null numbers last, null roles and texts first."""
    _, number, role, text = turn
    return number is None, number or 0, role is not None, role or "", text is not None, text or ""


def brute(turns):
    """(pair, part) -> [(role, text)] of conversations and their rejected sides, turn by turn."""
    by_id = {}
    for t in sorted((t for t in turns if t[0] is not None), key=order):
        by_id.setdefault(t[0], []).append(t)
    answers = {i: max((n for n, t in enumerate(ts) if t[2] == "assistant"), default=None) for i, ts in by_id.items()}
    ring = sorted(i for i, at in answers.items() if at is not None)
    out = {}
    for i, chosen in by_id.items():
        rejected = chosen
        if answers[i] is not None:
            rejected = chosen[: answers[i]]
            if len(ring) > 1:
                following = ring[(ring.index(i) + 1) % len(ring)]
                rejected = sorted([*rejected, (i, chosen[answers[i]][1], "assistant", by_id[following][answers[following]][3])], key=order)
        sides = [[t[2:] for t in side] for side in (chosen, rejected)]
        same = next((n for n, (x, y) in enumerate(zip(*sides)) if x != y), min(map(len, sides)))
        for part, rows in (("prompt", sides[0][:same]), ("chosen", sides[0][same:]), ("rejected", sides[1][same:])):
            if rows:
                out[i, part] = rows
    return out


def test_neighbours_over_gaps_nulls_and_repeats(spark):
    import random

    draw = random.Random(8)
    turns = [(i, draw.choice([None, 0, 1, 2, 3]), draw.choice(["user", "assistant", None]), draw.choice(["a", "b", "", None, "c"]))
             for i in (-7, 0, 2, 4, 6, 8, 100, 1 << 40, None) for _ in range(draw.randrange(1, 7))]
    turns += [(50, 0, "user", "no answer"), (51, 0, "assistant", None)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, place int")
    got = {}
    for r in preference.format_preferences(*preference.swapped_answers(df)).orderBy("place").collect():
        got.setdefault((r.pair_id, r.part), []).append(r.rendered)
    want = brute(turns)
    assert got == {k: [f"<|start|>{role or ''}\n{text or ''}<|end|>\n" for role, text in rows] for k, rows in want.items()}


def test_every_answer_meets_another(spark):
    rows = [(i, n, role, f"{role} {i}") for i in (0, 2, 4, 6, 8) for n, role in enumerate(("user", "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = preference.format_preferences(*preference.swapped_answers(df)).collect()
    assert [sum(r.part == part for r in found) for part in ("prompt", "chosen", "rejected")] == [5, 5, 5]
    alone = preference.format_preferences(*preference.swapped_answers(df.where("conv_id = 4"))).collect()
    assert sorted(r.part for r in alone) == ["chosen", "prompt"]
    assert preference.format_preferences(*preference.swapped_answers(df.limit(0))).collect() == []
