"""Toxicity scores: boosted trees over dense features of the whole text, calibrated by isotonic regression.

Fitting uses at most `sample` labelled rows, chosen by a hash of their id. From one part of them
terms (words and word beginnings) are learned that toxic documents hold more often than others;
trees are fitted on the features of the same part, and the calibration on the rest. Scoring is one
map over all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from flowsieve.llm.text import slices, text_bytes
from flowsieve.sources.scratch import materialise

# Labelled rows that a model is fitted on at most, and terms that it keeps at most.
SAMPLE = 40_000
TERMS = 4_000
TREES, DEPTH = 20, 4
# Distinct tokens that a task remembers, some 40 MB.
REMEMBERED = 250_000

# Common insults, and words for the second person in four languages.
INSULTS = "idiot moron stupid dumb loser trash scum clown pathetic worthless disgusting fool garbage imbecile jerk".split()
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos"
    " tú ti usted ustedes vosotros vuestro"
).split()
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NEAR = 5
_SPAN = 60

FEATURES = (
    "insults", "words", "beginnings", "evidence", "most_in_span", "near_second_person", "second_person", "capital_letters",
    "capital_words", "exclamations", "punctuation", "digits", "repeats", "obfuscated", "obfuscated_terms", "length", "any_term",
)


class Lexicon(NamedTuple):
    """Weights of learned words and word beginnings."""

    words: dict[str, float]
    beginnings: dict[str, float]


def plain_form(token: str) -> tuple[str, bool]:
    """A token in lower case without punctuation around it, and whether letters in it were disguised."""
    bare = token.strip(_EDGES).lower()
    if bare.isalpha():
        return bare, False
    shown = token.lower().lstrip("\"#%&'()*+,-./:;<=>?[\\]^_`{|}~").rstrip("\"#%&'()*+,-./:;<=>?[\\]^_`{|}~!$@").translate(_LEET)
    shown = "".join(c for c in shown if c not in _EDGES)
    letters = sum(c.isalpha() for c in bare)
    disguised = shown.isalpha() and 2 * letters >= len(bare) and letters >= 2
    return (shown, True) if disguised else (bare, False)


def _terms(word: str) -> list[str]:
    """The word itself, marked as whole, and its beginnings."""
    return [f"{word}$", *(word[:n] for n in range(3, min(len(word), 9)))] if word.isalpha() else []


def _count_terms(docs: DataFrame, kept: frozenset[str] | None) -> DataFrame:
    """In how many documents each term occurs: (term, n). Only terms in `kept`, if it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen: set[str] = set()
                for token in set((text or "").split()):
                    terms = memo.get(token)
                    if terms is None:
                        terms = tuple(t for t in _terms(plain_form(token)[0]) if kept is None or t in kept)
                        if len(memo) < REMEMBERED:
                            memo[token] = terms
                    seen.update(terms)
                found.update(seen)
            if len(found) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["term", "n"])
                found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms of `sample` (text, label) that toxic documents hold more often; TERMS at most."""
    toxic, clean = sample.where("label = 1"), sample.where("label = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    least = max(4, round(0.003 * n_toxic))
    # a document has few hundred distinct words, so few terms are in so many documents
    often = _count_terms(toxic, None).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(50 * TERMS)
    in_toxic = {r.term: r.n for r in often.collect()}
    in_clean = {r.term: r.n for r in _count_terms(clean, frozenset(in_toxic)).collect()}
    odds = {}
    for term, n in in_toxic.items():
        ratio = log((n + 0.5) / (n_toxic + 1)) - log((in_clean.get(term, 0) + 0.5) / (n_clean + 1))
        if ratio > 1:
            odds[term] = (ratio * n**0.5, ratio)
    best = sorted(odds, key=lambda t: (-odds[t][0], t))[:TERMS]
    words = {t[:-1]: odds[t][1] for t in best if t.endswith("$")}
    return Lexicon(words, {t: odds[t][1] for t in best if not t.endswith("$")})


class Scanner:
    """Features of whole texts. Made once per task: it remembers what each distinct token is."""

    def __init__(self, lexicon: Lexicon) -> None:
        self._lexicon = lexicon
        self._insults, self._you = frozenset(INSULTS), frozenset(SECOND_PERSON)
        self._seen: dict[str, int] = {}
        self._kinds: dict[tuple, int] = {}
        self._table = np.zeros((0, 9))

    def _kind(self, token: str) -> int:
        """Row of the token in the table of token kinds."""
        word, disguised = plain_form(token)
        weight = self._lexicon.words.get(word, 0.0)
        start = max((self._lexicon.beginnings.get(word[:n], 0.0) for n in range(3, min(len(word), 9))), default=0.0)
        insult = word in self._insults
        hit = insult or weight > 0 or start > 0
        kind = (insult, weight > 0, start > 0, max(weight, start, 5.0 * insult), hit, word in self._you,
                len(word) > 1 and token.isupper(), disguised, disguised and hit)
        at = self._kinds.setdefault(kind, len(self._kinds))
        if at == len(self._table):
            self._table = np.vstack([self._table, np.array([kind], dtype=float)])
        if len(self._seen) < REMEMBERED:
            self._seen[token] = at
        return at

    def _of_words(self, text: str) -> list[float]:
        seen, kind = self._seen, self._kind
        tokens = text.split()
        n = len(tokens)
        if not n:
            return [0.0] * 12
        codes = np.fromiter((seen[t] if t in seen else kind(t) for t in tokens), dtype=np.int64, count=n)
        sums = np.bincount(codes, minlength=len(self._table)) @ self._table
        insults, words, starts, evidence, hits, you, capital, disguised, disguised_hits = sums.tolist()
        near = most = 0
        if hits:
            at = np.flatnonzero(self._table[codes, 4])
            most = int((np.searchsorted(at, at + _SPAN) - np.arange(len(at))).max())
            if you:
                persons = np.flatnonzero(self._table[codes, 5])
                near = int((np.searchsorted(persons, at + _NEAR, "right") > np.searchsorted(persons, at - _NEAR)).sum())
        return [100 * insults / n, 100 * words / n, 100 * starts / n, 100 * evidence / n, float(most), 100 * near / n, 100 * you / n,
                100 * capital / n, 100 * disguised / n, 100 * disguised_hits / n, log(1 + n), float(hits)]

    def features(self, column: pa.Array) -> np.ndarray:
        """(texts, FEATURES)."""
        data, bounds = text_bytes(column)
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        chars = np.zeros((len(sizes), 5))
        if len(full):
            starts = bounds[:-1][full]
            upper = (data >= 65) & (data <= 90)
            digit = (data >= 48) & (data <= 57)
            mark = (data == 33) | (data == 63)
            other = (data > 32) & (data < 127) & ~upper & ~digit & ~((data >= 97) & (data <= 122))
            again = np.zeros(len(data), dtype=bool)
            again[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
            for k, flags in enumerate((upper, mark, other, digit, again)):
                chars[full, k] = 100 * np.add.reduceat(flags, starts, dtype=np.int64) / sizes[full]
        rows = np.array([self._of_words(t or "") for t in column.to_pylist()], dtype=float).reshape(-1, 12)
        insults, words, starts_, evidence, most, near, you, capital, disguised, disguised_hits, length, hits = rows.T
        upper, mark, other, digit, again = chars.T
        return np.stack([insults, words, starts_, evidence, most, near, you, upper, capital, mark, other, digit, again,
                         disguised, disguised_hits, length, hits], axis=1)


def text_features(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """The columns `keep`, which must be long, and `features` (array<double>) of `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in batches:
            for part in slices(batch, len(keep)):
                values = scanner.features(part.column(len(keep)))
                offsets = pa.array(np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))],
                    names=[*keep, "features"])

    schema = ", ".join([*(f"{c} long" for c in keep), "features array<double>"])
    return docs.select(*keep, "text").mapInArrow(run, schema)


class ToxicityModel:
    """A lexicon, trees and a calibration; without both labels in the sample, a constant."""

    def __init__(self, lexicon: Lexicon, trees: GBTClassificationModel | None, curve: IsotonicRegressionModel | None, share: float) -> None:
        self.lexicon, self.trees, self.curve, self.share = lexicon, trees, curve, share

    def scores(self, docs: DataFrame) -> DataFrame:
        """(key, score) of `docs` (key long, text)."""
        if self.trees is None:
            return docs.select("key", F.lit(self.share).alias("score"))
        return self.calibrated(_margins(self.trees, text_features(docs, self.lexicon, "key"), "key"))

    def calibrated(self, margin: DataFrame) -> DataFrame:
        """Rows with `margin` replaced by `score`."""
        curve = self.curve.transform(margin) if self.curve else margin.withColumn("calibrated", F.col("margin"))
        # the curve has flat steps; inside one the trees still decide the order
        score = 0.999 * F.col("calibrated") + 0.001 * F.col("margin")
        kept = [c for c in margin.columns if c != "margin"]
        return curve.select(*kept, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))


def _margins(trees: GBTClassificationModel, rows: DataFrame, *keep: str) -> DataFrame:
    scored = trees.transform(rows.select(*keep, array_to_vector("features").alias("features")))
    return scored.select(*keep, vector_to_array("probability")[1].alias("margin"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on `sample` rows of `labels` (doc_id, label 0 or 1) at most, with the texts of `docs`.

    Several labels of one id count as their largest; null ids and labels are left out. Runs its
    jobs when called.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("label").cast("long").alias("label")).dropna()
    # a documented bound: so many ids and labels are broadcast
    chosen = known.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key", F.lit("sample")), "key").limit(sample)
    keyed = docs.select(F.col("doc_id").cast("long").alias("key"), "text")
    part = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(4)) == 0
    rows = materialise(keyed.join(F.broadcast(chosen), "key").withColumn("held", part), "toxic_sample")
    tree_rows, curve_rows = rows.where("NOT held"), rows.where("held")
    counts = {r.label: r["count"] for r in tree_rows.groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return ToxicityModel(Lexicon({}, {}), None, None, share)
    lexicon = learn_lexicon(tree_rows)
    features = materialise(text_features(rows.withColumn("held", F.col("held").cast("long")), lexicon, "held", "label"), "toxic_features")
    train = features.where("held = 0").select(F.col("label").cast("double"), array_to_vector("features").alias("features")).repartition(6)
    trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5, seed=7).fit(train)
    held = _margins(trees, features.where("held = 1"), "label").withColumn("label", F.col("label").cast("double")).coalesce(1)
    curve = None
    if curve_rows.count():
        curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(held)
    return ToxicityModel(lexicon, trees, curve, share)


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that `score_documents` does not predict toxic, with all their columns.

    Each row is judged by its own text, also where rows share an id or have none, and goes through
    one map: no text is shuffled.
    """
    model = fit(docs, _learnable(labels), sample)
    if model.trees is None:
        return docs if model.share < 0.5 else docs.limit(0)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model_lexicon)
        for batch in batches:
            flat = pa.RecordBatch.from_arrays(batch.column(0).flatten(), names=[str(i) for i in range(batch.column(0).type.num_fields)])
            at = 0
            for part in slices(flat, text):
                values = scanner.features(part.column(text))
                offsets = pa.array(np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, part.num_rows), pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))], names=["row", "features"])
                at += part.num_rows

    model_lexicon = model.lexicon
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = StructType([rows.schema["row"], StructField("features", ArrayType(DoubleType()))])
    scored = model.calibrated(_margins(model.trees, rows.mapInArrow(run, kind), "row"))
    return scored.where("score < 0.5").select("row.*")


def _learnable(labels: DataFrame) -> DataFrame:
    return labels.where(_remainder() != 0).select("doc_id", F.col("toxic").alias("label"))


def _remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score every row of `docs` (doc_id, text) by a model fitted on `labels` (doc_id, toxic).

    Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0; nothing but the
    text is an input of a score. Returns (doc_id, held_out, score, predicted). Null and empty texts
    have no words and get the score of such a text; null ids are not held out; repeated rows are
    scored each; other columns play no part; an empty table gives an empty result; without labels
    of both kinds all scores are the share of label 1.
    """
    model = fit(docs, _learnable(labels), sample)
    scored = model.scores(docs.select(F.col("doc_id").cast("long").alias("key"), "text")).withColumnRenamed("key", "doc_id")
    return scored.select(
        "doc_id", F.coalesce(_remainder() == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
