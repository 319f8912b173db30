"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes disguises: compatibility forms, case, look-alike letters of other scripts, digits
and signs in place of letters, invisible characters.  Lexicon entries are whole words and word
beginnings; their weights are log-odds learned from labelled documents that are not held out.
Words inside exception phrases do not count.  The sum is normalised by the length of the text
and turned into a probability.
"""

import math
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.shared import held_out, slices, training_sample

SAMPLE_PER_CLASS = 6000
LEXICON_SIZE = 2000
CANDIDATES = 20_000
PREFIXES = range(4, 8)
LEAST_Z = 2.5
LEAST_WEIGHT = 3.7
LEAST_CONTEXTS = 3
THRESHOLD = 0.3

# fixed values: what the folding reads as the letter on the left
LOOKS_LIKE = {
    "a": "аα@4ɑ", "b": "ЬВβв8", "c": "сϲ", "d": "ԁ", "e": "еєε3", "f": "ϝ", "g": "ɡ", "h": "һН", "i": "іιı1", "j": "ј", "k": "кκ",
    "l": "ӏⅼ", "m": "мМ", "n": "ո", "o": "оοσ0", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕ$5", "t": "тτ7", "u": "υս", "v": "ѵν",
    "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ2",
}
INVISIBLE = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
# fixed values: insults to begin with, and phrases in which such words are harmless
SEEDS = "idiot moron stupid loser scum trash worthless pathetic disgusting".split()
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "stupid question", "pond scum", "soap scum", "sore loser")

_FOLD = {ord(x): base for base, others in LOOKS_LIKE.items() for x in others} | dict.fromkeys(INVISIBLE)
_PLAIN = {i: " " if not chr(i).isalpha() else chr(i).lower() for i in range(128)} | _FOLD
_BARS = regex.compile(r"(?<=[^\W\d_])[!|](?=[^\W\d_])")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def fold(text: str) -> str:
    """Folded words, one blank between them and around them."""
    if "!" in text or "|" in text:
        text = _BARS.sub("i", text)
    if text.isascii():
        plain = text.translate(_PLAIN)
    else:
        plain = _OTHER.sub(" ", unicodedata.normalize("NFKC", text).lower().translate(_FOLD))
    return f" {' '.join(plain.split())} "


def _terms(word):
    yield f" {word} "
    for k in PREFIXES:
        if len(word) > k:
            yield f" {word[:k]}"


def _count_terms(batches):
    """Documents of each class that a term occurs in, per slice."""
    for rows, texts in slices(batches):
        count = {}
        for y, text in zip(rows.column("y").to_pylist(), texts.to_pylist()):
            for t in {t for w in set(fold(text).split()) if len(w) > 2 for t in _terms(w)}:
                count.setdefault(t, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), *(pa.array([c[y] for c in count.values()], pa.int64()) for y in (1, 0))], ["term", "bad", "good"])


def _contexts(terms):
    """Different neighbours of each term in toxic texts; copies of a text add nothing."""
    def run(batches):
        for _, texts in slices(batches):
            seen = set()
            for text in texts.to_pylist():
                words = fold(text).split()
                for i, w in enumerate(words):
                    for t in _terms(w):
                        if t in terms:
                            seen.add((t, " ".join(words[max(0, i - 1) : i] + ["_"] + words[i + 1 : i + 2])))
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in seen], pa.string()) for k in (0, 1)], ["term", "context"])
    return run


def learn_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> dict:
    """Term to weight, at most size of them.  A term needs clearly more toxic documents than
    others (z of the log-odds) and different contexts, so that copies count once."""
    spark = sample.sparkSession
    weights = {f" {w} ": 2.0 for w in SEEDS}
    totals = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return weights
    counts = sample.mapInArrow(_count_terms, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    b, g = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(b / (bad + 1 - F.least(b, F.lit(bad + 0.5)))) - F.log(g / (good + 1 - F.least(g, F.lit(good + 0.5))))
    scored = counts.withColumn("w", odds).withColumn("z", odds / F.sqrt(1 / b + 1 / g)).where((F.col("z") >= LEAST_Z) & (F.col("w") >= LEAST_WEIGHT))
    found = scored.orderBy(F.desc("z"), "term").limit(CANDIDATES).collect()
    terms = {r.term: (r.w, r.bad) for r in found}
    known = spark.sparkContext.broadcast(frozenset(terms))
    varied = sample.where("y = 1").mapInArrow(lambda it: _contexts(known.value)(it), "term string, context string").distinct().groupBy("term").count().where(
        F.col("count") >= LEAST_CONTEXTS).collect()
    kept = sorted(((terms[r.term][0], r.term) for r in varied if 2 * r["count"] >= terms[r.term][1]), reverse=True)
    for w, t in kept[:size]:
        weights[t] = float(w)
    return weights


class Matcher:
    def __init__(self, weights: dict, exceptions=EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for t, w in weights.items():
            self.automaton.add_word(t, (len(t), w))
        for phrase in exceptions:
            t = fold(phrase)
            self.automaton.add_word(t, (len(t), None))
        self.automaton.make_automaton()

    def spans(self, folded: str) -> dict:
        """Weight of each matched word by where it begins."""
        best, free = {}, []
        for end, (size, w) in self.automaton.iter(folded):
            at = end - size + 1
            if w is None:
                free.append((at, end))
            elif w > best.get(at, 0):
                best[at] = w
        for a, b in free:
            for at in [x for x in best if a <= x < b]:
                del best[at]
        return best

    def raw(self, text: str) -> float:
        """Sum of weights over a slow function of the length in words."""
        folded = fold(text)
        best = self.spans(folded)
        if not best:
            return 0.0
        return sum(best.values()) / math.log2(8 + folded.count(" ") / 100)


def _raw(weights, exceptions):
    def run(batches):
        matcher = Matcher(weights.value, exceptions)
        for rows, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([*rows.drop_columns("text").columns, pa.array([matcher.raw(t) for t in texts.to_pylist()], pa.float64())],
                                             [n for n in rows.schema.names if n != "text"] + ["raw"])
    return run


def calibrate(x, y, weight, steps: int = 50):
    """Logistic curve of one variable, by Newton steps with a small ridge."""
    x, y, weight = (np.asarray(v, float) for v in (x, y, weight))
    beta = np.array([-3.0, 2.0])
    if not len(x) or y.min() == y.max():
        return beta
    a = np.stack([np.ones_like(x), x], 1)
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
    return beta


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, exceptions=EXCEPTIONS):
    """Lexicon and logistic curve (a, b) from at most per_class labelled documents of each
    class that are not held out."""
    sample = training_sample(documents, labels, "toxic", per_class).select("text", "y")
    weights = learn_lexicon(sample)
    known = sample.sparkSession.sparkContext.broadcast(weights)
    fitted = sample.mapInArrow(_raw(known, exceptions), "y int, raw double").groupBy("y", F.round("raw", 3).alias("raw")).count().orderBy("y", "raw").collect()
    share = {r.toxic: r["count"] for r in labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("toxic").count().collect()}
    taken = {y: max(1, sum(r["count"] for r in fitted if r.y == y)) for y in (0, 1)}
    a, b = calibrate([r.raw for r in fitted], [r.y for r in fitted], [r["count"] * share.get(r.y, 1) / taken[r.y] for r in fitted]).tolist()
    return weights, a, b


def toxicity_scores(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, exceptions=EXCEPTIONS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for every row.

    Weights and curve come from at most per_class labelled documents of each class that are
    not held out; the score reads the text alone.  NULL and empty texts have the score of a
    text without a match.  Without usable labels the seeds decide.  Equal rows get equal
    scores; other columns are not read."""
    weights, a, b = fit(documents, labels, per_class, exceptions)
    known = documents.sparkSession.sparkContext.broadcast(weights)
    kind = documents.schema["doc_id"].dataType.simpleString()
    raw = documents.select("doc_id", "text").mapInArrow(_raw(known, exceptions), f"doc_id {kind}, raw double")
    scored = raw.select("doc_id", (1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("raw"))))).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, exceptions=EXCEPTIONS) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns, in one pass."""
    weights, a, b = fit(documents, labels, exceptions=exceptions)
    known = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        matcher = Matcher(known.value, exceptions)
        for rows, texts in slices(batches):
            raw = np.array([matcher.raw(t) for t in texts.to_pylist()])
            yield rows.filter(pa.array(1 / (1 + np.exp(-(a + b * raw))) < threshold))

    return documents.mapInArrow(run, documents.schema)
