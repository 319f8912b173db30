"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become counts of hashed words, of pairs of neighbouring character classes, and a few shares
of repetition.  The leading singular directions of a bounded sample of labelled documents span the
space; the sample's vectors are broadcast (at most 2 * per_class short rows).  For every document
the exact cosines with all of them are computed in blocks, and the nearest vote by similarity.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.shared import held_out, slices, training_sample, word_hashes, words_of

SAMPLE_PER_CLASS = 2000
DIMENSIONS = 64
NEIGHBOURS = 10
SHARPNESS = 40
THRESHOLD = 0.7
WORDS = 1024
BLOCK = 512


def _classes():
    """Class of each byte: every sign is its own, letters go by case, digits together."""
    table = np.zeros(256, np.int64)
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
    table[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
    table[[ord(c) for c in "0123456789"]] = 3
    table[10] = 4
    table[128:] = 5
    table[signs] = np.arange(6, 6 + len(signs))
    return table, 6 + len(signs)


_TABLE, _KINDS = _classes()
STYLE = 3
SIZE = WORDS + _KINDS * _KINDS + STYLE


def features(texts) -> np.ndarray:
    """A row per text: three blocks, damped, each of unit length unless empty."""
    n = len(texts)
    codes, starts, names = words_of(pc.ascii_lower(texts))
    owner = np.repeat(np.arange(n), np.diff(starts))
    slot = (word_hashes(names) % np.uint64(WORDS)).astype(np.int64) if len(names) else np.empty(0, np.int64)
    words = np.bincount(owner * WORDS + slot[codes], minlength=n * WORDS).reshape(n, WORDS) if len(codes) else np.zeros((n, WORDS))
    length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(t.as_buffer().to_pybytes() for t in texts), np.uint8)
    kind = _TABLE[raw]
    pairs = np.repeat(np.arange(n), length)[1:] * _KINDS * _KINDS + kind[:-1] * _KINDS + kind[1:]
    inside = np.ones(max(len(raw) - 1, 0), bool)
    ends = np.cumsum(length)[:-1]
    inside[ends[(ends > 0) & (ends < len(raw))] - 1] = False
    pairs = np.bincount(pairs[inside], minlength=n * _KINDS * _KINDS).reshape(n, -1) if len(raw) > 1 else np.zeros((n, _KINDS * _KINDS))
    style = np.zeros((n, STYLE))
    for i in range(n):
        own = codes[starts[i] : starts[i + 1]]
        if len(own) > 2:
            style[i, 0] = (own[1:] == own[:-1]).mean()
            style[i, 1] = 1 - len(np.unique(own[1:].astype(np.int64) << 32 | own[:-1])) / (len(own) - 1)
            style[i, 2] = 0.2
    blocks = [np.log1p(words) * 0.5, np.log1p(pairs), style * 4]
    out = []
    for weight, block in zip((0.5, 1.0, 1.0), blocks):
        norm = np.linalg.norm(block, axis=1, keepdims=True)
        out.append((weight * block / np.where(norm > 0, norm, 1)).astype(np.float32))
    return np.concatenate(out, 1)


def _sample_features(batches):
    for rows, texts in slices(batches, limit=2 << 20, rows=1024):
        f = features(texts)
        yield pa.RecordBatch.from_arrays([rows.column("y"), pa.array([x.tobytes() for x in f], pa.binary())], ["y", "f"])


class Space:
    """Directions, the labelled vectors in them, their labels and weights."""

    def __init__(self, x, y, share):
        self.y = np.asarray(y, np.float32)
        self.prior = float(share[1] / max(1, share[0] + share[1])) if sum(share.values()) else 0.5
        if not len(x):
            self.directions, self.vectors, self.weight = np.zeros((SIZE, 1), np.float32), np.zeros((0, 1), np.float32), self.y
            return
        x = np.stack(x).astype(np.float64)
        values, vectors = np.linalg.eigh(x.T @ x)
        self.directions = vectors[:, np.argsort(-values)[:DIMENSIONS]].astype(np.float32)
        self.vectors = self.place(x.astype(np.float32))
        taken = {v: max(1, int((self.y == v).sum())) for v in (0, 1)}
        self.weight = np.where(self.y == 1, share.get(1, 1) / taken[1], share.get(0, 1) / taken[0]).astype(np.float32)
        self.weight /= self.weight.mean() or 1

    def place(self, x):
        v = x @ self.directions
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm > 0, norm, 1)

    def vote(self, x):
        """Share of good labels among the nearest, weighted by similarity and by how many
        labelled documents a sampled one stands for."""
        if not len(self.vectors):
            return np.full(len(x), self.prior)
        out = np.empty(len(x))
        placed = self.place(x)
        for a in range(0, len(x), BLOCK):
            cosines = placed[a : a + BLOCK] @ self.vectors.T
            k = min(NEIGHBOURS, cosines.shape[1])
            at = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            near = np.clip(np.take_along_axis(cosines, at, 1), 0, 1) ** SHARPNESS * self.weight[at]
            total = near.sum(1)
            out[a : a + BLOCK] = np.where(total > 1e-9, (near * self.y[at]).sum(1) / np.maximum(total, 1e-9), self.prior)
        return np.clip(out, 0, 1)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Space:
    """The space of at most per_class labelled documents of each class, none held out."""
    sample = training_sample(documents, labels, "quality", per_class).select("y", "text")
    rows = sample.mapInArrow(_sample_features, "y int, f binary").orderBy("f", "y").collect()
    share = {r.quality: r["count"] for r in labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("quality").count().collect()}
    return Space([np.frombuffer(r.f, np.float32) for r in rows], [r.y for r in rows], {0: share.get(0, 0), 1: share.get(1, 0)})


def quality_scores(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for every row.

    The score reads the whole text alone.  NULL and empty texts resemble nothing and get the
    share of good labels; so does every text if no label can be used.  Equal texts get equal
    scores; other columns are not read."""
    spark = documents.sparkSession
    space = spark.sparkContext.broadcast(fit(documents, labels, per_class))

    def run(batches):
        for rows, texts in slices(batches, limit=2 << 20, rows=1024):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.round(space.value.vote(features(texts)), 6))], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
