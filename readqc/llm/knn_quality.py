"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled documents gives hashed tf-idf vectors; their singular vectors span the latent space. The
labelled vectors (a fixed number of a fixed length) are broadcast. Every document is projected into that space, its exact
cosines with all labelled vectors are computed in blocks, and its nearest neighbours vote with weights that grow with
similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readqc.llm.common import lean, pieces

TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n+")


def shape(token: str) -> str:
    """What a token looks like, beside what it says."""
    if token[0].isalpha():
        return "upper" if len(token) > 1 and token.isupper() else "title" if token[0].isupper() else "lower"
    return "digits" if token[0].isdigit() else "lines" if token[0] == "\n" else f"signs{min(len(token), 4)}"


REPEATS = 8


class Features:
    """Hashed places of a text's tokens, of their shapes, and of how much the text repeats itself, with counts; remembers tokens (a full memory is emptied)."""

    def __init__(self, size: int, keep: int = 300_000):
        self.size, self.keep, self.known = size, keep, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.keep:
            self.known = {}
        known, found = self.known, TOKENS.findall(text or "")
        for t in set(found).difference(known):
            low = t.lower()
            # High half: the shape's place in the first 64; low half: the token's among the others.
            known[t] = (zlib.crc32(shape(t).encode()) % 64 << 32) | (64 + zlib.crc32(low.encode("utf-8", "replace")) % (self.size - 64))
        ids = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        if not len(ids):
            return ids, ids
        pairs = (ids[:-1] & 0xFFFFFFFF) * self.size + (ids[1:] & 0xFFFFFFFF)
        again = 1 - len(np.unique(pairs)) / max(1, len(pairs))
        places, n = np.unique(np.concatenate([ids >> 32, ids & 0xFFFFFFFF]), return_counts=True)
        # How much of the text is pairs of tokens that it has had before, as one more token of some weight.
        return np.append(places, self.size + min(REPEATS - 1, int(again * REPEATS))), np.append(n, max(1, len(ids) // 4))


@dataclass
class Model:
    project: np.ndarray  # features x dimensions, with the idf weights
    vectors: np.ndarray  # labelled rows x dimensions, of length 1
    labels: np.ndarray
    neighbours: int = 25
    power: float = 8.0

    def vectors_of(self, texts: list[str | None], features: Features) -> np.ndarray:
        out = np.zeros((len(texts), self.project.shape[1]), np.float32)
        for i, text in enumerate(texts):
            at, n = features(text)
            if len(at):
                out[i] = weight(n) @ self.project[at]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str | None], features: Features, block: int = 512) -> np.ndarray:
        """Share of label 1 among each text's nearest neighbours, weighted by similarity; the share among all labelled
        rows for a text that is like none of them."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(texts), prior)
        if not len(self.labels):
            return out
        vectors, k = self.vectors_of(texts, features), min(self.neighbours, len(self.labels))
        for i in range(0, len(texts), block):
            sims = vectors[i : i + block] @ self.vectors.T
            near = np.argpartition(-sims, k - 1, 1)[:, :k]
            w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** self.power
            total = w.sum(1)
            vote = (w * self.labels[near]).sum(1) / np.maximum(total, 1e-30)
            out[i : i + block] = np.where(total > 1e-30, np.clip(vote, 0, 1), prior)
        return out


def weight(counts: np.ndarray) -> np.ndarray:
    """Shares of a text's tokens, damped; longer and shorter texts of one kind point the same way."""
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def fit(rows: list[tuple[int, str]], size: int = 8192, dimensions: int = 48) -> Model:
    """Learn from (label, text) rows."""
    labels = np.array([label for label, _ in rows], np.float64)
    if not rows:
        return Model(np.zeros((size + REPEATS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    features = Features(size)
    table = np.zeros((len(rows), size + REPEATS), np.float32)
    for i, (_, text) in enumerate(rows):
        at, n = features(text)
        if len(at):
            table[i, at] = weight(n)
    idf = np.log((1 + len(rows)) / (1 + (table > 0).sum(0))).astype(np.float32) + 0.1
    table *= idf
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
    values, left = np.linalg.eigh((table @ table.T).astype(np.float64))
    top = np.argsort(-values)[:dimensions]
    top = top[values[top] > 1e-9]
    right = (table.T @ (left[:, top] / np.sqrt(values[top])).astype(np.float32)) if len(top) else np.zeros((size + REPEATS, 1), np.float32)
    model = Model((right * idf[:, None]).astype(np.float32), np.zeros((0, 1), np.float32), labels)
    model.vectors = model.vectors_of([text for _, text in rows], features)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows whose labels nothing is learned from: crc32 of the id as text leaves 1 by 3. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = 1500, max_chars: int = 20_000) -> Model:
    """A model learned from about ``rows`` (in expectation) labelled documents of at most ``max_chars`` characters, taken by
    a hash of the id among those that aren't held out. Of an id with several labels the least counts."""
    known = labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    taken = known.where(u < min(1.0, rows / max(1, n)))
    texts = docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(taken), "doc_id")
    found = sorted((r["doc_id"], r["quality"], r["text"]) for r in texts.select("doc_id", "quality", "text").collect())
    return fit([(label, text) for _, label, text in found])


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Quality of every whole text.

    One row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5, else 0). A null or
    empty text, and one that is like no labelled text, gets the share of label 1 among the labelled rows (0.5 without
    any). Repeated rows and null ids pass through; only doc_id and text are read. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(len(model.project) - REPEATS)
        for batch in batches:
            for part, texts in pieces(batch):
                score = model.score(texts, features)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lambda batches: lean(run(batches)), f"doc_id {kind}, held_out boolean, score double, predicted int")
