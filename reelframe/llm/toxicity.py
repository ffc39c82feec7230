"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text, lower-cased, is a list of words (runs of letters and digits).  Its features
are the distinct hashes, modulo ``2 ** BITS``, of its words, of neighbouring pairs and
of pairs with one word between them.  FTRL-proximal keeps a sum of gradients and of
squared gradients for each coordinate, which gives every weight a learning rate of
its own and, by L1, leaves most weights at exactly zero; the few others are sorted
arrays that go to the executors inside the function.

Learning takes at most ``TRAIN_DOCS`` labelled documents, those with the smallest hash
of their id; scoring reads every whole text.  The features of what is learned from come
to the driver a partition at a time, packed, and wait in a file there, so that texts of any
length are learned whole and memory is one partition and one document.
Labels, language, source and id are never inputs of a score.

Nulls and odd input: a null or empty text, or one without words, has no features and
the score of the bias alone; repeated rows score alike; a row with a null id is scored
but never learned from; rows of labels with null id or label are left out, repeated
ones count once (label 1 if any says so); of several texts under one labelled id one is learned from (the least by its packed features); with no label to learn from, all scores are
0.0; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import tempfile
import zlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import crc_mod, read

BITS = 20
TRAIN_DOCS = 12_000
THRESHOLD = 0.3
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.5
WORD = re.compile(r"[^\W_]+")


class Hasher:
    """Distinct feature hashes of a text; remembers the hashes of words seen lately."""

    def __init__(self, bits: int = BITS, most: int = 1 << 18):
        self.mask, self.most, self.known = np.uint64((1 << bits) - 1), most, {}

    def words(self, text: str | None) -> np.ndarray:
        known, out = self.known, []
        if len(known) > self.most:
            known.clear()
        for w in WORD.findall((text or "").lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = crc32(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, np.uint64)

    def features(self, text: str | None) -> np.ndarray:
        w = self.words(text)
        parts = [w * np.uint64(0x9E3779B97F4A7C15)]
        for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
            if len(w) > gap:
                parts.append((w[:-gap] * np.uint64(0x9E3779B97F4A7C15) + w[gap:] + np.uint64(gap)) * np.uint64(salt))
        h = np.concatenate(parts)
        return np.unique(((h ^ (h >> np.uint64(29))) >> np.uint64(7)) & self.mask).astype(np.int32)


def pack(features: np.ndarray) -> bytes:
    """Sorted features as bytes: their gaps, low bytes first, deflated."""
    gaps = np.diff(features, prepend=0).astype("<u4")
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int32)


class FTRL:
    """Per-coordinate FTRL-proximal with binary features; coordinate ``2 ** bits`` is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.size, self.alpha, self.beta, self.l1, self.l2 = 1 << bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.size, 0.0, self.l1)
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, features: np.ndarray, label: int) -> float:
        at = np.append(features, self.size)
        w = self.weights(at)
        p = sigmoid(w.sum())
        g = p - label
        n = self.n[at]
        new = n + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(n)) / self.alpha * w
        self.n[at] = new
        return p

    def sparse(self) -> Scorer:
        w = self.weights(np.arange(self.size + 1))
        at = np.flatnonzero(w[:-1])
        return Scorer(at.astype(np.int32), w[at].astype(np.float32), float(w[-1]))


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


class Scorer:
    """The weights that are not zero."""

    def __init__(self, at: np.ndarray, w: np.ndarray, bias: float, bits: int = BITS):
        self.at, self.w, self.bias, self.bits = at, w, bias, bits

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.at] = self.w
        return out


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", hold_out: tuple[int, int] = (4, 2), docs: int = TRAIN_DOCS) -> Scorer | None:
    """Learn from labelled rows whose crc32(id) mod the first number is not the second."""
    mod, rest = hold_out
    own = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (crc_mod(id_col, mod) != rest))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(docs)
    )
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(own), "id")  # own: docs rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            x = [pack(hasher.features(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(x, pa.binary())], names=["id", "label", "x"])

    held = texts.select("id", "label", "text").mapInArrow(run, texts.select("id", "label", F.lit(b"").alias("x")).schema)
    rows, model = [], FTRL()
    with tempfile.TemporaryFile() as kept:
        for r in held.groupBy("id", "label").agg(F.min("x").alias("x")).toLocalIterator():  # ``docs`` rows at most, however often an id is repeated
            rows.append((crc32(str(r["id"]).encode()), r["id"], r["label"], kept.tell(), kept.write(r["x"])))
        if not rows:
            return None
        rows.sort()
        for _ in range(EPOCHS):
            for _, _, label, at, size in rows:
                kept.seek(at)
                model.learn(unpack(kept.read(size)), label)
    return model.sparse()


def score_texts(documents: DataFrame, model: Scorer | None, *, text_col: str = "text", keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` with score and predicted, for every whole text."""
    source = documents.select(*keep, F.col(text_col).alias("__text"))
    schema = documents.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w = Hasher(), model.dense() if model else None
        for b in batches:
            texts = b.column(b.num_columns - 1)
            score = [sigmoid(model.bias + float(w[hasher.features(t.as_py())].sum(dtype=np.float64))) if model else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score_texts(docs, model, keep=["doc_id"]).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
