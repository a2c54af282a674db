"""Hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Tokens are words and runs of marks, as written; unigrams and bigrams hash into a table of
weights, and a token equal to the one before it is written as one repeat sign. A score is
the sigmoid of a sparse dot product of the weights with the text's n-gram shares.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, saved

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_REPEAT = zlib.crc32(b"\x00repeat")
_CASE = {"upper": zlib.crc32(b"\x00upper"), "title": zlib.crc32(b"\x00title"), "lower": zlib.crc32(b"\x00lower")}


def _shape(token: str) -> int:
    """Of a word its case, of marks the marks themselves."""
    if not (token[0].isalnum() or token[0] == "_"):
        return zlib.crc32(token.encode("utf-8"))
    return _CASE["upper" if len(token) > 1 and token.isupper() else "title" if token[0].isupper() else "lower"]


class Hasher:
    """Texts to n-gram buckets; remembers at most `cache` token hashes."""

    def __init__(self, bits: int, cache: int = 300_000):
        self.mask, self.most, self.known = np.uint64((1 << bits) - 1), cache, {}

    def buckets(self, text: str | None) -> np.ndarray:
        """A bucket for each unigram and bigram of tokens and each bigram of their shapes."""
        tokens = _TOKEN.findall(text or "")
        if not tokens:
            return np.zeros(0, dtype=np.int64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = zlib.crc32(t.encode("utf-8")) | _shape(t) << 32
        both = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        own, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
        again = np.r_[False, own[1:] == own[:-1]]
        own = np.where(again, np.uint64(_REPEAT), own)
        shape = np.where(again, np.uint64(_REPEAT), shape)
        with np.errstate(over="ignore"):
            pair = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:]
            form = shape[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + shape[1:] + np.uint64(1)
            x = np.concatenate([own, pair, form])
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) & self.mask).astype(np.int64)


class FtrlModel:
    """weights[2**bits] and bias; score = sigmoid(bias + scale * mean weight of the n-grams)."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int, scale: float):
        self.weights, self.bias, self.bits, self.scale = weights, bias, bits, scale

    def score(self, buckets: np.ndarray) -> float:
        dot = self.bias + (self.scale * float(self.weights[buckets].sum()) / len(buckets) if len(buckets) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(dot, -35, 35))))


def train(rows: list[tuple[np.ndarray, int]], bits: int = 18, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-2, epochs: int = 4, scale: float = 30.0) -> FtrlModel:
    """FTRL-proximal, one row at a time in the given order; each class has the same total weight."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    ready = []
    ones = sum(y for _, y in rows)
    for b, y in rows:
        index, count = np.unique(b, return_counts=True)
        ready.append((np.append(index, size), np.append(scale * count / max(1, len(b)), 1.0), y, len(rows) / 2 / max(1, ones if y else len(rows) - ones)))
    for _ in range(epochs if 0 < ones < len(rows) else 0):
        for index, value, y, cost in ready:
            w = weight(index)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = cost * (p - y) * value
            s = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - s * w
            n[index] += g * g
    w = weight(np.arange(size + 1))
    return FtrlModel(w[:-1].astype(np.float32), float(w[-1]), bits, scale)


def held_out(id_col: str):
    """True on rows never learnt from: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8000, max_bytes: int = 128 << 20, bits: int = 18) -> FtrlModel:
    """Learn from at most max_rows labelled rows outside the held-out quarter (fitting only).

    The rows are those first in the order of a hash of the id, as far as their n-gram lists (4
    bytes an n-gram) stay under max_bytes in all; the first longer than that is left out with
    those after it. An id counts once: of repeated documents the one with the least list. Null
    ids, null labels and labels other than 0 and 1 are not learnt from. Without both labels
    every score is 0.5.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(marks), "_id")

    def make():
        hasher = Hasher(bits)
        return lambda c: {"i": c[0], "y": c[1], "b": [hasher.buckets(t).astype(np.int32).tobytes() for t in c[2]]}

    lists = mapped(picked, ["_id", "_y", "_t"], "i long, y int, b binary", make)
    lists = saved(lists.groupBy("i").agg(F.min("y").alias("y"), F.min("b").alias("b")))
    sizes = {r.i: r.n for r in lists.select("i", F.length("b").alias("n")).collect()}
    order = sorted(sizes, key=lambda i: (zlib.crc32(str(i).encode()), i))
    order = [i for i, total in zip(order, np.cumsum([sizes[i] for i in order]).tolist(), strict=True) if total <= max_bytes]
    if len(order) < len(sizes):
        lists = lists.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in order], "i long")), "i")
    rows = {i: (np.frombuffer(b, dtype=np.int32), y) for i, y, b in zip(*lists.toArrow().to_pydict().values(), strict=True)}
    return train([rows[i] for i in order], bits)


def score_documents(df: DataFrame, model: FtrlModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of df.

    A null or empty text has no n-grams and gets the score of the bias. A null id stays null
    and is not held out. Repeated rows give repeated results, an empty table gives none; other columns are not read.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model.weights)  # 2**bits floats: 1 MB at 18 bits
    bias, bits, scale = model.bias, model.bits, model.scale

    def make():
        own, hasher = FtrlModel(shared.value, bias, bits, scale), Hasher(bits)

        def work(columns):
            ids, held, texts = columns
            score = [own.score(hasher.buckets(t)) for t in texts]
            return {"doc_id": ids, "held_out": held, "score": score, "predicted": [int(s >= threshold) for s in score]}

        return work

    src = df.select(F.col(id_col).alias("_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("_held"), F.col(text_col).alias("_t"))
    return mapped(src, ["_id", "_held", "_t"], "doc_id long, held_out boolean, score double, predicted int", make)
