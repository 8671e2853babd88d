"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, and L1 leaves most weights at zero: the model is a short list of hash slots
and weights, small enough to go to every task whatever the corpus is.
"""

from __future__ import annotations

import functools
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm import labelled
from inkstone.llm.bpe import Cache
from inkstone.llm.common import Kept, widen

BITS = 20
THRESHOLD = 0.5
#: ASCII signs and digits become spaces, A-Z become a-z; other bytes stay.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Multipliers that tell kinds of features apart (odd numbers of 64 bits; fixed values).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


#: Lengths of the beginnings of words that stand beside the words: many languages put a stem first.
STEMS = (4, 5, 6, 7)


def _hashes(word: bytes) -> bytes:
    """Hashes of a word and of its beginnings, zero where it has none of that length."""
    letters = word.decode("utf-8", "replace")
    own = [zlib.crc32(word) + 1, *(zlib.crc32(letters[:n].encode(), n) + 1 if len(letters) >= n else 0 for n in STEMS)]
    return struct.pack(f"<{len(own)}Q", *own)


@functools.cache
def _words() -> Cache:
    return Cache(_hashes, 100_000)


def slots(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hash slots of words, their stems, pairs of neighbours and pairs with one or two words between them, each once."""
    found = (text or "").encode().translate(WORDS).split()
    if not found:
        return np.empty(0, np.int64)
    table = np.frombuffer(b"".join(map(_words().__getitem__, found)), "<u8").reshape(len(found), -1)
    h, stems = table[:, 0], table[:, 1:].ravel()
    first = h * MIX[0]
    parts = [first, stems[stems > 0] * MIX[4], *(first[:-gap] + (h[gap:] * MIX[gap]) for gap in (1, 2, 3) if len(h) > gap)]
    mixed = np.concatenate(parts)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX[5]
    return np.unique((mixed >> np.uint64(64 - bits)).astype(np.int64))


@dataclass
class Model:
    slots: np.ndarray  # int64, sorted
    weights: np.ndarray  # float32
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.slots] = self.weights
        return out


def train(rows: list[tuple[np.ndarray, int]], odds: float, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0, epochs: int = 5, least: int = 5, seed: int = 3) -> Model:
    """FTRL-proximal over (slots, label) rows; slots of fewer than `least` rows are left out.

    odds: log-odds of label 1 in what the rows are a sample of; the bias is moved by the difference.
    """
    seen = np.zeros(1 << bits, np.int64)
    for at, _ in rows:
        seen[at] += 1  # a row has each slot once
    often = seen >= least
    for i, (at, y) in enumerate(rows):
        rows[i] = (at[often[at]], y)
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, y = rows[i]
            za = z[at]
            w = np.where(np.abs(za) <= l1, 0.0, (np.sign(za) * l1 - za) / ((beta + np.sqrt(n[at])) / alpha + l2))
            b = -bias_z / ((beta + bias_n**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha * b
            bias_n += g * g
    used = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[used]) * l1 - z[used]) / ((beta + np.sqrt(n[used])) / alpha + l2)
    ones = sum(y for _, y in rows)
    sampled = np.log((ones + 0.5) / (len(rows) - ones + 0.5))
    return Model(used, w.astype(np.float32), float(-bias_z / ((beta + bias_n**0.5) / alpha) + odds - sampled), bits)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = labelled.PER_CLASS, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Learns from at most per_class rows of each label whose key isn't held out; no labels: a model without weights.

    A key of several rows gives one of them; a class has at most labelled.CLASS_BYTES of text.
    """
    picked, odds = labelled.sample(labels, label, per_class, key=key)
    if not picked:
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), 0.0)

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([slots(t).astype("<u4").tobytes() for t in texts])

    kept = Kept(docs.sparkSession)
    drawn = kept.keep(labelled.rows_of(docs, picked, kept, text, key).select("picked", "label", digest("text").alias("slots")))
    # bounded in rows and bytes; part by part, and four bytes a slot
    rows = [(r["picked"], np.frombuffer(bytes(r["slots"]), "<u4"), r["label"]) for r in drawn.toLocalIterator()]
    kept.only()
    rows.sort(key=lambda r: r[0])
    return train([(at, y) for _, at, y in rows], odds)


def score(model: Model, texts) -> np.ndarray:
    Cache.only(_words())
    w = model.dense()
    total = np.array([w[slots(t, model.bits)].sum() for t in texts], float) + model.bias
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def scorer(model: Model, text: str = "text") -> Column:
    """A column of scores; null counts as the empty text, which scores what the bias says."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score(model, texts))

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = labelled.PER_CLASS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted: one row for each row of docs; repeated rows score alike. Other columns aren't read."""
    model = fit(docs, labels, per_class, text, key)
    out = widen(docs.select(key, text)).select(F.col(key), labelled.held_out(key).alias("held_out"), scorer(model, text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
