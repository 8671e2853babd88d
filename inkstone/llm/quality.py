"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (shares of kinds of characters, word shapes, repetition, and
signed hashes of its words), a hidden layer turns it into a representation, gated attention weighs the passages, and the
weighted representation is scored. Only documents have labels: attention learns which passages speak for one.
"""

from __future__ import annotations

import functools
import string
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm import labelled
from inkstone.llm.bpe import Cache
from inkstone.llm.common import Kept, widen

THRESHOLD = 0.3
#: Words of a passage; the last one of a document may be shorter.
PASSAGE = 64
HASHES, HIDDEN, GATES = 32, 24, 16

#: Kinds of bytes: each ASCII sign for itself, small and capital letters, digits, spaces, line ends, controls, UTF-8's first and further bytes.
KINDS = np.zeros(256, np.int64)
for _i, _c in enumerate(string.punctuation):
    KINDS[ord(_c)] = 8 + _i
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[32], KINDS[10], KINDS[128:192], KINDS[192:] = 1, 2, 3, 4, 5, 6, 7
N_KINDS = 8 + len(string.punctuation)
N_SHAPES = 9
SIZE = N_KINDS + N_SHAPES + HASHES


@functools.cache
def _words() -> Cache:
    return Cache(zlib.crc32, 100_000)


def passages(text: str | None, size: int = PASSAGE) -> np.ndarray:
    """Features of a text's passages (float32, passages x SIZE); a text without words is one passage of zeros."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return np.zeros((1, SIZE), np.float32)
    count = -(-n // size)
    if count > 1 and n % size and n % size < size // 4:
        count -= 1  # a short rest goes to the passage before it
    of = np.minimum(np.arange(n) // size, count - 1)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    length = np.fromiter(map(len, words), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    first = np.searchsorted(of, np.arange(count))
    n_words = np.diff(np.concatenate([first, [n]]))
    kinds = KINDS[raw]
    page = np.searchsorted(starts[first], np.arange(len(raw)), "right") - 1
    shares = np.bincount(page * N_KINDS + kinds, minlength=count * N_KINDS).reshape(count, N_KINDS).astype(np.float64)
    total = shares.sum(1, keepdims=True)
    h = np.fromiter(map(_words().__getitem__, words), np.int64, n)
    same = np.zeros(n, bool)
    same[1:] = h[1:] == h[:-1]
    distinct = np.bincount(np.unique(of << 32 | h) >> 32, minlength=count)
    is_sign = (kinds >= 8).astype(np.int64)
    ends = starts + length - 1
    shape = np.empty((count, N_SHAPES))
    per = lambda x: np.bincount(of, x, count) / n_words
    shape[:, 0] = per(same)
    shape[:, 1] = distinct / n_words
    shape[:, 2] = np.log1p(per(length.astype(float)))
    shape[:, 3] = per((length > 20).astype(float))
    shape[:, 4] = per(is_sign[ends].astype(float))
    shape[:, 5] = per((is_sign[ends] & is_sign[np.maximum(ends - 1, starts)] & (length > 2)).astype(float))
    shape[:, 6] = per((kinds[starts] == 2).astype(float))
    shape[:, 7] = per((is_sign[starts] & (length == 1)).astype(float))
    shape[:, 8] = np.log1p(n_words) / 5
    hashed = np.bincount(of * HASHES + h % HASHES, 1.0 - 2.0 * (h >> 16 & 1), count * HASHES).reshape(count, HASHES) / np.sqrt(n_words)[:, None]
    return np.concatenate([np.sqrt(shares / total), shape, hashed], axis=1).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict = field(default_factory=dict)  # w1 b1: hidden layer; v u: gates; a: attention; c d: score
    prior: float = 0.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def forward(p: dict, x: np.ndarray, bag: np.ndarray, bags: int) -> dict:
    """x: passages of all bags, in order of bags; bag: the bag of each passage."""
    h = np.tanh(x @ p["w1"] + p["b1"])
    t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (t * g) @ p["a"]
    first = np.searchsorted(bag, np.arange(bags))
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    weight = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(weight[:, None] * h, first)
    return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "logit": z @ p["c"] + p["d"]}


def gradients(p: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    o = forward(p, x, bag, len(y))
    prob = _sigmoid(o["logit"])
    d_logit = (prob - y) / len(y)
    d_z = d_logit[:, None] * p["c"]
    d_weight = (d_z[bag] * o["h"]).sum(1)
    mean = np.bincount(bag, o["weight"] * d_weight, len(y))
    d_e = o["weight"] * (d_weight - mean[bag])
    d_tg = d_e[:, None] * p["a"]
    d_t, d_g = d_tg * o["g"] * (1 - o["t"] ** 2), d_tg * o["t"] * o["g"] * (1 - o["g"])
    d_h = (o["weight"][:, None] * d_z[bag] + d_t @ p["v"].T + d_g @ p["u"].T) * (1 - o["h"] ** 2)
    loss = float(-np.mean(y * np.log(prob + 1e-12) + (1 - y) * np.log(1 - prob + 1e-12)))
    return loss, {"w1": x.T @ d_h, "b1": d_h.sum(0), "v": o["h"].T @ d_t, "u": o["h"].T @ d_g, "a": (o["t"] * o["g"]).T @ d_e, "c": o["z"].T @ d_logit, "d": d_logit.sum()}


def train(rows: list[tuple[np.ndarray, int]], odds: float, epochs: int = 24, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 5) -> Model:
    """Adam over bags (passage features, label); odds: log-odds of label 1 in what the rows are a sample of."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([x for x, _ in rows])
    model = Model(every.mean(0), every.std(0) + 0.05)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"w1": init(SIZE, HIDDEN), "b1": np.zeros(HIDDEN), "v": init(HIDDEN, GATES), "u": init(HIDDEN, GATES), "a": init(GATES), "c": init(HIDDEN), "d": np.zeros(())}
    bags = [((x - model.mean) / model.scale, y) for x, y in rows]
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    step = 0
    total = epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = [bags[i] for i in order[at : at + batch]]
            x = np.concatenate([b for b, _ in some])
            bag = np.repeat(np.arange(len(some)), [len(b) for b, _ in some])
            _, g = gradients(p, x, bag, np.array([y for _, y in some], float))
            step += 1
            pace = rate * (1 - step / (total + 1))
            for k in p:
                grad = g[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    ones = sum(y for _, y in rows)
    model.p, model.prior = p, float(odds - np.log((ones + 0.5) / (len(rows) - ones + 0.5)))
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = labelled.PER_CLASS, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model | None:
    """Learns from at most per_class rows of each label whose key isn't held out; None without labels of both kinds.

    A key of several rows gives one of them; a class has at most labelled.CLASS_BYTES of text.
    """
    picked, odds = labelled.sample(labels, label, per_class, key=key)
    if len(set(picked.values())) < 2:
        return None

    @F.pandas_udf("binary")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([passages(t).tobytes() for t in texts])

    kept = Kept(docs.sparkSession)
    rows = labelled.rows_of(docs, picked, kept, text, key).select("picked", "label", features("text").alias("x")).collect()  # bounded in rows and bytes
    kept.only()
    rows.sort(key=lambda r: r["picked"])
    if len({r["label"] for r in rows}) < 2:
        return None
    return train([(np.frombuffer(r["x"], np.float32).reshape(-1, SIZE), r["label"]) for r in rows], odds)


def score(model: Model | None, texts, together: int = 512) -> np.ndarray:
    """Scores of texts; 0.5 without a model."""
    Cache.only(_words())
    texts = list(texts)
    if model is None:
        return np.full(len(texts), 0.5)
    out = []
    for at in range(0, len(texts), together):
        bags = [passages(t) for t in texts[at : at + together]]
        x = (np.concatenate(bags) - model.mean) / model.scale
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        out.append(_sigmoid(forward(model.p, x, bag, len(bags))["logit"] + model.prior))
    return np.concatenate(out) if out else np.empty(0)


def scorer(model: Model | None, text: str = "text") -> Column:
    """A column of scores; null counts as the empty text, which is one passage of zeros."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score(model, texts))

    return run(text)


def quality(docs: DataFrame, labels: DataFrame, per_class: int = labelled.PER_CLASS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted: one row for each row of docs; repeated rows score alike. Other columns aren't read."""
    model = fit(docs, labels, per_class, text, key)
    out = widen(docs.select(key, text)).select(F.col(key), labelled.held_out(key).alias("held_out"), scorer(model, text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
