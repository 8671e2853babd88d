"""Operators that learn from or compare all of their input, however large."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import lm
from inkstone.llm.common import Kept


def test_language_model_learns_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAIN_SYMBOLS", 30_000)
    monkeypatch.setattr(lm, "PIECE", 1000)
    # what follows "ask" and "say" stands only in documents that are far longer than a piece
    patterns = ["ask yes no maybe", "say one two three"]
    rows = [(i, " ".join(["plain filler words"] * 20)) for i in range(1600)] + [(5000 + i, " ".join([patterns[i % 2]] * 5000)) for i in range(6)]
    docs = spark.createDataFrame(rows, "key bigint, text string").withColumn("held_out", F.lit(False))
    kept = Kept(spark)
    known, symbols = lm.know(kept.keep(lm.token_counts(docs.select("text"))))
    texts = kept.keep(lm.coded(docs, known))
    m = lm.fit(texts, known, symbols, kept)
    of = {w.decode(): s for w, (s, _) in known.head.items()}
    p = lambda w, *before: 10 ** m.log10(np.array([of[w]]), np.array([[of[b] for b in before]]))[0]
    got = p("yes", "ask", "maybe", "no"), p("two", "one", "say", "three"), p("filler", "plain", "words", "filler")
    assert min(got) > 0.6, got
    sizes = [(r.n_tokens, sum(len(x) // 2 for x in r.pieces) - lm.BACK * (len(r.pieces) - 1)) for r in texts.select("n_tokens", "pieces").collect()]
    assert all(a == b for a, b in sizes) and sum(a for a, _ in sizes) == known.total == symbols.sum()
    ids, context = lm.joined([(0, np.arange(5, dtype="<u2").tobytes()), (3, np.arange(2, 8, dtype="<u2").tobytes())], 99)
    assert ids.tolist() == [0, 1, 2, 3, 4, 5, 6, 7] and context[5].tolist() == [4, 3, 2] and context[0].tolist() == [99, 99, 99]


@pytest.mark.parametrize("head", [2, 100_000])
def test_scores_are_those_of_a_plain_recomputation(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "PIECE", 7)
    know = lm.know
    monkeypatch.setattr(lm, "know", lambda counts, head: know(counts, head, 5))
    rng = np.random.default_rng(3)
    names = [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(names[int(x)] for x in np.minimum(19, rng.geometric(0.2, 23)))) for i in range(60)] + [(100, None), (101, "new wa new NEWER"), (102, ""), (103, "wb " * 40_000), (3, "wa wb"), (None, "wc")]
    used = {}
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda texts, known, symbols, kept: used.setdefault("model", fit(texts, known, symbols, kept)))
    out = {(r.doc_id, r.n_tokens): r.score for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), head=head).collect()}
    model = used["model"]
    c = Counter(w for k, t in rows if zlib.crc32(("" if k is None else str(k)).encode()) % 10 for w in (t or "").lower().split())
    # the head that stands for itself, down to a step of the scale of counts
    level = {w: math.floor(math.log2(n) * 16) for w, n in c.items()}
    top = [w for w in c if sum(level[v] >= level[w] for v in c) <= head]
    symbol = {w: i for i, w in enumerate(sorted(top, key=lambda w: (-c[w], w))[:5])}
    mass = Counter()
    for w in c:
        if w not in symbol:
            mass[lm.bucket(w.encode())] += c[w] + lm.ALPHA
    end, start = len(symbol) + lm.BUCKETS, len(symbol) + lm.BUCKETS + 1

    def plain(ids, rest):
        total = rest
        for i, s in enumerate(ids):
            before = [ids[i - j] if i >= j else start for j in range(1, lm.BACK + 1)]
            q = sum(model.back[j][b] for j, b in enumerate(before))
            a = model.class_vectors @ q + model.class_bias
            k = model.cls[s]
            b = model.vectors[k] @ q + model.bias[k]
            total += (a[k] - np.logaddexp.reduce(a) + b[model.place[s]] - np.logaddexp.reduce(b)) / math.log(10)
        return total

    for k, t in rows:
        words = (t or "").lower().split()
        if len(words) > 1000:
            continue
        ids = [symbol.get(w, len(symbol) + lm.bucket(w.encode())) for w in words] + [end]
        # a bucket's words and the word it hasn't seen share its whole probability
        rest = sum(math.log10((c[w] + lm.ALPHA) / (mass[lm.bucket(w.encode())] + lm.ALPHA)) for w in words if w not in symbol)
        assert out[k, len(ids)] == pytest.approx(plain(ids, rest), abs=1e-3)
    assert len(out) == len(rows) and out[103, 40_001] < 0


def test_buckets_are_the_same_in_columns(spark):
    names = ["a", "ab", "abc", "é", "né", "xé1", "中文字", "\U0001f600x", "z\u0301", "123", lm.END]
    got = {r.word: r.b for r in spark.createDataFrame([(n,) for n in names], "word string").select("word", lm.bucket_of("word").alias("b")).collect()}
    assert got == {n: -1 if n == lm.END else lm.bucket(n.encode()) for n in names}
    assert all(lm.bucket(n.encode()) == zlib.crc32(n[-2:].encode()) % lm.BUCKETS for n in names)


def test_scores_are_a_function_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAIN_SYMBOLS", 4000)  # several groups
    monkeypatch.setattr(lm, "PIECE", 50)
    rng = np.random.default_rng(5)
    names = np.array([f"w{i}" for i in range(60)])
    rows = [(i, " ".join(names[np.minimum(59, rng.geometric(0.1, 40))])) for i in range(300)] + [(1000 + i, "copy of one text " * 20) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    runs = [{r.doc_id: (r.base_score, r.score) for r in lm.score(docs.repartition(n)).collect()} for n in (4, 16, 64)]
    for other in runs[1:]:
        assert all(other[k] == pytest.approx(v, rel=1e-3) for k, v in runs[0].items())
    # copies are as many as they are, and lie in several groups
    own = docs.selectExpr("doc_id AS key", "text", "false AS held_out")
    kept = Kept(spark)
    known, _ = lm.know(kept.keep(lm.token_counts(own.select("text"))))
    dealt = lm.deal(lm.coded(own, known), 3, 4).collect()
    assert sum(r.times * (len(r.ids) // 2 - r.lead) for r in dealt) == known.total
    hot = [r for r in dealt if r.times > 1]
    assert {(r.round, r.g) for r in hot} == {(a, b) for a in range(3) for b in range(4)} and max(r.times for r in hot) - min(r.times for r in hot) <= 1
