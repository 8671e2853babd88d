import dataclasses
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkstone.llm import labelled, lm, pii, quality, toxicity
from inkstone.llm.common import among_lowest

GOOD, BAD, RUDE = "the river and the hill of a town with water", "the### river*** $$$hill town%%% %%%", "scum"


def corpus(n=240):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        junk, rude = i % 3 == 0, i % 4 == 0
        words = list(rng.choice((BAD if junk else GOOD).split(), 150))
        if rude:
            words[int(rng.integers(0, 150))] = RUDE
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 0 if junk else 1, int(rude)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    odd = [(None, "no key", "x"), (9000, None, "x"), (9001, "", "x"), (1, rows[1][1], "x"), (9002, "very long " * 40_000, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (77_777, 1, 0), (5, 7, 7)], "doc_id bigint, quality int, toxic int")
    return docs, marks


def accuracy(out, truth):
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    return np.mean([r.predicted == truth[r.doc_id] for r in held])


def test_quality(spark, tables):
    docs, marks = tables
    out = quality.quality(docs, marks.select("doc_id", "quality")).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert accuracy(out, {i: q for i, q, _ in corpus()[1]}) > 0.95
    assert quality.quality(docs.limit(0), marks).count() == 0
    assert {r.score for r in quality.quality(docs, marks.limit(0)).collect()} == {0.5}


def test_attention_gradients():
    rng = np.random.default_rng(2)
    s, h, g = quality.SIZE, quality.HIDDEN, quality.GATES
    p = {"w1": rng.normal(size=(s, h)) / 9, "b1": rng.normal(size=h), "v": rng.normal(size=(h, g)), "u": rng.normal(size=(h, g)), "a": rng.normal(size=g), "c": rng.normal(size=h), "d": np.zeros(())}
    x, bag, y = rng.normal(size=(7, s)), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    _, grad = quality.gradients(p, x, bag, y)
    for k in p:
        at = tuple(0 for _ in p[k].shape)
        near = []
        for e in (1e-5, -1e-5):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += e
            near.append(quality.gradients(q, x, bag, y)[0])
        assert np.asarray(grad[k])[at] == pytest.approx((near[0] - near[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_passages_cover_whole_texts():
    assert quality.passages(None).shape == quality.passages(" \n").shape == (1, quality.SIZE)
    assert len(quality.passages("w " * 64 * 5)) == 5 and len(quality.passages("w " * (64 * 5 + 3))) == 5 and len(quality.passages("w " * (64 * 5 + 30))) == 6
    assert not np.allclose(quality.passages("a " * 999 + "b")[-1], quality.passages("a " * 999 + "$$$")[-1])


def test_toxicity(spark, tables):
    docs, marks = tables
    out = toxicity.toxicity(docs, marks.select("doc_id", "toxic")).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert accuracy(out, {i: t for i, _, t in corpus()[1]}) > 0.9
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0.5}


def test_slots_and_sparsity():
    assert len(toxicity.slots(None)) == len(toxicity.slots("1 !")) == 0
    assert (toxicity.slots("One, two") == toxicity.slots("one TWO")).all() and set(toxicity.slots("a")) <= set(toxicity.slots("a b"))
    rows = [(toxicity.slots(f"w{chr(97 + i % 26)}x common {'bad' if i % 2 else 'fine'}"), i % 2) for i in range(200)]
    m = toxicity.train(list(rows), 0.0)
    assert len(m.slots) < len({s for at, _ in rows for s in at}) / 2
    p = toxicity.score(m, ["common bad", "common fine", None])
    assert p[0] > 0.8 and p[1] < 0.2


def test_samples_keep_out_held_rows(spark):
    marks = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id bigint, q int")
    picked, odds = labelled.sample(marks, "q", 100)
    assert len(picked) == 200 and all(zlib.crc32(str(k).encode()) % 5 for k in picked) and abs(odds) < 0.3
    from pyspark.sql import functions as F

    n = spark.range(20_000).where(among_lowest(F.xxhash64("id"), 1000, 20_000)).count()
    assert 1000 < n < 1600


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = {}
    for k, p in PATTERNS.items():
        out[k] = []
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda m, d: True, "ip": lambda m, d: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda m, d: 16 <= len(d) <= 19 and pii.luhn(d), "phone": lambda m, d: 8 <= len(d) <= 15}[k]
            if ok(m, d):
                out[k].append(m.span())
    return out


def test_base_spans_are_the_patterns():
    rng = np.random.default_rng(3)
    for alphabet in ("ab@.19 -+()%_\n2", "@.1925 -+()", "0123456789 -", "1.2"):
        for _ in range(4000):
            t = "".join(rng.choice(list(alphabet), rng.integers(1, 60)))
            assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans(None) == pii.base_spans("") == {k: [] for k in pii.KINDS}
    pii.base_spans("a" * 300_000 + "@" + "1" * 300_000)  # linear


def test_field_generalises_and_agrees_over_a_document():
    rng = np.random.default_rng(4)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    texts = [f"call +1 ({digits(3)}) 555-{digits(4)} or write a{digits(2)}b.{digits(2)}@mail{i % 9}.example.com from {rng.integers(1, 255)}.{rng.integers(1, 255)}.3.{rng.integers(1, 255)} about version 2.{i % 9} and year {1900 + i}" for i in range(300)]
    f = pii.train(texts)
    (base, more), (_, none) = pii.all_spans(f, ["ask +1 (619) 555-0053 then (619) 555-0053 and jane.13@mail5.example.com", "version 3.1 of the year 1999"])
    assert len(base["phone"]) == len(base["email"]) == 1 and len(more["phone"]) == 1 and not any(none.values())
    t = "x +1 (619) 555-0053, y"
    assert pii.redact(t, pii.base_spans(t)) == "x [PHONE], y" and pii.redact(None, base) is None
    g = pii.graph([pii.tokens(t)])
    exact, chain, _ = pii.marginals(f, g, 200)
    assert np.exp(exact).sum(1) == pytest.approx(1) and (len(chain) == 0 or chain.sum((1, 2)) == pytest.approx(1))


def test_messages_on_a_chain_are_exact():
    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    f = pii.Field(rng.normal(size=(pii.SLOTS, k)), rng.normal(size=(k, k)), 0.7)
    g = pii.Graph(np.array([1, 2, 3]), np.array([0, 1, 2]), 3, np.array([[0, 1], [1, 2]]), np.zeros((0, 2), np.int64), np.array([True, False, False]), np.array([False, False, True]))
    p = np.zeros((k, k, k))
    for a in range(k):
        for b in range(k):
            for c in range(k):
                p[a, b, c] = math.exp(f.unary[1, a] + f.unary[2, b] + f.unary[3, c] + f.chain[0, a] + f.chain[a, b] + f.chain[b, c] + f.chain[c, 0])
    p /= p.sum()
    node, pair, _ = pii.marginals(f, g, 60)
    assert np.exp(node) == pytest.approx(np.stack([p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))]), abs=1e-3)
    assert pair[0] == pytest.approx(p.sum(2), abs=1e-3)


def test_personal_data_columns(spark):
    rows = [(1, "a@b.co 4512463504900732"), (2, None), (3, ""), (1, "a@b.co 4512463504900732"), (None, "1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS spans")
    out = pii.personal_data(df).collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out] == [(1, 0, 1, 0), (0, 0, 0, 0), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 0)]
    assert out[0].spans.startswith("email:0:6,card:7:23") and pii.personal_data(df.limit(0)).count() == 0


@pytest.mark.parametrize("head", [3, 100_000])
def test_language_model(spark, head, monkeypatch):
    monkeypatch.setattr(lm, "TRAIN_SYMBOLS", 5000)
    rng = np.random.default_rng(6)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(200)]
    rows = [(i, " ".join(words[int(x)] for x in np.minimum(199, rng.geometric(0.05, 40) + 20 * (i % 2)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "UNSEEN unseen2 wa0"), (3, rows[3][1]), (None, "wb1 wb1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS word", "2 AS n")
    out = lm.score(df, head=head).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0
    seen = [t for k, t in rows if not held(k)]
    c = Counter(w for t in seen for w in split(t))
    total, den = sum(c.values()) + len(seen), sum(c.values()) + len(seen) + 0.1 * (len(c) + 2)
    want = sorted((k or -1, held(k), len(split(t)) + 1, sum(c[w] > 0 for w in split(t)) + 1, total, round(sum(math.log10((c[w] + 0.1) / den) for w in split(t)) + math.log10((len(seen) + 0.1) / den), 6)) for k, t in rows)
    assert want == sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert all(r.score < 0 for r in out)
    assert lm.score(df.limit(0)).count() == 0


def test_next_symbols_sum_to_one():
    rng = np.random.default_rng(7)
    ids = rng.integers(0, 40, 3000)
    m = lm.train(np.bincount(ids, minlength=40).astype(float), ids, np.arange(0, 3000, 50), epochs=1)
    p = sum(10 ** m.log10(np.full(5, s), np.array([[1, 2, 3], [4, 4, 40], [40, 40, 40], [9, 8, 7], [0, 1, 0]])) for s in range(40))
    assert p == pytest.approx(np.ones(5), abs=1e-4)
    assert lm.contexts(np.array([5, 6, 7, 8]), np.array([0, 2]), 9).tolist() == [[9, 9, 9], [5, 9, 9], [9, 9, 9], [7, 9, 9]]


def test_words_of_whole_columns_are_those_of_each_text(monkeypatch):
    texts = [" " + "".join(chr(i) + "Ab\u00c9" for i in range(128)) + "\x85x \u00a0Y\u2003z\t ", "  ", None, "", "one", "\u0130K \u017f A", "B " * 50]
    plain = [(t or "").encode().lower().split() for t in texts]
    column = pa.array([None, *texts]).slice(1)
    found, starts = lm.words(column)
    assert [[w.encode() for w in found.slice(a, b - a).to_pylist()] for a, b in zip(starts, starts[1:], strict=False)] == plain
    for most in (1, 60, 10_000):
        monkeypatch.setattr(lm, "TOGETHER_BYTES", most)
        cut = list(lm.slices(column))
        assert [i for a, b in cut for i in range(a, b)] == list(range(len(texts)))
        assert all(b - a == 1 or sum(len((t or "").encode()) for t in texts[a:b]) <= most for a, b in cut)
    assert len(lm.words(pa.array([None, ""]))[0]) == 0 and list(lm.slices(pa.array([], pa.string()))) == []


def test_records_are_looked_up_for_columns_not_word_by_word(monkeypatch):
    names = [f"w{i}{'abc'[i % 3]}z" for i in range(3000)] + ["z", "\u00e9", "n\u00e9", "head", "often"]
    known = lm.Known({b"often": (0, 50), b"head": (-1, 7)}, 1, np.zeros(lm.BUCKETS), 100, 2.0, 1)
    want = [0 if w == "often" else 1 + lm.bucket(w.encode()) for w in names]
    calls, bucket = [], lm.bucket
    monkeypatch.setattr(lm, "bucket", lambda w: calls.append(w) or bucket(w))
    ids, logs = known.records()(pa.array(names))
    assert ids.tolist() == want and np.isnan(logs[:-2]).all() and logs[-2:] == pytest.approx([math.log10(7.1), math.log10(50.1)])
    assert len(calls) == 7  # az, bz, cz, z, \u00e9, n\u00e9 and ad: each ending once


def test_scores_out_of_the_range_of_powers():
    rng = np.random.default_rng(8)
    ids = rng.integers(0, 40, 2000)
    m = lm.train(np.bincount(ids, minlength=40).astype(float), ids, np.arange(0, 2000, 50), epochs=1)
    context = rng.integers(0, 40, (2000, lm.BACK))
    for factor in (1, 40, 4000):
        own = dataclasses.replace(m, back=m.back * np.float32(factor))
        q = sum(own.back[i].astype(float)[context[:, i]] for i in range(lm.BACK))
        a = q @ own.class_vectors.T.astype(float) + own.class_bias
        want = a[np.arange(2000), m.cls[ids]] - np.logaddexp.reduce(a, 1)
        for r, s in enumerate(ids):
            b = own.vectors[m.cls[s]].astype(float) @ q[r] + own.bias[m.cls[s]]
            want[r] += b[m.place[s]] - np.logaddexp.reduce(b)
        assert own.log10(ids, context) == pytest.approx(want / math.log(10), rel=1e-3, abs=1e-3)
