"""Bounds of what reaches the driver, odd rows, and results against plain recomputations."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkstone.llm import bpe, labelled, packing, pii, quality, simhash, tiff, token_counts, toxicity
from inkstone.llm.common import Kept, free_name


def train_keys(n):
    return [k for k in range(10_000) if zlib.crc32(str(k).encode()) % 5][:n]


def test_samples_are_bounded_in_rows_and_bytes(spark):
    a, b, c, d = train_keys(4)
    docs = spark.range(100_000).select(F.lit(a).cast("bigint").alias("doc_id"), F.concat(F.lit("copy "), (F.col("id") % 3).cast("string")).alias("text"))
    big = spark.range(1).select(F.lit(b).cast("bigint").alias("doc_id"), F.repeat(F.lit("word "), F.lit(10_000_000)).alias("text"))
    docs = docs.unionByName(big).unionByName(spark.createDataFrame([(c, "short"), (d, None)], "doc_id bigint, text string"))
    kept = Kept(spark)
    got = labelled.rows_of(docs, {a: 0, b: 1, c: 1, d: 0}, kept, limit=1 << 20).select("picked", F.length("text").alias("n")).collect()
    sizes = {r.picked: r.n for r in got}
    assert set(sizes) in ({a, c, d}, {a, b, d}) and sizes[a] == 6 and sizes[d] is None
    rows = [{"label": 1, "h": h, "n": n} for h, n in ((5, 60), (-3, 50), (9, 1), (7, None))]
    keep = spark.createDataFrame([(1, h) for h in (5, -3, 9, 7)], "label int, h int").where(labelled.within(rows, 100)).collect()
    assert [r.h for r in keep] == [-3]
    assert labelled.rows_of(docs.limit(0), {a: 0}, kept).count() == 0


def test_one_repeated_document_is_one_of_the_sample(spark, monkeypatch):
    used = []
    monkeypatch.setattr(pii, "train", lambda texts: used.append(texts))
    same = spark.range(30_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("call +1 619 555 0053").alias("text"))
    docs = same.unionByName(spark.range(500).select("id", F.concat(F.lit("a@b.co "), F.col("id").cast("string"))).toDF("doc_id", "text")).withColumn("key", F.lit("x"))
    pii.fit(docs, sample=100)
    assert len(used[0]) <= 100 and used[0].count("call +1 619 555 0053") <= 1
    monkeypatch.setattr(pii, "SAMPLE_BYTES", 30)
    pii.fit(docs, sample=100_000)
    assert 1 <= len(used[1]) and (len(used[1]) == 1 or sum(map(len, used[1])) <= 30)


def test_packing_carries_keys_as_they_are(spark):
    keys = [(1 << 60) + 1, None, (1 << 60) + 3, None, -5]
    df = spark.createDataFrame([(k, "word " * (i + 1)) for i, k in enumerate(keys)], "doc_id bigint, text string")
    for group in (2, 16_000):
        out = packing.pack_documents(df, group=group).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((k is None, k or 0) for k in keys)
    names = packing.pack_documents(df.select(F.col("doc_id").cast("string").alias("name"), "text"), key="name").collect()
    assert {r.name for r in names} == {None if k is None else str(k) for k in keys}


def test_packing_takes_the_best_bin_of_all(spark):
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 60, 150))[::-1]
    for docs, cost, rule in ((None, None, "norm"), (4, 2000, "norm"), (3, 3000, "dot")):
        caps = np.array([100.0, docs or 100, cost or 100.0**2])
        bins: list[list[int]] = []
        want = []
        for s in sizes.tolist():
            best, low = None, math.inf
            for j, b in enumerate(bins):
                left = 1 - np.array([sum(b), len(b), sum(x * x for x in b)]) / caps
                item = np.array([s, 1, s * s]) / caps
                if (left - item >= -1e-12).all():
                    score = float(np.dot(packing.WEIGHTS, (left - item) ** 2)) if rule == "norm" else -float(np.dot(np.array(packing.WEIGHTS) * item, left))
                    if score < low - 1e-15:
                        best, low = j, score
            if best is None:
                best = len(bins)
                bins.append([])
            bins[best].append(s)
            want.append(best)
        assert packing.best_fit(sizes, 100, docs, cost, rule)[0].tolist() == want
    df = spark.createDataFrame([(i, "word " * int(n)) for i, n in enumerate(rng.integers(0, 90, 60))], "doc_id bigint, text string")
    plain, tight = packing.pack_documents(df, length=128), packing.pack_documents(df, length=128, max_docs=2, max_cost=5000.0)
    used = {}
    for r in tight.collect():
        used.setdefault(r.sequence_id, []).append(r.length)
    assert all(len(x) == 1 or (len(x) <= 2 and sum(n * n for n in x) <= 5000) for x in used.values())
    assert len(used) > plain.select("sequence_id").distinct().count()


def test_media_digests_are_plain_ones(spark):
    texts = [None, "", "abc", "é" * 500, "long text " * 60_000, "abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("feature", F.lit(1))
    for r in tiff.media_digests(df).collect():
        data = (texts[r.doc_id] or "").encode()
        stored = data + b"\0" * (-len(data) % 64 if data else 64)
        media = tiff.store(stored)
        image = np.frombuffer(stored, np.uint8).reshape(-1, 64).astype(float)
        p = np.bincount(image.astype(int).ravel(), minlength=256) / image.size
        down = float((np.diff(image, axis=0) ** 2).mean()) if len(image) > 1 else 0.0
        feature = [image.mean(), image.std(), -(p[p > 0] * np.log2(p[p > 0])).sum(), (np.diff(image, axis=1) ** 2).mean(), down]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and list(map(float, r.feature.split(":"))) == pytest.approx(feature, abs=2e-6)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_pages_that_claim_too_much_are_refused(compression):
    tags = [(256, 4, 60_000), (257, 4, 60_000), (258, 3, 8), (259, 3, compression), (273, 4, 8), (278, 4, 60_000), (279, 4, 4)]
    raw = b"II*\0" + struct.pack("<I", 12) + b"\x01\x02\x03\x04" + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0\0\0\0"
    with pytest.raises(ValueError):
        list(tiff.pages(raw))
    assert list(tiff.pages(tiff.encode([np.zeros((64, 64, 1), np.uint8)], compression)))[0].data.sum() == 0


def test_token_counts_are_the_attribution_of_whole_texts(spark):
    rows = [(1, "one line\nand\ttwo\n\nthree"), (None, "no key\nat all"), (3, "very long " * 30_000 + "\nend"), (1, "one line\nand\ttwo\n\nthree"), (4, None)]
    out = token_counts.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    codec, want = bpe.codec(), []
    for k, t in rows:
        data = (t or "").encode()
        _, bounds = token_counts.section_bounds([data], b"\n", "line")
        n = token_counts.attribute(*token_counts.token_spans(codec, data, codec.encode_bytes(t)), np.array(bounds)) if data else [0.0]
        want += [(-1 if k is None else k, i, x) for i, x in enumerate(n)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.section, r.n_tokens) for r in out) == sorted(want)


def test_scores_are_plain_ones():
    rng = np.random.default_rng(2)
    size, h, g = quality.SIZE, quality.HIDDEN, quality.GATES
    p = {"w1": rng.normal(size=(size, h)) / 5, "b1": rng.normal(size=h), "v": rng.normal(size=(h, g)), "u": rng.normal(size=(h, g)), "a": rng.normal(size=g), "c": rng.normal(size=h), "d": np.array(0.3)}
    m = quality.Model(rng.normal(size=size) / 9, np.ones(size), p, 0.2)
    texts = [None, "", "a few words", "many words here " * 200]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for t, s in zip(texts, quality.score(m, texts), strict=True):
        x = (quality.passages(t) - m.mean) / m.scale
        hidden = np.tanh(x @ p["w1"] + p["b1"])
        e = np.array([np.tanh(r @ p["v"]) * sigmoid(r @ p["u"]) @ p["a"] for r in hidden])
        weight = np.exp(e) / np.exp(e).sum()
        assert s == pytest.approx(sigmoid((weight[:, None] * hidden).sum(0) @ p["c"] + p["d"] + m.prior))
    t = toxicity.Model(np.unique(toxicity.slots("bad worse")), np.full(len(toxicity.slots("bad worse")), 0.25, np.float32), -1.0)
    assert toxicity.score(t, ["so bad worse", None]) == pytest.approx([sigmoid(0.25 * len(np.intersect1d(t.slots, toxicity.slots("so bad worse"))) - 1), sigmoid(-1)])


def test_one_step_of_the_optimiser():
    at = np.array([3, 8])
    m = toxicity.train([(at, 1)], 0.0, alpha=0.3, beta=1.0, l1=0.2, l2=1.0, epochs=1, least=1)
    # all weights are zero, so the score is one half and the gradient -0.5: z = -0.5, n = 0.25
    assert m.slots.tolist() == [3, 8] and m.weights == pytest.approx((0.5 - 0.2) / ((1 + 0.5) / 0.3 + 1))
    assert len(toxicity.train([(at, 1)], 0.0, l1=0.6, epochs=1, least=1).slots) == 0


def test_skip_edges_against_enumeration():
    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    f = pii.Field(rng.normal(size=(pii.SLOTS, k)), rng.normal(size=(k, k)), 0.9)
    # two chains of one variable each and a skip edge between them: a tree, so messages are exact
    g = pii.Graph(np.array([1, 2]), np.array([0, 1]), 2, np.zeros((0, 2), np.int64), np.array([[0, 1]]), np.array([True, True]), np.array([True, True]))
    own = [f.unary[s] + f.chain[0] + f.chain[:, 0] for s in (1, 2)]
    p = np.exp(own[0][:, None] + own[1][None, :] + f.skip * np.eye(k))
    p /= p.sum()
    node, _, skip = pii.marginals(f, g, 80)
    assert np.exp(node) == pytest.approx(np.stack([p.sum(1), p.sum(0)]), abs=1e-3) and skip[0] == pytest.approx(p, abs=1e-3)
    words = "x 5550001 a 5550001 b 1-555-0001 c"
    t = pii.tokens(words)
    same = lambda a, b: bool(set(pii._keys(a)) & set(pii._keys(b)))
    assert {(a, b) for a, b in t.skips} <= {(i, j) for i in range(len(t.words)) for j in range(i + 1, len(t.words)) if same(t.words[i], t.words[j])}
    assert (0, 1) in t.skips


def test_personal_data_of_odd_texts(spark):
    long = "n 12 " * 60_000 + "a@b.co"
    rows = [(1, "a@b.co 1.2.3.4 then a@b.co"), (2, long), (None, "+1 619 555 0053"), (1, "a@b.co 1.2.3.4 then a@b.co")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("clash"))
    for r, (_, t) in zip(pii.personal_data(df).collect(), rows, strict=True):
        base = pii.joined(pii.base_spans(t))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(r.spans.split(","))


def test_near_dedup_keeps_one_row_of_each_component(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(8)]
    rows = [(i, t, "mine") for i, t in enumerate(texts)] + [(100 + i, texts[i % 4].rsplit(" ", 1)[0], "mine") for i in range(6)] + [(7, texts[7], "mine"), (None, texts[1], "mine"), (300, None, "mine"), (301, "", "mine")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row string")
    f = np.array([simhash.fingerprint(t) for _, t, _ in rows], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    want = {}
    for (k, _, _), r in zip(rows, root, strict=True):
        if k is not None:
            want[r] = min(want.get(r, k), k)
    out = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(r.doc_id for r in out) == sorted(want.values()) and {r.row for r in out} == {"mine"}
    assert free_name("row", ["Row", "row_"]) == "row__"
