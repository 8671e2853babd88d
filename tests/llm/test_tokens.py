import hashlib
import os
import random
import time
import zlib

import numpy as np
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from inkstone.llm import bpe, packing, token_counts  # noqa: E402

WORDS = ["the", " of", "  and", "\n\n", "\tx", "it's", "I'll", "'re", "naïve", "中文字", "\U0001f600", "́", "123", "4567", "!!!", "<|endoftext|>", "Straße", " ", "　", "\x1c", "\x85", "Ꟛ", "a" * 300, "\U00013460", "ͅ"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public.path(bpe.DEFAULT))


def texts(n=300, seed=1):
    rng = random.Random(seed)
    return ["", " ", "\n", *("".join(rng.choice(WORDS) + rng.choice(["", " ", ""]) for _ in range(rng.randint(1, 40))) for _ in range(n))]


@pytest.mark.parametrize("codec", [bpe.codec, bpe.merging])
def test_ids_are_the_librarys(library, codec):
    own = codec()
    for t, e in zip(texts(), library.encode_batch(texts(), add_special_tokens=False), strict=True):
        assert own.encode(t) == e.ids
        assert own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False) == t


def test_every_prefix_has_one_last_token():
    own = bpe.codec()
    for piece in (" international", "ththonble", "aaaaaaaaaaa", "ümläut"):
        data = piece.encode()
        last = own.last_tokens(data)
        for end in range(1, len(data) + 1):
            fits = [t for n in range(1, end + 1) if (t := own.vocab.get(data[end - n : end])) is not None and own.whole[t] and (n == end or own.compatible(last[end - n], t))]
            assert fits == [last[end]]


def test_caches_stay_bounded():
    c = bpe.Cache(len, 10)
    assert [c["x" * i] for i in range(50)] == list(range(50)) and len(c) <= 10 and len(c.old) <= 10


def test_codec_columns(spark, library):
    rows = [(1, "the end", "x"), (2, None, "y"), (3, "", "z"), (1, "the end", "x"), (None, "a b", "w"), (5, "very long " * 30_000, "v")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.digests(df).collect()
    assert len(out) == 6
    for r, (_, t, _x) in zip(out, rows, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert [r.decoded for r in bpe.encode_decode(df).collect()] == [t or "" for _, t, _x in rows]
    assert bpe.digests(df.limit(0)).count() == 0


def test_token_spans_are_the_librarys(library):
    codec = bpe.codec()
    for t in texts(60, 2):
        if not t or "<|" in t:
            continue
        data = t.encode()
        starts, ends = token_counts.token_spans(codec, data, codec.encode_bytes(t))
        a, b = token_counts.character_spans(data, starts, ends)
        assert list(zip(a.tolist(), b.tolist())) == library.encode(t, add_special_tokens=False).offsets


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_against_brute_force(library, rule):
    codec = bpe.codec()
    for t in texts(60, 3):
        if not t:
            continue
        data = t.encode()
        _, bounds = token_counts.section_bounds([data], b"\n", "line")
        got = token_counts.attribute(*token_counts.token_spans(codec, data, codec.encode_bytes(t)), np.array(bounds), rule)
        section = [sum(b <= i for b in bounds) for i in range(len(data))]
        want, at = np.zeros(len(bounds)), 0
        for i in codec.encode(t):
            own = section[at : at + len(codec.token[i])]
            at += len(own)
            counts = {s: own.count(s) for s in sorted(set(own))}
            if rule == "start":
                want[own[0]] += 1
            elif rule == "majority":
                want[max(counts, key=lambda s: (counts[s], -s))] += 1
            else:
                for s, n in counts.items():
                    want[s] += n / len(own)
        assert got == pytest.approx(want)


def test_token_counts_columns(spark):
    df = spark.createDataFrame([(1, "ab\ncd\n", "t"), (2, None, None), (3, "", "x\ny")], "doc_id bigint, text string, section string")
    out = token_counts.token_counts(df).collect()
    assert [(r.doc_id, r.section, r.start, r.end) for r in out] == [(1, 0, 0, 3), (1, 1, 3, 6), (2, 0, 0, 0), (3, 0, 0, 0)]
    fields = token_counts.token_counts(df, ("text", "section"), "field").collect()
    assert [(r.doc_id, r.field, r.start, r.end) for r in fields][:2] == [(1, "text", 0, 7), (1, "section", 7, 8)] and len(fields) == 6
    assert token_counts.token_counts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(df, rule="other")


def test_pieces():
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_bins_keep_every_capacity(rule):
    rng = np.random.default_rng(4)
    sizes = np.sort(rng.integers(1, 101, 500))[::-1]
    for docs, cost in ((None, None), (3, None), (None, 4000), (4, 5000)):
        bins, offsets = packing.best_fit(sizes, 100, docs, cost, rule)
        for b in range(bins.max() + 1):
            own = np.flatnonzero(bins == b)
            assert sizes[own].sum() <= 100 and (docs is None or len(own) <= docs) and (cost is None or len(own) == 1 or (sizes[own] ** 2).sum() <= cost)
            order = own[np.argsort(offsets[own])]
            assert offsets[order].tolist() == [0, *np.cumsum(sizes[order])[:-1]]
    bins, _ = packing.best_fit(sizes, 100, rule="norm")
    assert bins.max() + 1 <= np.ceil(sizes.sum() / 100) * 1.02 + 1
    assert len(packing.best_fit(np.array([], int))[0]) == 0


def test_packing_whole_documents(spark, library):
    rows = [(i, "word " * n, i) for i, n in enumerate([0, 1, 5, 2046, 2047, 2048, 5000, 3, 3, 700, 700])] + [(1, "word ", 9), (None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece int")
    out = packing.pack_documents(df, group=4).collect()
    ids = {(k, t): [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t, _ in rows}
    whole = sorted((k is not None, k or 0, s, n, zlib.crc32(np.array(i[s : s + n], "<u4").tobytes())) for k, t, _ in rows for i in [ids[k, t]] for s, n in packing.cut(len(i)))
    assert whole == sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.length, r.ids_crc32) for r in out)
    for s in {r.sequence_id for r in out}:
        own = sorted((r.offset, r.length) for r in out if r.sequence_id == s)
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 2048
    assert packing.pack_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("rule", ["start", "majority", "split"])
def test_attribution_is_that_of_each_token_alone(rule):
    rng = np.random.default_rng(2)
    for _ in range(30):
        sections, tokens = rng.integers(1, 7, 40), rng.integers(1, 9, 60)
        n = min(sections.sum(), tokens.sum())
        bounds, ends = (np.unique(np.minimum(np.cumsum(x), n)) for x in (sections, tokens))
        starts = np.concatenate([[0], ends[:-1]])
        want = np.zeros(len(bounds))
        for a, b in zip(starts, ends, strict=True):
            share = [max(0, min(b, hi) - max(a, lo)) for lo, hi in zip([0, *bounds[:-1]], bounds, strict=True)]
            if rule == "split":
                want += np.array(share) / (b - a)
            else:
                want[np.flatnonzero(share)[0] if rule == "start" else int(np.argmax(share))] += 1
        assert token_counts.attribute(starts, ends, bounds, rule) == pytest.approx(want)


def test_millions_of_blank_lines_take_seconds():
    n = 2_000_000
    bounds = np.arange(1, 2 * n + 1)  # every byte a line
    ends = np.arange(2, 2 * n + 1, 2)
    began = time.process_time()
    got = token_counts.attribute(ends - 2, ends, bounds)
    assert got.sum() == n and time.process_time() - began < 20
