import re

import numpy as np
import pytest
import xxhash

from inkstone.llm import embedding_dedup, simhash
from inkstone.llm.common import Kept
from inkstone.llm.components import components
from inkstone.llm.tiles import forest


def roots(n, links):
    p = list(range(n))

    def find(a):
        while p[a] != a:
            a = p[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in (None, "", "  \n", "One", "one two", "A b C d É f", "x " * 10_000, "a\x1cb c d e", "tie tie", "the of and to in a is"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint("") == 0


def test_near_pairs_are_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(4)]])
    a, b = simhash.near_pairs(x, 2, block=16)
    want = {(i, j) for i in range(len(x)) for j in range(i) if bin(int(x[i] ^ x[j])).count("1") <= 2}
    assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())} == want


def test_forest():
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (50, 30), (200, 150), (300, 600)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        assert forest(n, a, b).tolist() == roots(n, zip(a.tolist(), b.tolist()))


def test_components(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 400)]
    noise = [tuple(map(int, rng.integers(1000, 1400, 2))) for _ in range(250)]
    edges = chain + star + noise + [(5, 5), (9, None)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df, Kept(spark)).collect()}
    want = roots(1500, [e for e in edges if None not in e])
    assert got == {n: want[n] for e in edges if None not in e and e[0] != e[1] for n in e}
    assert components(df.limit(0), Kept(spark)).count() == 0


@pytest.mark.parametrize("tile", [4096, 3])
def test_groups_of_near_copies(spark, tile):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + 10 * i + j, t.rsplit(" ", j)[0]) for i, t in enumerate(texts[:6]) for j in range(1, 9)]
    rows += [(900, None), (901, ""), (902, "  "), (3, texts[3]), (950, texts[3].upper()), (None, texts[4])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS fp", "1 AS component")
    out = simhash.near_duplicates(df, tile=tile).collect()
    assert len(out) == len(rows)
    f = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    root = roots(len(rows), zip(*[x.tolist() for x in np.nonzero(near)]))
    smallest = {}
    for (k, _), r in zip(rows, root):
        if k is not None:
            smallest[r] = min(smallest.get(r, k), k)
    want = sorted(((k if k is not None else -1), "%016x" % int(x), smallest.get(r)) for (k, _), x, r in zip(rows, f, root))
    assert want == sorted(((r.doc_id if r.doc_id is not None else -1), r.fingerprint, r.component_id) for r in out)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [2048, 5])
def test_embeddings_against_all_pairs(spark, tile):
    rng = np.random.default_rng(5)
    base = embedding_dedup.unit_rows(rng.normal(size=(60, 16)))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(25):  # around one centre, some over and some under the limit
        rows.append((200 + i, (base[0] + rng.normal(size=16) * 0.08).tolist()))
    rows += [(400 + i, base[1].tolist()) for i in range(30)] + [(500, (3 * base[1]).tolist()), (501, (base[2] * 2 + 0.1).tolist())]
    bad = [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [None] * 16), (605, [float("inf")] + [1.0] * 15), (606, [1.0] * 8), (607, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad + [(1, base[1].tolist())], "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS id", "2 AS links")
    everything = rows + [(1, base[1].tolist())]
    x = embedding_dedup.unit_rows(np.array([v for _, v in everything]))
    near = x @ x.T >= 0.9 - 1e-12
    np.fill_diagonal(near, False)
    root = roots(len(x), zip(*[z.tolist() for z in np.nonzero(near)]))
    low = {}
    for (k, _), r in zip(everything, root):
        low[r] = min(low.get(r, k), k)
    want = [(k, int(near[i].sum()), low[root[i]], k == low[root[i]]) for i, (k, _) in enumerate(everything)]
    want += [(k, int(k >= 606), 606 if k >= 606 else k, k != 607) for k, _ in bad]
    out = embedding_dedup.near_duplicates(df, tile=tile)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    exact = embedding_dedup.near_duplicates(df, tile=tile, recall=1.0)
    assert sorted(map(tuple, exact.collect())) == sorted(want)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_hadamard_and_recall():
    rng = np.random.default_rng(6)
    h = embedding_dedup.hadamard(np.eye(8))
    assert (h @ h.T == 8 * np.eye(8)).all()
    x, y = embedding_dedup.pairs_at(0.9, 64, 50)
    assert (x * y).sum(1) == pytest.approx(0.9) and (y * y).sum(1) == pytest.approx(1)


@pytest.mark.parametrize(("dim", "width"), [*((64, w) for w in range(1, 7)), (2, 5), (4, 5), (16, 4), (128, 4), (256, 3)])
def test_recall_does_not_fall_with_the_number_of_vectors(dim, width):
    own, tables, probes = embedding_dedup.reach(width, dim)
    assert own == width or dim < 16
    a, b = embedding_dedup.pairs_at(0.9, dim, 1500, seed=9)
    ca, cb = embedding_dedup.buckets(a, own, tables, probes), embedding_dedup.buckets(b, own, tables, probes)
    assert np.mean([bool(np.intersect1d(x, y).size) for x, y in zip(ca, cb)]) >= 0.99


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("dim", [1, 2, 3])
def test_few_dimensions_and_extreme_lengths(spark, dim, kind):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(120, dim)).astype(np.float32).astype(float)
    scale = np.array([1e-30, 1.0, 1e30]) if kind == "float" else np.array([1e-200, 1.0, 1e200])
    x = x * scale[rng.integers(0, 3, 120)][:, None]
    if kind == "float":
        x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id bigint, embedding array<{kind}>")
    out = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    u = embedding_dedup.unit_rows(x)
    cos = u @ u.T
    near = cos >= 0.9
    assert not ((cos > 0.9 - 1e-9) & (cos < 0.9 + 1e-9)).any()
    np.fill_diagonal(near, False)
    root = roots(120, zip(*[z.tolist() for z in np.nonzero(near)]))
    assert out == {i: (int(near[i].sum()), root[i]) for i in range(120)}


def test_cosine_of_exactly_the_limit_is_a_link(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, cosine=0.6).collect()}
    assert out == {1: 1, 2: 1, 3: 0}


def test_components_that_do_not_settle_are_an_error(spark):
    df = spark.range(64).selectExpr("id AS a", "id + 1 AS b")
    with pytest.raises(RuntimeError):
        components(df, Kept(spark), rounds=1)
