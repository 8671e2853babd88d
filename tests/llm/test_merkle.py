"""Trees against a plain recomputation, and proofs against the leaves they belong to."""

import hashlib
import random
import zlib

import pytest

from inkstone.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, lower=False):
    fields = [row[0], row[3], row[2], row[4], "".join(c.lower() if c.isascii() else c for c in row[1]) if lower and row[1] is not None else row[1]]
    return digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_tree(hashes, proofs):
    """Root; proofs[i] gathers (place, siblings) of leaf i."""
    at = list(range(len(proofs)))
    while len(hashes) > 1:
        for i, p in enumerate(at):
            low = p // 16 * 16
            proofs[i].append((p - low, [h for j, h in enumerate(hashes[low : low + 16]) if j + low != p]))
        at = [p // 16 for p in at]
        hashes = [digest(*hashes[i : i + 16]) for i in range(0, len(hashes), 16)]
    return hashes[0]


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    subs, own = [], []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        ranked = sorted(groups[source], key=lambda g: g[:3])
        proofs = [[] for _ in ranked]
        subs.append(plain_tree([g[2] for g in ranked], proofs))
        own.append((ranked, proofs))
    tops = [[] for _ in subs]
    root = plain_tree(subs, tops)
    out = []
    for (ranked, proofs), sub, top in zip(own, subs, tops, strict=True):
        for (_, _, leaf, row), proof in zip(ranked, proofs, strict=True):
            proof = proof + top
            changed = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 5 == 0
            up = plain_leaf(row, True) if changed else leaf
            for slot, siblings in proof:
                up = digest(*siblings[:slot], up, *siblings[slot:])
            out.append((row[0], leaf, sub, root, digest(*(s for _, x in proof for s in x)), up, up == root))
    return out


def check(spark, rows, parts=3):
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))
    return got


@pytest.mark.parametrize("sizes", [[1], [17], [16, 1, 2], [300, 1, 5, 33], [1] * 40])
def test_trees_of_all_heights(spark, sizes):
    rows = [(1000 * s + i, f"Text {i}" if i % 3 else f"text {i}", "en", f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    got = check(spark, rows)
    assert any(r[6] for r in got) or len(got) < 5


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(7, None, None, None, None), (None, "A", "é", None, 1), (None, "A", "é", None, 1), (7, "ÀB", "en", "", 2), (7, "ÀB", "en", "", 2), (8, "", "", "é", 0), (9, "Long " * 200_000, "en", "z", 5), (10, "x", "en", "z", None)]
    rows += [(20, "same", "de", "z", 4)] * 70
    got = check(spark, rows)
    assert len(got) == len(rows) and not all(r[6] for r in got)


def test_proofs_fold_to_the_root(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({}).selectExpr("*", "1 AS tree", "2 AS pos", "3 AS key", "'x' AS hash", "4 AS n")
    got = merkle.manifest(docs, proofs=True).collect()
    for r in got:
        assert merkle.fold(bytes.fromhex(r.leaf), bytes(r.proof)).hex() == r.root
        assert merkle.proof_digest(bytes(r.proof)) == r.proof_sha256
        assert merkle.fold(hashlib.sha256(b"other").digest(), bytes(r.proof)).hex() != r.root
    assert len(got) == 120 and docs.columns[-1] == "n"


def test_an_empty_table(spark):
    out = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_places_do_not_depend_on_partitions(spark):
    rows = [(i // 3, f"t{i % 2}", "en", "hot" if i % 3 else "s", 1) for i in range(90)]
    assert sorted(check(spark, rows, 1), key=str) == sorted(check(spark, rows, 9), key=str)
