"""Codes and codebooks against plain rounds over all vectors."""

import hashlib
import math

import numpy as np
import pytest

from inkstone.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    good = [(k, [math.floor(4096 * float(np.float32(c))) for c in v], label) for k, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    good = [(k, v + [0] * (-len(v) % parts), label) for k, v, label in good]
    if not good:
        return []
    size = len(good[0][1]) // parts
    cut = lambda v: [v[i : i + size] for i in range(0, len(v), size)]
    ordered = sorted(good, key=lambda g: (g[0] is None, g[0] or 0, [np.array(p, "<i4").tobytes() for p in cut(g[1])]))
    books = [[cut(v)[p] for _, v, _ in ordered[:entries]] for p in range(parts)]
    best = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v, _ in good:
                of.setdefault(best(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(of[e]) for c in zip(*of[e], strict=True)] if e in of else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(k, label, [best(part, books[p]) for p, part in enumerate(cut(v))]) for k, v, label in good]
    sums = {}
    for _, label, f in found:
        sums[label] = sums.get(label, 0) + sum(d for d, _ in f)
    return [(k, "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), sums[label], digest) for k, label, f in found]


def check(spark, rows, **options):
    got = [tuple(r) for r in vector_codes.compress(spark.createDataFrame(rows, SCHEMA), **options).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows, **options)))
    return got


@pytest.mark.parametrize("dim", [16, 24, 19])
def test_rounds_are_those_of_all_vectors(spark, dim):
    rng = np.random.default_rng(dim)
    centres = rng.normal(0, 1, (5, dim))
    rows = [(int(i * 7 % 300), [float(np.float32(x)) for x in centres[i % 5] + rng.normal(0, 0.3, dim)], i % 4 or None) for i in range(260)]
    got = check(spark, rows)
    assert len({r[1] for r in got}) > 50


def test_hot_values_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT", 4)  # more than a quarter of the rows is hot
    same = [0.5, -0.5, 0.25, -0.0, 0.0, 1.0, -1.0, 2.0]
    rows = [(i % 90, same, 1) for i in range(120)] + [(200 + i, [0.001 * i * (-1) ** j for j in range(8)], i % 3) for i in range(60)]
    rows += [(None, [1.0] * 8, None), (None, [2.0] * 8, None), (7, None, 1), (8, [], 1), (9, [float("nan")] * 8, 1), (10, [None] * 8, 2), (11, [float("inf")] + [0.0] * 7, 2), (12, [0.1] * 8, None)]
    assert len(check(spark, rows)) == 183
    check(spark, rows, entries=3, rounds=2)


def test_few_rows_other_columns_and_lengths(spark):
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(3, [0.5] * 8, None)])
    rows = [(1, [0.5] * 8, 1, "a"), (2, [0.5] * 16, 1, "b"), (3, [0.25] * 8, 1, "c")]
    out = vector_codes.compress(spark.createDataFrame(rows, SCHEMA + ", part string").selectExpr("*", "1 AS row", "2 AS position", "3 AS error"))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and sorted(r.vec_id for r in out.collect()) == [1, 3]


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], SCHEMA))
    with pytest.raises(ValueError, match="hex"):
        vector_codes.compress(spark.createDataFrame([], SCHEMA), entries=300)
