"""Operators whose work must not gather in one task or be cut."""

import pytest
from pyspark.sql import functions as F

from inkstone.operators import classify, evaluate, ranks


@pytest.mark.parametrize("positives", [0, 1, 37, 200, 600])
def test_balance_takes_the_lowest_hashes_without_a_limit(spark, positives):
    rows = spark.range(1000).selectExpr("CASE WHEN id >= 990 THEN NULL WHEN id >= 950 THEN 7 ELSE id END AS k", "id % 3 AS v", f"id < {positives} AS pos")
    out = evaluate.balance_cap(rows, "k", F.col("pos"), F.lit(False))
    want = rows.where("NOT pos").orderBy(evaluate.portable_order(F.col("k")), "k").limit(2 * positives)
    easy = out.where("NOT pos")
    assert sorted(r.k if r.k is not None else -1 for r in easy.collect()) == sorted(r.k if r.k is not None else -1 for r in want.collect())
    assert out.where("pos").count() == positives and easy.exceptAll(rows).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan


def test_large_banks_are_split_into_blocks_with_the_same_results(spark, monkeypatch):
    wave = lambda c: F.array(*[F.round(F.sin(F.col(c) * (i + 1.3)), 3) for i in range(4)])
    x = spark.range(30).select((F.col("id") % 20).alias("id"), wave("id").alias("v"))
    bank = spark.range(200).select(F.concat(F.lit("l"), (F.col("id") % 7).cast("string")).alias("label"), wave("id").alias("v"))
    bank = bank.unionByName(bank.limit(5))  # equal entries
    stats = spark.createDataFrame([([0.0] * 4, [1.0, 2.0, 1.0, 0.5])], "mean array<double>, std array<double>")
    runs = lambda: [sorted((r.id, r.label, round(r.similarity, 9), round(r.margin, 9)) for r in f.collect()) for f in (classify.prototype_match(x, bank), classify.shape_match(x, bank, stats))]
    small = runs()
    monkeypatch.setattr(classify, "BANK_ROWS", 20)
    monkeypatch.setattr(classify, "BLOCK_ROWS", 9)
    assert runs() == small
    entries, n = classify._blocks(bank.select("label", F.col("v").alias("x")), 3)
    assert n == 23 and entries.count() == 205 and entries.groupBy("block").count().agg(F.max("count")).first()[0] < 40


def test_means_are_summed_in_the_tables_order(spark, tmp_path):
    """The exact means are 45.5 and 57.5: the sum of two files' own sums falls to the other side of the half."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from inkstone.plans.suite import queries

    own = {1: [6, 4, 0, 2, 3, 5, 9, 2], 2: [5, 4, 9, 8, 1, 7, 4, 1]}
    (tmp_path / "lineitem.parquet").mkdir()
    for part in (1, 0):  # the later file is the older one
        rows = [(k, x[part * 4 + i] / 100, "N") for i in range(4) for k, x in own.items()] + [(1, 0.09, "R"), (3, 0.05, "R")]
        columns = dict(zip(("l_orderkey", "l_discount", "l_returnflag"), map(list, zip(*rows))))
        pq.write_table(pa.table(columns), tmp_path / "lineitem.parquet" / f"part-{part}.parquet", row_group_size=3)
    want = {3: None}
    for k, x in own.items():
        total = 0.0
        for d in x:
            total += min(1, d / 100 * 12)
        want[k] = int(total / 8 * 100 + 0.5)
    assert want == {1: 45, 2: 58, 3: None}
    assert {r.l_orderkey: r.confidence for r in queries()["avg_confidence_grouped"](spark, str(tmp_path)).collect()} == want


def test_means_in_order_are_sums_one_after_the_other(spark):
    values = [1e16, 1.0, None, -1e16, 1.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("none", 9, None)], "g string, i int, v double")
    for n in (1, 3, 7):
        got = {r.g: r.mean for r in ranks.means_in_order(df.repartition(n), "g", F.col("v"), ["i"]).collect()}
        assert got == {"a": 0.25, "none": None}
