from pyspark.sql import functions as F

from inkstone.functions import segments

SCORES = "width int, activity_mean double, activity_peak double, edge_peak double, column_coherence double, row_coherence double, object_mean double, object_peak double"


def test_empty_segments(spark):
    lit = (20, 0.5, 0.9, 2.0, 3.0, 3.0, 0.9, 0.9)
    silent = (20, 0.01, 0.1, 0.01, 1.0, 1.0, 0.1, 0.1)
    glow = (20, 0.01, 0.1, 0.5, 1.0, 1.0, 0.6, 0.9)  # no activity, but the objectness fires
    margin = (20, 0.2, 0.5, 1.0, 1.2, 1.2, 0.5, 0.6)
    stem = (5, 0.2, 0.5, 1.0, 1.2, 1.2, 0.5, 0.6)
    df = spark.createDataFrame([([lit, silent, glow, margin, lit], 60), ([margin, lit, margin], 60), ([stem, lit, stem], 60)], f"s array<struct<{SCORES.replace(' ', ':').replace(',:', ',')}>>, h int")
    assert [len(r.k) for r in df.select(segments.kept_segments(F.col("s"), F.col("h")).alias("k")).collect()] == [4, 1, 3]


def test_best_view(spark):
    pick = lambda a, b: spark.createDataFrame([(a, b)], "a struct<label:string,confidence:double>, b struct<label:string,confidence:double>").select(segments.best_view(F.col("a"), F.col("b")).alias("x")).first().x["label"]
    assert pick(("a", 0.3), ("b", 0.9)) == "b" and pick(("a", 0.9), ("b", 0.3)) == "a" and pick(("a", 0.5), None) == "a"
    assert pick(("a", 0.08), ("NUM_5", 0.99)) == "a" and pick(("NUM_5", 0.24), ("b", 0.20)) == "b" and pick(("NUM_5", 0.9), ("b", 0.5)) == "NUM_5"
    assert pick(("a", 0.05), ("NUM_5", 0.7)) == "NUM_5" and pick(("a", 0.05), ("NUM_5", 0.5)) == "a"


def test_corridors_and_shapes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    cuts = F.array(*[F.lit(i) for i in (10, 20, 30, 40, 50)])
    flags = lambda *f: F.array(*[F.lit(x) for x in f])
    assert one(segments.corridor_cuts(cuts, F.lit(60), flags(False, True, False, False, True, False))) == [30]
    assert one(segments.corridor_cuts(cuts, F.lit(60), flags(True, True, True, True, True, True))) == [10, 20, 30, 40, 50]
    assert one(segments.corridor_cuts(cuts, F.lit(60), flags(False, False, False, True, False, False))) == []
    wave = F.array(*[F.lit(x) for x in (0.0, 0.9, 0.1, 0.1, 0.1, 0.1, 0.8, 0.0)])
    assert one(segments.two_lobes(wave, F.lit(40))) is True and one(segments.two_lobes(wave, F.lit(90))) is False
    assert one(segments.dense_packing(F.array(*[F.lit(9)] * 6), F.lit(50))) is True and one(segments.dense_packing(F.array(*[F.lit(9)] * 5), F.lit(50))) is False
