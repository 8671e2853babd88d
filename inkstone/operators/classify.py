"""Joins of features with banks of prototypes and shapes, and look-alike pairs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.functions.fusion import distance, dot, normalised, similarity, whitened

#: A bank goes to every task as one row only up to so many entries; a larger one is split into blocks of about BLOCK_ROWS.
BANK_ROWS, BLOCK_ROWS = 10_000, 1000


def _blocks(bank: DataFrame, copies: int) -> tuple[DataFrame, int]:
    """(The bank (label, x) with a block for each entry, number of blocks); a large bank keeps at most `copies` of equal entries."""
    if bank.limit(BANK_ROWS + 1).count() <= BANK_ROWS:
        return bank.withColumn("block", F.lit(0)), 1
    n = -(-bank.count() // BLOCK_ROWS)
    same = bank.groupBy("label", "x").count()
    same = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("count", F.lit(copies).cast("bigint")))))
    return same.select("label", "x", F.pmod(F.xxhash64("label", "x"), F.lit(n)).alias("block")), n


def _nearest(own: DataFrame, packed: DataFrame, n: int, scores: Column, first: Callable[[Column], Column]) -> DataFrame:
    """id, s: what `first` keeps of each feature's scores, which are made block by block and merged in two steps."""
    if n == 1:
        return own.crossJoin(F.broadcast(packed)).select("id", first(scores).alias("s"))
    # features may repeat an id
    own = own.withColumn("__row", F.monotonically_increasing_id())
    best = own.crossJoin(packed).select("__row", "id", F.pmod("block", F.lit(math.isqrt(n))).alias("part"), first(scores).alias("s"))
    for keys in (["__row", "id", "part"], ["__row", "id"]):
        best = best.groupBy(*keys).agg(first(F.flatten(F.collect_list("s"))).alias("s"))
    return best.select("id", "s")


def prototype_match(features: DataFrame, bank: DataFrame, k: int = 3) -> DataFrame:
    """id, label, similarity, margin: the nearest prototype by cosine; margin to the second (-1 if there is none).

    features: id, v; bank: label, v. Each feature's k best are kept while the bank passes by, without a shuffle of pairs
    for a small bank and with one of the k best of each block for a large one.
    """
    own = features.select("id", normalised(F.col("v")).alias("v"))
    entries, n = _blocks(bank.select("label", normalised(F.col("v")).alias("x")), k)
    list_of = F.array_sort(F.collect_list(F.struct("label", F.col("x").alias("p")))).alias("bank")
    packed = entries.groupBy().agg(list_of) if n == 1 else entries.groupBy("block").agg(list_of)
    scores = F.transform("bank", lambda b: F.struct((-dot(F.col("v"), b["p"])).alias("minus"), b["label"].alias("label")))
    best = _nearest(own, packed, n, scores, lambda s: F.slice(F.array_sort(s), 1, k))
    second = F.coalesce(-F.get("s", 1)["minus"], F.lit(-1.0))
    return best.select("id", F.get("s", 0)["label"].alias("label"), (-F.get("s", 0)["minus"]).alias("similarity"), (-F.get("s", 0)["minus"] - second).alias("margin"))


def shape_match(features: DataFrame, exemplars: DataFrame, stats: DataFrame) -> DataFrame:
    """id, label, similarity, margin: the class whose nearest exemplar is nearest, in whitened distance; 0 stands for a missing second.

    stats: one row with mean and std (arrays).
    """
    one = F.broadcast(stats.limit(1))
    own = features.crossJoin(one).select("id", whitened(F.col("v"), F.col("mean"), F.col("std")).alias("v"))
    entries, n = _blocks(exemplars.crossJoin(one).select("label", whitened(F.col("v"), F.col("mean"), F.col("std")).alias("x")), 1)
    by_label = entries.groupBy("block", "label").agg(F.collect_list("x").alias("es"))
    list_of = F.array_sort(F.collect_list(F.struct("label", "es"))).alias("bank")
    packed = by_label.groupBy().agg(list_of) if n == 1 else by_label.groupBy("block").agg(list_of)
    scores = F.transform("bank", lambda b: F.struct(F.array_min(F.transform(b["es"], lambda e: distance(F.col("v"), e))).alias("d"), b["label"].alias("label")))

    def first(s: Column) -> Column:
        """The nearest, and the nearest of another label."""
        ranked = F.array_sort(s)
        if n == 1:  # a label stands there once
            return F.slice(ranked, 1, 2)
        return F.concat(F.slice(ranked, 1, 1), F.slice(F.filter(ranked, lambda x: ~x["label"].eqNullSafe(F.get(ranked, F.lit(0))["label"])), 1, 1))

    best = _nearest(own, packed, n, scores, first)
    nearest, second = similarity(F.get("s", 0)["d"]), F.coalesce(similarity(F.get("s", 1)["d"]), F.lit(0.0))
    return best.select("id", F.get("s", 0)["label"].alias("label"), nearest.alias("similarity"), (nearest - second).alias("margin"))


def group_members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, m) for i, g in enumerate(K.SHAPE_GROUPS) for m in g], "shape_group int, label string")


def confusable(members: DataFrame) -> DataFrame:
    """a, b: different labels of one group, each pair in both orders, once."""
    other = members.select("shape_group", F.col("label").alias("b"))
    return members.select("shape_group", F.col("label").alias("a")).join(other, "shape_group").where("a <> b").select("a", "b").distinct()


def hard_partners(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([p for a, b in K.HARD_PAIRS for p in ((a, b), (b, a))], "a string, b string").distinct()


def label_dictionary(spark: SparkSession) -> DataFrame:
    """The 39 labels: index, type, character, name, codepoint, arabic_name, latin_translit, value."""
    letters = [(i, "letter", c, n, f"U+{ord(c):X}", a, t, None) for i, (c, n, a, t) in enumerate(zip(K.LETTERS, K.LETTER_NAMES, K.ARABIC_NAMES, K.TRANSLITERATION, strict=True))]
    numerals = [(29 + i, "numeral", n, n, None, a, None, v) for i, (n, (v, _, a)) in enumerate(K.NUMERALS.items())]
    return spark.createDataFrame(letters + numerals, "index int, type string, character string, name string, codepoint string, arabic_name string, latin_translit string, value int")


def rerank(candidates: DataFrame) -> DataFrame:
    """id, label, combined: candidates (id, label, proto, shape, is_hard) by .55 proto + .45 shape, hard partners that resemble get .04."""
    score = 0.55 * F.col("proto") + 0.45 * F.col("shape") + F.when(F.col("is_hard") & (F.col("proto") >= 0.62), 0.04).otherwise(0.0)
    w = Window.partitionBy("id").orderBy(F.desc("combined"), "label")
    return candidates.withColumn("combined", score).withColumn("__n", F.row_number().over(w)).where("__n = 1").select("id", "label", "combined")
