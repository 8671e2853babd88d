import math

import pytest
from pyspark.sql import functions as F

from inkstone.functions import boxes, fusion, numeric, signal, text
from inkstone.functions import constants as K


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("x")).first()["x"] if row else spark.range(1).select(column.alias("x")).first()["x"]


def test_previews_count_utf16_units(spark):
    assert value(spark, text.preview(F.col("t")), t=K.LETTERS[0] * 50) == K.LETTERS[0] * 40
    assert value(spark, text.js_slice(F.col("t"), 3), t="a" + K.LETTERS[0] * 2) == "a" + K.LETTERS[0]
    assert value(spark, text.js_slice(F.col("t"), 2), t="a" + K.LETTERS[0] * 2) == "a"
    assert value(spark, text.preview(F.col("t")), t=" ﻿  \n") == "—"
    assert value(spark, text.js_length(F.col("t")), t="a" + K.LETTERS[0]) == 3


def test_titles(spark):
    assert value(spark, text.display_title(F.col("t")), t="  ") == K.DEFAULT_TITLE
    assert value(spark, text.display_title(F.col("t")), t="x" * 56) == "x" * 56
    assert value(spark, text.display_title(F.col("t")), t="x" * 57) == "x" * 56 + "…"


def test_transliteration(spark):
    assert value(spark, text.to_arabic(F.col("t")), t="".join(K.LETTERS[:3]) + "|?") == "هلح ?"
    glyphs = "array(named_struct('character', '𐩠', 'display', 'h', 'isSeparator', false), named_struct('character', 'x', 'display', ' | ', 'isSeparator', true), named_struct('character', 'NUM_50', 'display', null, 'isSeparator', false))"
    assert value(spark, text.line_to_arabic(F.expr(glyphs))) == "ه ٥٠"
    assert len(K.LETTER_NAMES) == len(K.ARABIC_LETTERS) == len(K.ARABIC_NAMES) == len(K.TRANSLITERATION) == 29


@pytest.mark.parametrize("version,parts", [("1.9.0", [1, 9, 0]), ("1.10.0-beta", [1, 10, 0]), ("x.2", [0, 2, 0]), ("", [0, 0, 0]), ("3+build.4", [3, 0, 0]), ("1.2.3.4", [1, 2, 3])])
def test_versions(spark, version, parts):
    assert value(spark, text.semver(F.col("v")), v=version) == parts


def test_version_gate(spark):
    assert value(spark, text.semver(F.lit("1.9.0")) < text.semver(F.lit("1.10.0-beta"))) is True
    gate = lambda c, m, n: value(spark, text.version_status(F.lit(c), F.lit(m), F.lit(n)))
    assert [gate("1.0.0", " ", "2.0"), gate("1.0.0", "1.0.1", "2.0"), gate("1.5", "1.0", "2.0"), gate("2.0", "1.0", "")] == ["unknown", "force-update", "optional-update", "supported"]


def test_file_types(spark):
    assert value(spark, text.attachment_extension(F.lit("image/png"), F.lit("scan"))) == "scan"
    assert value(spark, text.attachment_extension(F.lit("image/png"), F.lit("a.toolongsuffix"))) == "png"
    assert value(spark, text.mime_type(F.lit("A.PNG"))) == "image/png"
    assert value(spark, text.after_comma(F.lit("data:x;base64,QUJD"))) == "QUJD" and value(spark, text.after_comma(F.lit("QUJD"))) == "QUJD"
    assert value(spark, text.group_key(F.lit("/A/Stone-1.JPG"), F.lit("c.png"))) == "stone-1"


def test_labels(spark):
    assert [value(spark, text.is_separator(F.lit(x))) for x in ("NUM_1", " | ", "num1", "NUM_2", K.SEPARATOR_CHAR)] == [True, True, True, False, True]
    assert [value(spark, text.is_readable(F.lit(x))) for x in (K.LETTERS[0], "?", "NUM_5", "|")] == [True, False, False, False]


def test_confidence_and_medians(spark):
    g = "array(named_struct('character', 'a', 'confidence', 0.5D, 'isSeparator', false), named_struct('character', 'b', 'confidence', 1.4D, 'isSeparator', false), named_struct('character', '|', 'confidence', 0.1D, 'isSeparator', true), named_struct('character', '?', 'confidence', 0.1D, 'isSeparator', false))"
    assert value(spark, numeric.average_confidence(F.expr(g))) == 75
    assert value(spark, numeric.average_confidence(F.expr(f"slice({g}, 3, 2)"))) == 0
    assert value(spark, numeric.upper_median(F.expr("array(4,1,3,2)"))) == 3
    assert value(spark, numeric.js_round(F.lit(-2.5))) == -2 and value(spark, numeric.half_even(F.lit(2.5))) == 2
    assert value(spark, numeric.array_percentile(F.expr("array(1D,2D,3D,10D)"), 0.85)) == pytest.approx(6.85)


def test_overlaps(spark):
    one = [F.lit(v) for v in (100, 140, 100, 140)]
    assert value(spark, boxes.iou(*one)) == 1.0
    assert value(spark, boxes.iou_of_ends(*one)) == pytest.approx(40 / 240)
    assert value(spark, boxes.scaled(F.lit(5), 0.5)) == 2


def test_signals(spark):
    v = [0.0] * 30
    v[10], v[12], v[20] = 0.9, 0.8, 0.7
    found = F.array(*[F.lit(x) for x in v])
    assert value(spark, signal.peaks(found)) == [10, 20]
    assert [tuple(x) for x in value(spark, signal.intervals(F.array(F.lit(1), F.lit(10)), F.lit(30)))] == [(1, 10), (10, 30)]
    w = [1.0, 5.0, 3.0, 4.0, 2.0, 6.0]
    at = F.array(*[F.lit(x) for x in w])
    assert value(spark, signal.prominence(at, F.lit(3))) == pytest.approx(1.0)
    assert value(spark, signal.prominence(at, F.lit(1))) == pytest.approx(3.0)
    assert value(spark, signal.valley_cuts(at, F.array(F.lit(1), F.lit(5)))) == [4]
    assert value(spark, signal.resample(at, 11))[:3] == [1.0, 3.0, 5.0]
    s = value(spark, signal.smooth(found, 2.0))
    assert sum(s) == pytest.approx(sum(v), rel=1e-3) and len(s) == 30


def test_votes(spark):
    vote = lambda label, score, margin=1.0: F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"), F.lit(margin).alias("margin"))
    best = lambda *v: value(spark, fusion.fused(fusion.vote_weights(*v)))
    assert best(vote("a", 0.9), vote("b", 0.6), vote("b", 0.6))["label"] == "b"
    assert best(vote("a", 0.9), vote("b", 0.6), vote("b", 0.6, 0.01))["label"] == "a"
    assert best(vote("a", 0.5), vote("NUM_5", 1.0), vote(None, 0.0))["label"] == "a"
    assert value(spark, fusion.softmax(F.array(F.lit(0.0), F.lit(math.log(3.0))))) == pytest.approx([0.25, 0.75])
