"""Classification evidence as Column expressions: softmax, similarities, votes, and the rules on single glyphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.signal import let
from inkstone.functions.text import is_numeral, is_readable, is_separator


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda x: x / total)


def letters_only(logits: Column, first_numeral: int = 29) -> Column:
    """Logits with numerals out of the race."""
    return F.transform(logits, lambda x, i: F.when(i >= first_numeral, F.lit(-1e9)).otherwise(x))


def top_k(scores: Column, k: int = 3) -> Column:
    """The k largest as structs (score, index), of equal ones the first."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("minus"), i.alias("index"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: F.struct((-x["minus"]).alias("score"), x["index"].alias("index")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column, eps: float = 1e-6) -> Column:
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / (length + eps))


def whitened(v: Column, mean: Column, std: Column) -> Column:
    return F.transform(F.arrays_zip(v.alias("v"), mean.alias("m"), std.alias("s")), lambda t: (t["v"] - t["m"]) / t["s"])


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def similarity(d: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d)


def entropy(p: Column) -> Column:
    """Entropy as a share of that of a uniform distribution."""
    h = F.aggregate(F.transform(p, lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(p) > 1, h / F.log(F.size(p))).otherwise(F.lit(0.0))


def evidence(confidence: Column, margin: Column, h: Column) -> Column:
    return 0.50 * confidence + 0.30 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin / 0.35)) + 0.20 * (1 - h)


def joint_score(completeness: Column, trust: Column, separator: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.40 * completeness + 0.55 * trust + 0.05 * separator))


def paper_score(label: Column, confidence: Column) -> Column:
    return confidence * F.when(label.isNull() | label.isin("?", "UNKNOWN"), 0.15).otherwise(1.0)


def vote_weights(cnn: Column, proto: Column, shape: Column) -> Column:
    """Ranked votes of structs (label, score, margin): array of (label, weight, rank), absent ones left out.

    A numeral vote against a letter from the network counts .35; a shape vote with a margin under .05 a quarter.
    """
    scale = lambda v: F.when(~is_numeral(cnn["label"]) & is_numeral(v["label"]), 0.35).otherwise(1.0)
    weigh = lambda v, w, rank: F.struct(v["label"].alias("label"), w.cast("double").alias("weight"), F.lit(rank).alias("rank"))
    return F.filter(
        F.array(
            weigh(cnn, 0.45 * cnn["score"], 0),
            weigh(proto, 0.40 * F.greatest(proto["score"], F.lit(0.0)) * scale(proto), 1),
            weigh(shape, 0.45 * F.greatest(shape["score"], F.lit(0.0)) * scale(shape) * F.when(shape["margin"] < 0.05, 0.25).otherwise(1.0), 2),
        ),
        lambda v: v["label"].isNotNull() & (v["label"] != ""),
    )


def fused(votes: Column) -> Column:
    """The label of the largest sum of weights, of equal ones that voted for first: struct(label, trust)."""
    summed = lambda all_: F.transform(all_, lambda v: F.struct((-F.aggregate(F.filter(all_, lambda o: o["label"] == v["label"]), F.lit(0.0), lambda a, o: a + o["weight"])).alias("minus"), v["rank"].alias("rank"), v["label"].alias("label")))
    best = lambda all_: F.get(F.array_sort(summed(all_)), 0)
    return let(let(votes, best), lambda b: F.struct(b["label"].alias("label"), (-b["minus"]).alias("trust")))


def low_content(peak: Column, mean: Column, ratio: Column) -> Column:
    return (peak < 0.25) & (mean < 0.13) & (ratio < 0.45)


def ignored_candidate(low: Column, detect: Column, identify: Column, unknown: Column) -> Column:
    """Whether a stone candidate is dropped."""
    return (low & (identify < 0.55)) | ((detect < 0.70) & (identify < 0.45) & low) | (unknown & low & (detect < 0.80) & (identify < 0.55))


def stone_trusted(trusted: Column, confidence: Column, label: Column) -> Column:
    return F.coalesce(trusted, F.lit(True)) & (confidence >= 0.40) & ~F.coalesce(label.isin("?", "UNKNOWN"), F.lit(True))


def narrow_separator(width: Column, line_height: Column, label: Column) -> Column:
    return (is_separator(label) | is_numeral(label)) & (width / F.greatest(line_height, F.lit(1)) <= 0.55)


def paper_label(label: Column, aspect: Column, top: Column) -> Column:
    """A numeral becomes a separator if narrow, else the first alternative (array of labels) that is none, else unknown."""
    other = F.get(F.filter(top, lambda t: ~is_numeral(t)), 0)
    return F.when(is_numeral(label), F.when(aspect <= 0.45, F.lit("|")).otherwise(F.coalesce(other, F.lit("?")))).otherwise(F.coalesce(label, F.lit("?")))


def paper_trusted(confidence: Column, label: Column) -> Column:
    return (confidence >= 0.45) & is_readable(label)


def same_type(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (is_numeral(a) == is_numeral(b))


#: Least confidence, least similarity and least margin that are trusted.
LEAST_CONFIDENCE, LEAST_SIMILARITY, LEAST_MARGIN = 0.35, 0.45, 0.02


def verdict(cnn: Column, proto: Column, shape: Column) -> Column:
    """struct(label, trusted, trust, reason) of a network's vote and, where there are any, a prototype's and a shape's.

    Votes are structs (label, score, margin); label is null where the verdict isn't trusted. The label of the largest sum
    of weights stands first; a kind (letter or numeral) against the network's, or a weak network, changes it. The first
    reason that holds then says how far it is trusted.
    """

    def number(v: Column, name: str) -> Column:
        return F.when(v["label"].isNotNull() & (v["label"] != ""), v[name]).otherwise(0.0).cast("double")

    c, p, s = (F.nullif(v["label"], F.lit("")) for v in (cnn, proto, shape))
    cc, cm, ps, pm, ss, sm = (number(v, n) for v in (cnn, proto, shape) for n in ("score", "margin"))
    high = lambda x: F.greatest(x, F.lit(0.0))
    is_ = lambda a, b: F.coalesce(a == b, F.lit(False))
    kin = lambda a: same_type(c, a)
    pick = lambda label, trust: F.struct(label.alias("label"), trust.cast("double").alias("trust"))

    def corrected(first: Column) -> Column:
        both = is_(p, first["label"]) & is_(s, first["label"]) & (ps >= 0.78) & (ss >= 0.28) & (sm >= 0.08)
        kind = F.when(~kin(first["label"]) & (cc >= 0.22) & ~both, pick(c, 0.45 * cc + 0.15)).otherwise(pick(first["label"], first["trust"]))
        by_proto = p.isNotNull() & kin(p) & (ps >= 0.68) & (cc < 0.40) & ((pm >= 0.02) | (cc < 0.30))
        by_shape = s.isNotNull() & kin(s) & (cc < 0.40) & (sm >= 0.08) & (ss >= 0.22) & (p.isNull() | (ps < 0.82) | is_(p, s))
        firm = p.isNotNull() & ~is_(p, s) & (ps >= 0.80) & (pm >= 0.08) & kin(p)
        return F.when(by_shape & ~firm, pick(s, 0.55 * ss + 0.25 * high(ps) + 0.15)).when(by_proto, pick(p, 0.65 * ps + 0.15)).otherwise(kind)

    def reasoned(chosen: Column) -> Column:
        label, trust = chosen["label"], chosen["trust"]
        by_c, by_p, by_s, same = is_(c, label), is_(p, label), is_(s, label), kin(label)
        override = 0.65 * ps + 0.15 * high(pm) + 0.10
        structure = by_s & (ss >= 0.50) & (by_c | (sm >= 0.12))
        ladder = [
            ("cnn_proto_agree", by_p & by_c & (ps >= LEAST_SIMILARITY) & ((cc >= LEAST_CONFIDENCE) | (ps >= 0.70)), label, trust),
            ("proto_shape_agree", by_p & by_s & same & (ps >= 0.55) & ((ss >= 0.40) | ((ss >= 0.30) & (sm >= 0.10))), label, 0.50 * ps + 0.35 * ss + 0.10),
            ("shape_override", by_s & same & (sm >= 0.08) & (ss >= 0.22) & (cc < 0.40), label, 0.55 * F.greatest(ss, F.lit(0.25)) + 0.25 * sm + 0.15),
            ("prototype_override", by_p & same & (ps >= 0.65) & ((pm >= 0.015) | (cc < 0.40) | by_s), label, F.when(by_s, F.least(F.lit(0.95), override + 0.08)).otherwise(override)),
            ("shape_structure", structure & (same | by_c), label, 0.50 * ss + 0.25 * F.greatest(ps, cc) + 0.15),
            ("type_mismatch_reject", structure, None, trust * 0.4),
            ("prefer_cnn_letter_number", ~same & by_c & (cc >= 0.20), c, 0.55 * F.greatest(cc, F.lit(0.25)) + 0.25),
            ("cnn_confident", by_c & (cc >= 0.45) & (cm >= 0.08), c, 0.55 * cc + 0.2),
            ("disagree_reject", F.lit(True), None, trust * 0.5),
        ]
        steps = [F.when(test, _verdict(reason, out, value)) for reason, test, out, value in ladder]
        return F.coalesce(*steps)

    alone = (cc >= 0.55) & (cm >= LEAST_MARGIN)
    only = F.struct(F.when(alone, c).alias("label"), alone.alias("trusted"), (cc * (0.5 + 0.5 * F.least(F.lit(1.0), high(cm) / 0.2))).alias("trust"), F.lit("cnn_only").alias("reason"))
    weighed = let(let(fused(vote_weights(cnn, proto, shape)), corrected), reasoned)
    return F.when(p.isNull() & s.isNull(), only).otherwise(weighed)


def _verdict(reason: str, label: Column | None, trust: Column) -> Column:
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), trust))
    return F.struct((F.lit(None).cast("string") if label is None else label).alias("label"), F.lit(label is not None).alias("trusted"), bounded.alias("trust"), F.lit(reason).alias("reason"))
