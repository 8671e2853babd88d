"""Rules on the profile of a line (activity, boundary strength) and on the widths of its parts, as Column expressions.

Profiles are array<double>, one value for each column of a line; edges and cuts are array<int> in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.functions.numeric import array_mean, array_percentile
from inkstone.functions.signal import let, near_max, span


def _median(values: Column) -> Column:
    return array_percentile(values, 0.5)


def _peak(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0.0))


def _mean(values: Column) -> Column:
    return F.coalesce(array_mean(values), F.lit(0.0))


def _part(height: Column, share: float, least: int) -> Column:
    """A share of a line's height in whole columns, at least `least`."""
    return F.greatest(F.lit(least), F.floor(height * F.lit(share)).cast("int"))


def widths(edges: Column) -> Column:
    n = F.greatest(F.lit(0), F.size(edges) - 1)
    return F.zip_with(F.slice(edges, 1, n), F.slice(edges, 2, n), lambda a, b: (b - a).cast("double"))


def pitch_of_edges(edges: Column, height: Column) -> Column:
    """Median width of the parts that look like letters (.35 to 1.15 of the height), else of those of .25 up, if two or more; else .55 of the height, 18 at least."""
    h = height.cast("double")
    fallback = F.greatest(F.lit(18.0), 0.55 * h)

    def of(w: Column) -> Column:
        letters = F.filter(w, lambda x: x.between(0.35 * h, 1.15 * h))
        strong = F.filter(w, lambda x: x >= 0.25 * h)
        return F.when(F.size(letters) >= 2, _median(letters)).when(F.size(strong) >= 2, _median(strong)).otherwise(fallback)

    return F.when((F.size(edges) < 2) | (h <= 0), fallback).otherwise(let(widths(edges), of))


def span_ink(activity: Column, lo: Column, hi: Column) -> Column:
    """mean, peak and carved (mean of .10 or peak of .35) of a span; an empty one has none."""
    return let(span(activity, lo, hi), lambda s: F.struct(_mean(s).alias("mean"), _peak(s).alias("peak"), ((_mean(s) >= 0.10) | (_peak(s) >= 0.35)).alias("carved")))


def content(magnitudes: Column) -> Column:
    """edge_peak (92nd percentile), edge_mean, and edge_ratio (share above .10) of a crop's gradient magnitudes."""
    strong = F.size(F.filter(magnitudes, lambda m: m > 0.10)) / F.size(magnitudes)
    return F.struct(array_percentile(magnitudes, 0.92).alias("edge_peak"), array_mean(magnitudes).alias("edge_mean"), strong.alias("edge_ratio"))


def segment_scores(magnitudes: Column, activity: Column | None = None, objectness: Column | None = None) -> Column:
    """Scores of a segment from its gradient magnitudes (rows of columns) and the line's profiles over its columns.

    Coherence is the largest over the mean energy of columns or rows. A profile that is missing or empty counts as 1.
    """
    rows = F.transform(magnitudes, array_mean)
    n = F.size(F.get(magnitudes, 0))
    cols = F.transform(F.sequence(F.lit(0), n - 1), lambda i: array_mean(F.transform(magnitudes, lambda r: F.get(r, i))))
    coherence = lambda e: F.array_max(e) / (array_mean(e) + 1e-6)
    one = F.array(F.lit(1.0))
    usual = lambda p: one if p is None else F.when(F.size(F.coalesce(p, F.array().cast("array<double>"))) > 0, p).otherwise(one)
    a, o = usual(activity), usual(objectness)
    return F.struct(
        array_percentile(F.flatten(magnitudes), 0.92).alias("edge_peak"), let(cols, coherence).alias("column_coherence"), let(rows, coherence).alias("row_coherence"),
        array_mean(a).alias("activity_mean"), F.array_max(a).alias("activity_peak"), array_mean(o).alias("object_mean"), F.array_max(o).alias("object_peak"), n.cast("double").alias("width"),
    )


def density_box(rows: Column, cols: Column, row_share: float = 0.08, col_share: float = 0.06) -> Column:
    """x0, y0, x1, y1 around rows and columns of enough density, null if there is none or it is at most 8 high or wide.

    Enough is .55 of the 88th percentile, but row_share and col_share at least; if no row or no column has it, .65 of
    that will do, half the shares at least, and any size. Sides under 4 have no box.
    """
    enough = lambda d, share: F.greatest(F.lit(share), array_percentile(d, 0.88) * 0.55)

    def ends(d: Column, least: Column) -> Column:
        at = lambda limit: F.filter(F.transform(d, lambda v, i: F.when(v >= limit, i)), lambda i: i.isNotNull())
        return let(let(least, at), lambda found: F.struct(F.array_min(found).alias("lo"), (F.array_max(found) + 1).alias("hi")))

    box = lambda x, y: F.when(x["lo"].isNotNull() & y["lo"].isNotNull(), F.struct(x["lo"].alias("x0"), y["lo"].alias("y0"), x["hi"].alias("x1"), y["hi"].alias("y1")))
    both = lambda limit: F.struct(ends(cols, limit(cols, col_share)).alias("x"), ends(rows, limit(rows, row_share)).alias("y"))
    loose = let(both(lambda d, share: F.greatest(F.lit(share * 0.5), enough(d, share) * 0.65)), lambda e: box(e["x"], e["y"]))

    def of(e: Column) -> Column:
        x, y = e["x"], e["y"]
        tight = F.when((x["hi"] - x["lo"] > 8) & (y["hi"] - y["lo"] > 8), box(x, y))
        return F.when(x["lo"].isNull() | y["lo"].isNull(), loose).otherwise(tight)

    return F.when((F.size(rows) >= 4) & (F.size(cols) >= 4), let(both(enough), of))


def band_score(vertical: Column, horizontal: Column, edge_peak: Column, edge_mean: Column, col_peak: Column, col_std: Column) -> Column:
    """How much a band looks like letters: bias to upright strokes, strong edges, structured columns."""
    return 0.35 * F.least(F.lit(1.5), vertical / (horizontal + 1e-6)) + 0.30 * F.least(F.lit(1.0), edge_peak / (edge_mean + 1e-6) / 4.0) + 0.20 * col_peak + 0.15 * F.least(F.lit(1.0), col_std * 3.0)


def column_weights(boundary: Column, inside: Column, boxes: Column, real: bool = False, sigma: float = 2.5) -> Column:
    """Weight of each column in a loss: cuts and bodies count more, and bumps stand where letters (lo, hi) nearly touch; 1 to 40."""
    n = F.size(boundary)
    b, o = (14.0, 12.0) if real else (10.0, 5.0)
    base = F.zip_with(boundary, inside, lambda x, y: 1.0 + b * x + o * y * (1.0 - x))
    near = F.greatest(F.lit(3), F.floor(0.08 * F.greatest(F.lit(8.0), n / 12)).cast("int"))
    k = F.greatest(F.lit(0), F.size(boxes) - 1)
    seams = F.zip_with(F.slice(boxes, 1, k), F.slice(boxes, 2, k), lambda p, q: F.struct((0.5 * (p["hi"] + q["lo"])).alias("at"), F.when(q["lo"] - p["hi"] <= 2, 10.0).when(q["lo"] - p["hi"] <= near, 6.0).otherwise(0.0).alias("height")))

    def weights(s: Column) -> Column:
        bump = lambda i: F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x["height"] * F.exp(-0.5 * F.pow((i - x["at"]) / F.lit(sigma), F.lit(2))))
        return F.transform(base, lambda w, i: F.greatest(F.lit(1.0), F.least(F.lit(40.0), w + bump(i))))

    return let(seams, weights)


def word_separator_box(width: Column, height: Column, pitch: Column, left: Column, right: Column, narrow: float = 0.24) -> Column:
    """Whether a thin stem between two full letters separates words: both neighbours of .42 of the pitch, and narrow itself (a share of the height)."""
    full = F.coalesce((height > 0) & (pitch > 0) & (left >= 0.42 * pitch) & (right >= 0.42 * pitch), F.lit(False))
    share = width / height
    return full & ((width <= 0.32 * pitch) | (share <= narrow) | ((width <= 0.55 * F.least(left, right)) & (share <= 0.30)))


def rescued_segment(scores: Column, height: Column, confidence: Column) -> Column:
    """Whether a segment marked empty stays: a carved narrow stem, or a sure one with objectness or strokes."""
    stem = (height > 0) & scores["width"].between(F.lit(2), _part(height, 0.28, 4)) & (scores["activity_peak"] >= 0.40) & (scores["activity_mean"] >= 0.12)
    sure = (scores["object_mean"] >= 0.70) | (scores["object_peak"] >= 0.85) | ((scores["edge_peak"] >= 0.20) & (scores["activity_peak"] >= 0.35))
    return stem | ((confidence >= 0.85) & sure)


def active_cuts(cuts: Column, activity: Column, height: Column, least: float = 0.18, strength: Column | None = None) -> Column:
    """Cuts inside a line with strokes on both sides (or on the inner one, at a margin), or of a boundary strength of .48."""
    n, band = F.size(activity), _part(height, 0.22, 6)

    def keep(c: Column) -> Column:
        left, right = _peak(span(activity, F.greatest(F.lit(0), c - band), c)), _peak(span(activity, c, F.least(n, c + band)))
        margin = ((c <= band + 2) & (right >= least)) | ((n - c <= band + 2) & (left >= least))
        strong = F.coalesce(F.get(strength, c) >= 0.48, F.lit(False)) if strength is not None else F.lit(False)
        return (c > 0) & (c < n) & (strong | (F.least(left, right) >= least) | margin)

    return F.array_sort(F.filter(cuts, keep))


def deep_valley(activity: Column, cut: Column, height: Column) -> Column:
    """Whether a cut stands in a blank gutter between strokes."""
    n, pad = F.size(activity), _part(height, 0.03, 2)
    mid = _mean(span(activity, F.greatest(F.lit(0), cut - pad), F.least(n, cut + pad + 1)))
    left, right = _mean(span(activity, F.greatest(F.lit(0), cut - 3 * pad), cut)), _mean(span(activity, cut, F.least(n, cut + 3 * pad)))
    return (cut > 0) & (cut < n) & (mid < 0.08) & (F.least(left, right) >= 0.16)


def absorbed_slivers(boxes: Column, activity: Column, height: Column) -> Column:
    """Boxes (lo, hi, score) of a line, where a sliver that touches a body without a valley between them joins it."""
    sliver, body, last = _part(height, 0.10, 3), _part(height, 0.20, 6), F.size(activity) - 1

    def glued(a: Column, b: Column) -> Column:
        w, v = a["hi"] - a["lo"], b["hi"] - b["lo"]
        seam = F.greatest(F.lit(0), F.least(last, F.floor((a["hi"] + b["lo"]) / 2).cast("int")))
        inked = F.get(activity, seam) > 0.50 * (_peak(span(activity, a["lo"], b["hi"])) + 1e-6)
        return (b["lo"] - a["hi"] <= 2) & (F.least(w, v) <= sliver) & (F.greatest(w, v) >= body) & inked

    box = lambda b, whole: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), b["score"].cast("double").alias("score"), whole.alias("whole"))

    def step(out: Column, b: Column) -> Column:
        before = F.element_at(out, -1)  # one that was made of two takes in no third
        joined = F.struct(before["lo"].alias("lo"), b["hi"].alias("hi"), F.greatest(before["score"], b["score"].cast("double")).alias("score"), F.lit(True).alias("whole"))
        return F.when((F.size(out) > 0) & ~before["whole"] & glued(before, b), F.concat(F.slice(out, 1, F.greatest(F.lit(0), F.size(out) - 1)), F.array(joined))).otherwise(F.concat(out, F.array(box(b, F.lit(False)))))

    first = F.array().cast("array<struct<lo:int,hi:int,score:double,whole:boolean>>")
    return F.transform(F.aggregate(boxes, first, lambda out, b: F.when(F.size(out) == 0, F.array(box(b, F.lit(False)))).otherwise(step(out, b))), lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi"), b["score"].alias("score")))


def wide_split(lo: Column, hi: Column, columns: Column, median: Column, ratio: float = 1.55) -> Column:
    """A box as one or two intervals: a box wider than `ratio` medians is cut where its columns hold least ink, away from its ends."""
    n = hi - lo
    margin = F.greatest(F.lit(2), F.floor(0.15 * n).cast("int"))
    inner = F.slice(columns, margin + 1, F.greatest(F.lit(0), n - 2 * margin))
    at = (F.array_position(inner, F.array_min(inner)) - 1).cast("int") + margin
    split = (n > median * F.lit(ratio)) & (_peak(columns) > 0) & (F.size(inner) >= 4) & (at >= 6) & (n - at >= 6)
    part = lambda a, b: F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi"))
    return F.when(F.coalesce(split, F.lit(False)), F.array(part(lo, lo + at), part(lo + at, hi))).otherwise(F.array(part(lo, hi)))


def stem_triple(edges: Column, i: Column, height: Column, activity: Column, singles: Column, merged: Column) -> Column:
    """Score of three thin stems from edge i on as one glyph, null where they aren't one; singles: scores of the three parts."""
    part = lambda k: (F.get(edges, i + k + 1) - F.get(edges, i + k)) / height
    thin = part(0).between(0.14, 0.34) & part(1).between(0.14, 0.34) & part(2).between(0.14, 0.34)
    whole = (F.get(edges, i + 3) - F.get(edges, i)) / height
    inked = _mean(span(activity, F.get(edges, i), F.get(edges, i + 3))) >= 0.18
    good = (height > 0) & thin & whole.between(0.48, 0.95) & (F.array_min(singles) >= 0.50) & (merged < F.array_max(singles) + 0.05) & inked
    return F.when(F.coalesce(good, F.lit(False)), array_mean(singles))


def is_numeral_or_separator(label: Column) -> Column:
    t = F.upper(F.trim(label))
    return F.coalesce(t.startswith("NUM_") | t.isin("1", K.BAR, "WORD_SEPARATOR"), F.lit(False))


def is_letter(label: Column, letter: str) -> Column:
    """Whether a label is a letter of K.LABELS_OF, as its sign or by one of its names."""
    sign, *names = K.LABELS_OF[letter]
    t = F.trim(label)
    return F.coalesce((t == sign) | F.upper(t).isin(*names), F.lit(False))


def is_round(label: Column) -> Column:
    return F.coalesce(label.isin(*K.ROUND_LETTERS), F.lit(False))


def is_stem_body(label: Column) -> Column:
    return is_letter(label, "mem") | is_letter(label, "heth")


def expanded_peak(values: Column, peak: Column, share: float = 0.22) -> Column:
    """lo, hi (exclusive) around a peak, as far as samples hold `share` of it, .12 at least."""
    low = lambda floor: F.filter(F.transform(values, lambda v, i: F.when(v < floor, i)), lambda i: i.isNotNull())

    def of(p: Column) -> Column:
        before, after = lambda found: F.array_max(F.filter(found, lambda i: i < p)), lambda found: F.array_min(F.filter(found, lambda i: i > p))
        ends = lambda found: F.struct(F.coalesce(before(found) + 1, F.lit(0)).alias("lo"), F.coalesce(after(found), F.size(values)).alias("hi"))
        return let(let(F.greatest(F.lit(0.12), F.lit(share) * F.get(values, p)), low), ends)

    return let(peak, of)


def valley(values: Column, lo: Column, hi: Column) -> Column:
    """The first lowest index of [lo, hi) within the signal; lo where there is no more than one."""
    a, b = F.greatest(F.lit(0), lo).cast("int"), F.least(F.size(values), hi).cast("int")
    part = span(values, a, b)
    return F.when(b <= a + 1, a).otherwise((a + F.array_position(part, F.array_min(part)) - 1).cast("int"))


def valley_bands(values: Column, found: Column) -> Column:
    """A band (lo, hi) for each peak, cut in the valleys between peaks and, a median distance beyond the outer ones, at their lowest."""
    n = F.size(found)
    pitch = F.when(n > 1, F.floor(_median(widths(found)))).otherwise(F.size(values)).cast("int")

    def bands(edges: Column) -> Column:
        m = F.size(edges) - 1
        return F.zip_with(F.slice(edges, 1, m), F.slice(edges, 2, m), lambda a, b: F.struct(a.alias("lo"), F.least(F.size(values), b).alias("hi")))

    between = F.zip_with(F.slice(found, 1, F.greatest(F.lit(0), n - 1)), F.slice(found, 2, F.greatest(F.lit(0), n - 1)), lambda a, b: valley(values, a, b))
    first, last = F.get(found, F.lit(0)), F.get(found, n - 1)
    edges = F.concat(F.array(valley(values, first - pitch, first + 1)), between, F.array(valley(values, last, last + pitch + 1)))
    return F.when(n > 0, let(edges, bands)).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))


def autocorrelation_pitch(values: Column, height: Column) -> Column:
    """The lag of the largest autocorrelation from .18 (8 at least) to .65 of the height and a third of the signal; a third of the height where there is no room."""
    n = F.size(values)
    lo = _part(height, 0.18, 8)
    hi = F.least(F.floor(n / 3).cast("int"), F.greatest(lo + 1, F.floor(height * F.lit(0.65)).cast("int")))

    def lag(x: Column) -> Column:
        at = lambda d: F.aggregate(F.zip_with(F.slice(x, 1, n - d), F.slice(x, d + 1, n - d), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        scores = F.transform(F.sequence(lo, hi - 1), at)
        return (lo + F.array_position(scores, F.array_max(scores)) - 1).cast("int")

    centred = let(array_mean(values), lambda m: F.transform(values, lambda v: v - m))
    return F.when(hi <= lo, F.greatest(F.lit(8), F.floor(height / 3).cast("int"))).otherwise(let(centred, lag))


def seam_between_bodies(activity: Column, lo: Column, seam: Column, hi: Column) -> Column:
    """Whether a seam is quiet beside strokes on both sides: .55 of the weaker body, or .70 and no louder than two columns away."""
    n = F.size(activity)
    s = F.least(F.greatest(F.least(F.greatest(seam, lo + 1), hi - 2), F.lit(1)), n - 2).cast("int")
    weaker = F.least(_peak(span(activity, lo, s)), _peak(span(activity, s, hi)))
    here = F.get(activity, s)
    local = (here <= F.get(activity, F.greatest(s - 2, F.lit(0)))) & (here <= F.get(activity, F.least(s + 2, n - 1))) & (here <= 0.70 * weaker)
    return F.coalesce((n >= 4) & (hi - lo >= 6) & (weaker >= 0.16) & ((here <= 0.55 * weaker) | local), F.lit(False))


def _joined(boxes: Column, joins) -> Column:
    """Boxes (lo, hi, score) folded from the left: joins(last, next) gives the box that both become, or null."""
    plain = lambda b: F.struct(b["lo"].cast("int").alias("lo"), b["hi"].cast("int").alias("hi"), b["score"].cast("double").alias("score"))

    def step(out: Column, b: Column) -> Column:
        both = joins(F.element_at(out, -1), b)
        return F.when(both.isNotNull(), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(plain(b))))

    none = F.array().cast("array<struct<lo:int,hi:int,score:double>>")
    return F.aggregate(boxes, none, lambda out, b: F.when(F.size(out) == 0, F.array(plain(b))).otherwise(step(out, b)))


def packed_thin(boxes: Column, height: Column) -> Column:
    """Boxes of a line, where thin sure ones that touch join as long as they make no more than a letter's width."""

    def both(a: Column, b: Column) -> Column:
        w, v, whole = (a["hi"] - a["lo"]) / height, (b["hi"] - b["lo"]) / height, (b["hi"] - a["lo"]) / height
        thin = (w <= 0.40) & (v <= 0.40) & (whole <= 0.85) & (F.least(a["score"], b["score"]) >= 0.45) & ~((F.greatest(w, v) > 0.36) & (F.least(w, v) > 0.28))
        out = F.struct(a["lo"].alias("lo"), b["hi"].cast("int").alias("hi"), (0.5 * (a["score"] + b["score"])).alias("score"))
        return F.when((height > 0) & (b["lo"] - a["hi"] <= 2) & thin, out)

    return _joined(boxes, both)


def edge_slivers(boxes: Column, height: Column, carved: Column) -> Column:
    """Boxes of a line, where a thin unsure one at either end that touches its neighbour joins it; carved: which are stems that stay."""
    n = F.size(boxes)
    weak = lambda i: ((F.get(boxes, i)["hi"] - F.get(boxes, i)["lo"]) / height <= 0.22) & (F.get(boxes, i)["score"] < 0.30) & ~F.coalesce(F.get(carved, i), F.lit(False))
    near = lambda i, j: F.get(boxes, j)["lo"] - F.get(boxes, i)["hi"] <= 3
    head = (n >= 2) & (height > 0) & weak(F.lit(0)) & near(F.lit(0), F.lit(1))
    tail = (n >= F.when(head, 3).otherwise(2)) & (height > 0) & weak(n - 1) & near(n - 2, n - 1)

    def one(b: Column, i: Column) -> Column:
        lo = F.when(head & (i == 1), F.get(boxes, F.lit(0))["lo"]).otherwise(b["lo"])
        hi = F.when(tail & (i == n - 2), F.get(boxes, n - 1)["hi"]).otherwise(b["hi"])
        score = F.greatest(b["score"], F.when(head & (i == 1), F.get(boxes, F.lit(0))["score"]), F.when(tail & (i == n - 2), F.get(boxes, n - 1)["score"]))
        gone = (head & (i == 0)) | (tail & (i == n - 1))
        return F.when(~gone, F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), score.cast("double").alias("score")))

    return F.filter(F.transform(boxes, one), lambda b: b.isNotNull())


def waw_or_ayn(m: Column) -> Column:
    """Which of two round letters a printed shape (vert, hole) is, null where it doesn't say."""
    waw, ayn = F.lit(K.WAW), F.lit(K.AYN)
    return (
        F.when(m["vert"] >= 0.82, waw).when((m["hole"] >= 0.58) & (m["vert"] <= 0.72), ayn).when((m["vert"] >= 0.78) & (m["hole"] <= 0.65), waw)
        .when((m["hole"] >= 0.55) & (m["vert"] + 0.05 < m["hole"]), ayn)
    )


def box_letter(m: Column) -> Column:
    """Which of three box-like letters a printed shape (vert, horiz, top, bot, hole, lower_runs) is, null where it doesn't say."""
    teth, dhadhe, beth = F.lit(K.TETH), F.lit(K.DHADHE), F.lit(K.BETH)
    weak = m["vert"] <= 0.55
    open_ = ((m["hole"] >= 0.80) & weak) | ((m["bot"] <= 0.60) & (m["top"] >= 0.70) & (m["hole"] >= 0.70) & weak) | ((m["lower_runs"] == 2) & weak & (m["hole"] >= 0.70))
    closed = (
        F.when((m["vert"] >= 0.78) & (m["hole"] <= 0.70) & (m["vert"] >= m["horiz"] + 0.08), teth).when((m["horiz"] >= 0.72) & (m["horiz"] >= m["vert"] + 0.12), dhadhe)
        .when((m["vert"] >= 0.88) & (m["hole"] <= 0.65), teth).when((m["horiz"] >= 0.80) & (m["vert"] <= 0.60), dhadhe).when((m["hole"] >= 0.75) & weak, beth)
    )
    return F.when(open_, beth).when((m["top"] >= 0.75) & (m["bot"] >= 0.75), closed)


def shape_fixed(label: Column, confidence: Column, m: Column, gimel: Column) -> Column:
    """struct(label, source, trusted) of a printed glyph whose shape speaks for another letter, null where it doesn't; gimel: the shape is that letter's."""
    box, round_ = box_letter(m), waw_or_ayn(m)
    changed = lambda to, source: F.struct(to.alias("label"), F.lit(source).alias("source"), (F.coalesce(confidence, F.lit(0.0)) >= 0.45).alias("trusted"))
    return (
        F.when(label.isin(K.TETH, K.DHADHE, K.BETH) & (box != label), changed(box, "paper_box_family_shape")).when((label == K.BETH) & gimel, changed(F.lit(K.GIMEL), "paper_beth_gimel_shape"))
        .when(label.isin(K.WAW, K.AYN) & (round_ != label), changed(round_, "paper_waw_ayn_shape"))
    )


def thin_bar(width: Column, height: Column) -> Column:
    """Whether an upright is as narrow as a word separator: two columns at least and .24 of the height at most."""
    return F.coalesce((height > 0) & (width >= 2) & (width / height <= 0.24), F.lit(False))


def internal_separator(edges: Column, i: Column, pitch: Column, height: Column) -> Column:
    """Whether part i of a line is a bar between two full letters: `word_separator_box` with a share of .22; outer parts never are."""
    w = lambda k: (F.get(edges, k + 1) - F.get(edges, k)).cast("double")
    inner = (i > 0) & (i < F.size(edges) - 2)
    return F.coalesce(inner & word_separator_box(w(i), height, pitch, w(i - 1), w(i + 1), 0.22), F.lit(False))


def crosses_strong(edges: Column, i: Column, j: Column, strength: Column, least: float = 0.48) -> Column:
    """Whether the span from edge i to edge j holds an inner edge that is a sure boundary; strength: largest near each column."""
    return (j > i + 1) & F.exists(F.slice(edges, i + 2, F.greatest(F.lit(0), j - i - 1)), lambda c: F.coalesce(near_max(strength, c) >= least, F.lit(False)))


def joined_bands(bands: Column, height: Column) -> Column:
    """Bands (lo, hi) of a page, where a thin first one joins the next, and so does a thin inner one far shorter than both neighbours.

    Thin is .16 of the page's height, 8 at least; the first must be under .55 of the next, an inner one under .60.
    """
    tiny = _part(height, 0.16, 8)
    tall = lambda b: b["hi"] - b["lo"]
    both = lambda a, b: F.struct(a["lo"].cast("int").alias("lo"), b["hi"].cast("int").alias("hi"))

    def head(b: Column) -> Column:
        first, second = F.get(b, F.lit(0)), F.get(b, F.lit(1))
        thin = (tall(first) <= tiny) & (tall(first) < 0.55 * tall(second))
        return F.when((F.size(b) >= 2) & thin, F.concat(F.array(both(first, second)), F.slice(b, 3, F.size(b)))).otherwise(b)

    def inner(b: Column) -> Column:
        start = F.struct(F.array().cast("array<struct<lo:int,hi:int>>").alias("out"), F.lit(False).alias("skip"))

        def step(acc: Column, i: Column) -> Column:
            own, after, before = F.get(b, i), F.get(b, i + 1), F.element_at(acc["out"], -1)
            thin = (i > 0) & (i < F.size(b) - 1) & (tall(own) <= tiny) & (tall(own) < 0.60 * F.least(tall(before), tall(after)))
            joins = F.struct(F.concat(acc["out"], F.array(both(own, after))).alias("out"), F.lit(True).alias("skip"))
            alone = F.struct(F.concat(acc["out"], F.array(both(own, own))).alias("out"), F.lit(False).alias("skip"))
            return F.when(acc["skip"], F.struct(acc["out"].alias("out"), F.lit(False).alias("skip"))).when((F.size(acc["out"]) > 0) & thin, joins).otherwise(alone)

        return F.when(F.size(b) < 3, b).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step)["out"])

    typed = F.transform(bands, lambda b: both(b, b))
    return F.when(F.size(bands) > 0, let(let(typed, head), inner)).otherwise(typed)


def widened_bands(bands: Column, values: Column, height: Column) -> Column:
    """Bands (lo, hi) of a page grown into what signal stands beyond the outer ones, and a little across the seams between them."""
    n = F.size(bands)
    median = _median(F.transform(bands, lambda b: F.greatest(F.lit(1), b["hi"] - b["lo"]).cast("double")))
    edge, share, least = (F.greatest(F.lit(k), f(median * p)).cast("int") for k, p, f in ((6, 0.14, F.rint), (4, 0.10, F.rint), (8, 0.45, F.floor)))
    limit = lambda b: F.greatest(F.lit(0.22), 0.40 * F.coalesce(F.array_max(span(values, b["lo"], b["hi"])), F.lit(1.0)))
    first, last = F.get(bands, F.lit(0)), F.get(bands, n - 1)
    low = lambda b: F.filter(F.transform(values, lambda v, i: F.when(v < limit(b), i)), lambda i: i.isNotNull())
    top = F.coalesce(F.array_max(F.filter(low(first), lambda i: i < first["lo"])) + 1, F.lit(0))
    bottom = F.coalesce(F.array_min(F.filter(low(last), lambda i: i >= last["hi"])), height)
    lo = lambda i: F.when(i == 0, F.greatest(F.lit(0), F.least(top, first["lo"]) - edge)).otherwise(F.get(bands, i)["lo"])
    hi = lambda i: F.when(i == n - 1, F.least(height, F.greatest(bottom, last["hi"]) + edge)).otherwise(F.get(bands, i)["hi"])
    seam = lambda i: F.floor((hi(i) + lo(i + 1)) / 2)  # noqa: E731  between band i and the next

    def one(_: Column, i: Column) -> Column:
        up, down = F.greatest(F.lit(0), F.least(lo(i), seam(i - 1) - share)), F.least(height, F.greatest(hi(i), seam(i) + share))
        begin = F.when((i > 0) & (hi(i) - up >= least), up).otherwise(lo(i))
        end = F.when((i < n - 1) & (down - begin >= least), down).otherwise(hi(i))
        return F.struct(begin.cast("int").alias("lo"), end.cast("int").alias("hi"))

    return F.transform(bands, one)
