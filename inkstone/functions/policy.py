"""Rules of the clients as Column expressions: what may be attached or documented, crops of selections, names and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import constants as K
from inkstone.functions.numeric import js_round
from inkstone.functions.text import clean, or_else


def allowed_attachments(before: Column, picked: Column, cap: int = K.ATTACHMENTS_CAP) -> Column:
    """Attachments (uri, name, mime) with those picked that are of an allowed type and have an address, `cap` at most.

    A missing name is the last part of the address, a missing type that of any bytes.
    """

    def allowed(a: Column) -> Column:
        mime, name = F.lower(F.coalesce(a["mime"], F.lit(""))), F.lower(F.coalesce(a["name"], F.lit("")))
        tests = [mime.contains(t) for t in K.DOCUMENT_TYPES] + [name.endswith(s) for s in K.DOCUMENT_SUFFIXES]
        out = F.coalesce(a["uri"], F.lit("")) != ""
        hit = F.lit(False)
        for t in tests:
            hit = hit | t
        return out & hit

    last = lambda a: or_else(F.element_at(F.split(a["uri"], "/"), -1), F.lit("document"))
    named = lambda a: F.struct(a["uri"].alias("uri"), or_else(a["name"], last(a)).alias("name"), or_else(a["mime"], F.lit("application/octet-stream")).alias("mime"))
    return F.slice(F.concat(before, F.transform(F.filter(picked, allowed), named)), 1, cap)


def can_document(record_id: Column, title: Column, server_id: Column, result_id: Column) -> Column:
    """Whether a record may be documented: it was made on the device, has no title yet and is known to the server."""
    known = (F.coalesce(server_id, F.lit("")) != "") | (F.coalesce(result_id, F.lit("")) != "")
    return F.coalesce(~record_id.startswith("server-"), F.lit(False)) & (clean(title) == "") & known


def selection_crop(selection: Column, image_w: Column, image_h: Column, box_w: Column, box_h: Column, cover: Column) -> Column:
    """A selection (x, y, width, height) on the screen as a crop of the image that is shown whole or covering its box."""
    across, down = box_w / image_w, box_h / image_h
    scale = F.when(cover, F.greatest(across, down)).otherwise(F.least(across, down))
    between = lambda v, lo, hi: F.greatest(F.lit(lo).cast("double"), F.least(v, hi.cast("double")))
    x = between((selection["x"] - (box_w - image_w * scale) / 2) / scale, 0, image_w - 1)
    y = between((selection["y"] - (box_h - image_h * scale) / 2) / scale, 0, image_h - 1)
    w, h = between(selection["width"] / scale, 1, image_w - x), between(selection["height"] / scale, 1, image_h - y)
    return F.struct(*[js_round(v).cast("int").alias(n) for n, v in (("x", x), ("y", y), ("width", w), ("height", h))])


def guessed_file(uri: Column) -> Column:
    """Type and name of an upload, from what its address contains."""
    u = F.lower(uri)
    pick = lambda png, webp, other: F.when(u.contains(".png"), png).when(u.contains(".webp"), webp).otherwise(other)
    return F.struct(pick("image/png", "image/webp", "image/jpeg").alias("mime"), pick("scan.png", "scan.webp", "scan.jpg").alias("name"))


def cutoff(now: Column, days: Column) -> Column:
    """The same time of day so many days earlier."""
    return now - F.make_interval(days=days)


def upscale_factor(height: Column) -> Column:
    """How far a line is enlarged: not from 72 on; to 96, 128 or 104 rows by its height, at most 2.5 or 3 times."""
    h = height.cast("double")
    return F.when((h <= 0) | (h >= 72), 1.0).when(h < 40, F.least(F.lit(2.5), 96 / h)).when(h < 64, F.least(F.lit(3.0), 128 / h)).otherwise(F.least(F.lit(3.0), 104 / h))
