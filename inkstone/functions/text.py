"""Text functions as Column expressions: UTF-16 semantics, previews, titles, transliteration, versions, file types."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import constants as K

#: White space as scripts of the web trim it, for use inside a class.
_SPACE = r"\t\n\x0B\f\r    -     　﻿"


def js_trim(c: Column) -> Column:
    """Trims all Unicode white space and the byte-order mark."""
    return F.regexp_replace(c, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def js_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def js_slice(c: Column, units: int) -> Column:
    """The first `units` UTF-16 units; a pair that the cut would halve is left out."""
    raw = F.encode(c, "UTF-16BE")
    halves = (F.length(raw) > 2 * units) & F.hex(F.substring(raw, 2 * units - 1, 1)).between("D8", "DB")
    return F.when(F.length(c) * 2 <= units, c).otherwise(F.decode(F.when(halves, F.substring(raw, 1, 2 * units - 2)).otherwise(F.substring(raw, 1, 2 * units)), "UTF-16BE"))


def or_else(c: Column, other: Column) -> Column:
    """c unless it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def preview(c: Column, units: int = K.PREVIEW_UNITS) -> Column:
    return or_else(js_slice(js_trim(c), units), F.lit(K.NO_PREVIEW))


def display_title(c: Column) -> Column:
    """Blank: the default title; long: cut, with an ellipsis."""
    t = js_trim(c)
    return F.when(F.coalesce(t, F.lit("")) == "", K.DEFAULT_TITLE).when(js_length(t) <= K.TITLE_UNITS, t).otherwise(F.concat(js_slice(t, K.TITLE_UNITS), F.lit(K.ELLIPSIS)))


def clean(c: Column) -> Column:
    """An optional text: trimmed, null as the empty text."""
    return F.coalesce(js_trim(c), F.lit(""))


def collapse_blanks(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, "[ \\t]+", " "))


def to_arabic(c: Column, letters: str | None = None) -> Column:
    """Letter by letter; the bar becomes a space, what isn't in the table stays."""
    return F.translate(c, (letters or "".join(K.LETTERS)) + K.BAR, K.ARABIC_LETTERS + " ")


def glyph_to_arabic(glyph: Column) -> Column:
    """A glyph (character, display, isSeparator) in Arabic script."""
    character, display = F.coalesce(glyph["character"], F.lit("")), glyph["display"]
    shown = js_trim(display)
    numerals = F.create_map(*[F.lit(x) for n, (_, d, _) in K.NUMERALS.items() for x in (n, d)])
    letters = F.create_map(*[F.lit(x) for pair in zip(K.LETTERS, K.ARABIC_LETTERS, strict=True) for x in pair])
    return (
        F.when(F.coalesce(glyph["isSeparator"], F.lit(False)), F.when(shown == K.BAR, " ").otherwise(or_else(shown, F.lit(" "))))
        .when(character.startswith("NUM_"), F.coalesce(F.try_element_at(numerals, character), display, F.regexp_replace(character, "^NUM_", "")))
        .otherwise(F.coalesce(F.try_element_at(letters, character), display, F.lit("")))
    )


def line_to_arabic(glyphs: Column) -> Column:
    return collapse_blanks(F.array_join(F.transform(glyphs, glyph_to_arabic), ""))


def lines_to_arabic(lines: Column) -> Column:
    """Arabic text of an array of lines (glyphs): empty ones fall out."""
    return F.array_join(F.filter(F.transform(lines, lambda x: line_to_arabic(x["glyphs"])), lambda t: t != ""), "\n")


def is_separator(label: Column) -> Column:
    t = F.trim(label)
    return F.coalesce(t.isin("NUM_1", K.SEPARATOR_CHAR, "1", K.BAR) | F.upper(t).isin("NUM_1", "NUM1"), F.lit(False))


def is_numeral(label: Column) -> Column:
    return F.coalesce(label.startswith("NUM_"), F.lit(False))


def is_readable(label: Column) -> Column:
    return F.coalesce(~label.isin("?", "UNKNOWN", "") & ~is_separator(label) & ~is_numeral(label), F.lit(False))


def ocr_mode(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)) == "paper", "paper").otherwise("stone")


def _ladder(tests: list[tuple[Column, str]], default: str) -> Column:
    return F.coalesce(*[F.when(t, F.lit(v)) for t, v in tests], F.lit(default))


def mime_type(filename: Column) -> Column:
    f = F.lower(filename)
    return _ladder([(f.endswith(".png"), "image/png"), (f.endswith(".webp"), "image/webp")], "image/jpeg")


def image_extension(filename: Column) -> Column:
    f = F.lower(filename)
    return _ladder([(f.endswith(".png"), "png"), (f.endswith(".webp"), "webp")], "jpg")


def attachment_extension(mime: Column, filename: Column) -> Column:
    """What stands after the last dot (or the whole name), if it looks like a suffix; else by parts of the type's name."""
    own = F.element_at(F.split(F.lower(filename), "\\."), -1)
    m = F.lower(mime)
    kinds = [("pdf", "pdf"), ("png", "png"), ("webp", "webp"), ("jpeg", "jpg"), ("jpg", "jpg"), ("msword", "doc"), ("wordprocessingml", "docx"), ("ms-excel", "xlsx"), ("spreadsheetml", "xlsx"), ("text/plain", "txt")]
    return F.coalesce(F.when(own.rlike("^[a-z0-9]{1,8}$"), own), _ladder([(m.contains(k), v) for k, v in kinds], "bin"))


def after_comma(c: Column) -> Column:
    """A data URL without its head; other texts as they are."""
    return F.substring(c, F.instr(c, ",") + 1, F.length(c))


def upload_problem(data: Column) -> Column:
    """Why an upload is refused: null, empty or over 12 MiB; null if it isn't."""
    size = F.length(data)
    return F.when(data.isNull(), "missing").when(size == 0, "empty").when(size > K.MAX_UPLOAD, "too_large")


def has_image_suffix(path: Column) -> Column:
    return F.coalesce(F.lower(F.element_at(F.split(path, "\\."), -1)).isin(*K.IMAGE_SUFFIXES) & path.contains("."), F.lit(False))


def semver(c: Column) -> Column:
    """array<int> of three parts: cut at + or -, numbers by their leading digits, else 0. Compares as versions do."""
    core = F.get(F.split(js_trim(c), "[+-]"), 0)
    number = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(F.get(F.split(core, "\\."), i), F.lit("0")), r"^\s*(\d{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return F.array(*[number(i) for i in range(3)])


def version_status(current: Column, minimum: Column, latest: Column) -> Column:
    least, newest = clean(minimum), clean(latest)
    return F.when(least == "", "unknown").when(semver(current) < semver(least), "force-update").when((newest != "") & (semver(current) < semver(newest)), "optional-update").otherwise("supported")


def email_problem(email: Column, user_type: Column, organization: Column, needs_organization: list[str]) -> Column:
    """The first rule that a submission breaks, null if none."""
    good = F.coalesce(js_trim(email).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.lit(False))
    return F.when(~good, "email").when(clean(user_type) == "", "user_type").when(clean(user_type).isin(*needs_organization) & (clean(organization) == ""), "organization")


def history_status(title: Column, status: Column, server_id: Column) -> Column:
    return F.when((clean(title) != "") | F.coalesce(status == "documented", F.lit(False)), "documented").when(or_else(server_id, F.lit(None)).isNotNull(), "analyzed").otherwise("local")


def sync_label(status: Column, server_id: Column) -> Column:
    return F.when(status == "documented", K.STATUS_LABELS["documented"]).when(F.coalesce(server_id, F.lit("")) != "", K.STATUS_LABELS["archived"]).otherwise(K.STATUS_LABELS["local"])


def parse_millis(c: Column) -> Column:
    """ISO text as epoch milliseconds, 0 where it can't be read."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(c)), F.lit(0).cast("bigint"))


def calendar_days_ago(ts: Column, now: Column) -> Column:
    return F.datediff(F.to_date(now), F.to_date(ts))


def day_label(ts: Column, now: Column) -> Column:
    d = calendar_days_ago(ts, now)
    return F.when(d == 0, "today").when(d == 1, "yesterday").otherwise(F.date_format(ts, "d MMM"))


def plural_label(n: Column) -> Column:
    return F.when(n == 1, "one").when(n == 2, "two").otherwise("many")


def public_id(prefix: str, millis: Column, number: Column) -> Column:
    """prefix, the last 8 digits of the time and up to 4 base-36 letters of a number."""
    return F.concat(F.lit(prefix + "-"), F.right(millis.cast("string"), F.lit(8)), F.lit("-"), F.upper(F.right(F.conv(number.cast("string"), 10, 36), F.lit(4))))


def attachment_path(scan: Column, position: Column, extension: Column) -> Column:
    return F.concat(scan, F.lit("/extra-"), F.lpad(position.cast("string"), 2, "0"), F.lit("."), extension)


def group_key(image: Column, crop: Column) -> Column:
    """Lower-case file stem of the image, else of the crop."""
    stem = lambda c: F.lower(F.regexp_replace(F.element_at(F.split(c, "[/\\\\]"), -1), r"(?<=.)\.[^.]*$", ""))
    return F.coalesce(F.nullif(stem(image), F.lit("")), stem(crop))


def any_of(tests: list[Column]) -> Column:
    return functools.reduce(operator.or_, tests, F.lit(False))
