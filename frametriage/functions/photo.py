"""Column functions on names, times and sizes of photographs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted extensions, and directories that are not entered.
EXTENSIONS = ["cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "raf", "orf", "dng", "pef", "raw", "rwl", "3fr", "erf", "mrw", "mos", "x3f", "srw", "tif", "tiff", "jpg", "jpeg"]
PRUNED = [".git", "node_modules", "target", ".cache", "$RECYCLE.BIN"]
#: Diagonal of a 36 mm by 24 mm frame.
FULL_FRAME_DIAGONAL = 43.266
WHITE = " \t\n\r\x0b\x0c"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the file name; null without one, or if the name only starts with it."""
    return F.nullif(F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)), F.lit(""))


def accepted(path: Column) -> Column:
    return F.coalesce(extension(path).isin(EXTENSIONS), F.lit(False))


def clean_text(raw: Column) -> Column:
    """Up to the first NUL, trimmed; null if nothing is left."""
    return F.nullif(F.btrim(F.substring_index(raw, "\0", 1), F.lit(WHITE)), F.lit(""))


def _parts(text: Column) -> list[Column]:
    return [F.substring(text, at, n).cast("int") for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))]


def capture_time(raw: Column) -> Column:
    """`YYYY:MM:DD HH:MM:SS` as ISO 8601 text, null if it is not one. No calendar: 31 February passes. Sorts as time does."""
    text = F.btrim(F.substring_index(raw, "\0", 1), F.lit(WHITE))
    _, month, day, hour, minute, second = _parts(text)
    shape = text.rlike(r"^[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z")
    fits = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 59)
    iso = F.concat(F.translate(F.substring(text, 1, 10), ":", "-"), F.lit("T"), F.substring(text, 12, 8))
    return F.when(shape, F.when(fits, iso))


def capture_timestamp(iso: Column) -> Column:
    """The real time, null for days that the calendar lacks."""
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def pseudo_epoch(iso: Column) -> Column:
    """Seconds that keep the order of times but count every year as 366 days and every month as 31."""
    year, month, day, hour, minute, second = (p.cast("long") for p in _parts(iso))
    y = year - 1970
    whole = lambda n: F.call_function("div", y, F.lit(n).cast("long"))
    days = 366 * (365 * y + whole(4) - whole(100) + whole(400)) + 31 * (month - 1) + (day - 1)
    return days * 86400 + hour * 3600 + minute * 60 + second


def seconds_between(earlier: Column, later: Column) -> Column:
    """Of two ISO times; negative if later is the earlier one."""
    return pseudo_epoch(later) - pseudo_epoch(earlier)


def oriented(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height as seen; both null if one is missing."""
    both = width.isNotNull() & height.isNotNull()
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.when(both, F.when(turned, height).otherwise(width)), F.when(both, F.when(turned, width).otherwise(height))


def aspect(width: Column, height: Column, orientation: Column) -> Column:
    w, h = oriented(width, height, orientation)
    return F.when(h != 0, w.cast("double") / h.cast("double"))


def crop_factor(width: Column, height: Column, focal: Column) -> Column:
    """From the size as stored; 0 if a side or the focal length is missing or not positive."""
    w, h, f = width.cast("double"), height.cast("double"), focal.cast("double")
    return F.coalesce(F.when((f > 0) & (w > 0) & (h > 0), FULL_FRAME_DIAGONAL * f / F.sqrt(w * h)), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.when(whole != 0, part.cast("double") / whole.cast("double")), F.lit(0.0))


def rational(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, (numerator.cast("double") / denominator.cast("double")).cast("float"))


def saturated(value: Column, most: int = 65535) -> Column:
    return F.when(value.isNotNull(), F.least(value, F.lit(most)))


def exposure_value(exposure: Column) -> Column:
    """The exposure time as it is, under the name that reports use."""
    return exposure


def entry(entries: Column, tag: int) -> Column:
    """The first entry of a tag, null without one."""
    return F.try_element_at(F.filter(entries, lambda e: e["tag"] == tag), F.lit(1))


def entry_of(exif: Column, ifd0: Column, tags: list[int]) -> Column:
    """The first tag of the list that is present; of each the Exif entry goes before the main one."""
    return F.coalesce(*(entry(ifd, t) for t in tags for ifd in (exif, ifd0)))


def has_tag(entries: Column, tag: int) -> Column:
    return F.exists(entries, lambda e: e["tag"] == tag)


def tags(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["tag"])
