"""The record of a photo or film from the fields its container gives, by one precedence for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactsheet.functions.text import date_from_filename, date_from_folder, source_kind
from contactsheet.params import MIN_YEAR

# Patterns of dates and positions in containers.
EXIF_DATE = r"^\s*(\d{4})[:/-](\d{1,2})[:/-](\d{1,2})(?:[ T:]+(\d{1,2}):(\d{2})(?::(\d{2}))?)?"
XMP_DATE = r"(?:exif:DateTimeOriginal|photoshop:DateCreated|xmp:CreateDate)\s*(?:=\s*\"|>)\s*(\d{4})-(\d{2})-(\d{2})T?\s?(\d{2}):(\d{2})(?::(\d{2}))?"
CONTAINER_DATE = r"^\s*(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})"
ISO6709 = r"([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?"
CLOUD_DATE = r"(?i)([A-Za-z]+)\s+(\d{1,2}),?\s*(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AP]M)?"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
RECORDINGS = r"screen[ _-]?record"


def _at(text: Column, pattern: str, latest_year: int | None, hour: int = 0) -> Column:
    """The plausible time of a pattern's six groups; a missing time of day is ``hour`` o'clock."""
    part = lambda g, default: F.coalesce(F.regexp_extract(text, pattern, g).try_cast("int"), F.lit(default))
    ts = F.try_make_timestamp(part(1, -1), part(2, 0), part(3, 0), part(4, hour), part(5, 0), part(6, 0))
    last = F.year(F.current_date()) + 1 if latest_year is None else F.lit(latest_year)
    return F.when(F.year(ts).between(F.lit(MIN_YEAR), last), ts)


def exif_date(text: Column, latest_year: int | None = None) -> Column:
    """D3: the time of "2020:01:02 03:04:05", a date alone too; null unless it is a real one from 1985 to next year."""
    return _at(text, EXIF_DATE, latest_year)


def xmp_date(text: Column, latest_year: int | None = None) -> Column:
    """D3: the first original date in an XMP packet."""
    return _at(text, XMP_DATE, latest_year)


def container_date(text: Column, latest_year: int | None = None) -> Column:
    """The wall clock of "2024-03-09T11:00:00+0530"; the offset is where it was shot, so it is left as it stands."""
    return _at(text, CONTAINER_DATE, latest_year)


def cloud_date(text: Column) -> Column:
    """Seconds of "Saturday June 26,2021 10:25 AM GMT" or of an ISO time; null for anything else."""
    g = lambda n: F.regexp_extract(text, CLOUD_DATE, n)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.lower(g(1)), 1, 3)).cast("int")
    hour = g(4).try_cast("int")
    hour = F.when(g(7) == "", hour).otherwise(hour % 12 + F.when(F.upper(g(7)) == "PM", 12).otherwise(0))
    named = F.try_make_timestamp(g(3).try_cast("int"), month, g(2).try_cast("int"), hour, g(5).try_cast("int"), F.coalesce(g(6).try_cast("int"), F.lit(0)))
    return F.coalesce(F.unix_timestamp(named), F.unix_timestamp(F.trim(text).try_cast("timestamp"))).cast("double")


def degrees(parts: Column, reference: Column) -> Column:
    """Degrees, minutes and seconds as degrees, south and west negative; null for a part below 0 or a minute or
    second of 60 or more, which are corrupt."""
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(0.0))
    whole = part(0) + part(1) / 60 + part(2) / 3600
    ok = (F.size(parts) > 0) & (part(0) >= 0) & part(1).between(0, 59.9999999) & part(2).between(0, 59.9999999)
    return F.when(ok & ~F.exists(parts, lambda x: x.isNull()), F.when(F.upper(F.trim(reference)).isin("S", "W"), -whole).otherwise(whole))


def position(text: Column) -> Column:
    """Struct (lat, lon, alt) of "+17.3850+078.4867+500.0/", rounded to 7; null outside the ranges and at 0, 0."""
    g = lambda n: F.regexp_extract(text, ISO6709, n).try_cast("double")
    ok = g(1).between(-90, 90) & g(2).between(-180, 180) & ~((F.abs(g(1)) < 1e-6) & (F.abs(g(2)) < 1e-6))
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(F.round(g(1), 7).alias("lat"), F.round(g(2), 7).alias("lon"), g(3).alias("alt")))


def video_records(films: DataFrame, latest_year: int | None = None) -> DataFrame:
    """(id, taken, date_source, date_confidence, source_kind, model, lat, lon) of films.

    Dates from the surest: the maker's local time, a time in a phone's, messenger's or recorder's file name, the
    container's time, any date in the name, a day or month in the folder, the file's. A screen recording is a
    screenshot. ``films`` (id, filename, folder, local_date, utc_date, location, make, model, software, width, height,
    modified).
    """
    named, folder = date_from_filename(F.col("filename"), latest_year), date_from_folder(F.col("folder"))
    made = lambda ts, source, sure: F.when(ts.isNotNull(), F.struct(ts.alias("ts"), F.lit(source).alias("source"), sure.alias("sure")))
    lit = F.lit
    sure_name = (named["precision"] == "datetime") & named["source"].isin("phone", "screenshot", "whatsapp")
    taken = F.coalesce(
        made(container_date(F.col("local_date"), latest_year), "container", lit("high")),
        made(F.when(sure_name & container_date(F.col("utc_date"), latest_year).isNotNull(), named["ts"]), "filename", lit("high")),
        made(container_date(F.col("utc_date"), latest_year), "container", lit("medium")),
        made(named["ts"], "filename", F.when((named["precision"] == "datetime") & (named["source"] == "phone"), "high").otherwise("medium")),
        made(F.when(folder["precision"].isin("date", "month"), folder["ts"]), "folder", lit("low")),
        made(F.col("modified"), "mtime", lit("low")),
    )
    make, model = F.col("make"), F.col("model")
    plain = F.trim(F.substring(model, F.length(make) + 1, F.length(model)))
    bare = F.when(F.lower(model).startswith(F.lower(make)) & (plain != ""), plain).otherwise(model)
    kind = F.when(F.lower("filename").rlike(RECORDINGS), "screenshot").otherwise(source_kind(F.col("filename"), F.col("folder"), make, software=F.col("software")))
    rows = films.select("id", taken.alias("t"), kind.alias("source_kind"), F.coalesce(bare, model).alias("model"), position(F.col("location")).alias("p"))
    return rows.select("id", F.col("t.ts").alias("taken"), F.col("t.source").alias("date_source"), F.col("t.sure").alias("date_confidence"), "source_kind", "model", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def motion_offset(content: Column) -> Column:
    """Where in a photo's bytes its film begins, four bytes before the last "ftyp" that is not at the front; null
    without one. The search is over hexadecimal digits, at even places."""
    digits = F.hex(content)
    marks = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split(digits, "66747970"))), lambda i: F.length(F.call_function("substring_index", digits, F.lit("66747970"), i))), lambda n: (n % 2 == 0) & (n > 8) & (n < F.length(digits)))
    return F.when(F.size(marks) > 0, F.array_max(marks) / 2 - 4).cast("long")


def album_members(lines: DataFrame) -> DataFrame:
    """(album, img_name) of album lists: the folder's name is the album's. ``lines`` (path, value), a name a line
    under a heading."""
    parts = F.split("path", "/")
    name = F.trim(F.regexp_replace("value", '^"|"$', ""))
    return lines.select(F.regexp_replace(F.element_at(parts, -1), r"\.csv$", "").alias("album"), name.alias("img_name")).where((F.col("img_name") != "") & (F.lower("img_name") != "images"))
