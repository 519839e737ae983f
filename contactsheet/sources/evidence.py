"""Evidence beside the photos: sidecars, tracks, exports and the gazetteer, read as DataFrames and matched to photos."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.functions.text import stem_variants

SIDECAR = (
    "title string, description string, photoTakenTime struct<timestamp:string>, geoData struct<latitude:double,longitude:double>, "
    "people array<struct<name:string>>, favorited boolean, archived boolean, trashed boolean"
)
SUPPLEMENTAL = ".supplemental-metadata"
SHORTEST_CUT = 30  #: a sidecar's name may be cut to this many characters or more


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of whole files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.decode("content", "UTF-8").alias("content"))


def real_position(lat: Column, lon: Column) -> Column:
    """Inside the ranges, and not the place at 0, 0 that a lost fix writes."""
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6))


def read_takeout(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, taken_ts, lat, lon, description, people, favorited, archived, trashed) of JSON sidecars; what
    is not JSON gives nulls."""
    rows = _files(spark, path, "*.json").select("path", F.from_json("content", SIDECAR).alias("s"))
    taken = F.expr("try_cast(s.photoTakenTime.timestamp AS double)")
    lat, lon = F.col("s.geoData.latitude"), F.col("s.geoData.longitude")
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("s.people", F.array().cast("array<struct<name:string>>")), lambda p: F.trim(p["name"])), lambda n: n != "")))
    located = F.coalesce(real_position(lat, lon), F.lit(False))
    return rows.select(
        "path",
        F.col("s.title").alias("title"),
        F.when(taken > 0, taken).alias("taken_ts"),
        F.when(located, lat).alias("lat"),
        F.when(located, lon).alias("lon"),
        F.nullif(F.trim("s.description"), F.lit("")).alias("description"),
        names.alias("people"),
        *[F.coalesce(F.col(f"s.{c}"), F.lit(False)).alias(c) for c in ("favorited", "archived", "trashed")],
    )


def match_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(id, sidecar): each photo's sidecar of its folder: named like the file, with the supplement, cut short, or
    like the stem, in this order; of several, the longest name, then the first. The "(2)" of both must be equal. What is
    the whole name or stem of a photo in the folder was not cut, so it is not the sidecar of a photo whose name goes on.
    ``media`` (id, folder, filename), ``sidecars`` (folder, sidecar: a name that ends in .json)."""
    core = F.lower(F.regexp_replace("sidecar", r"(\(\d+\))?\.json$", ""))
    s = sidecars.where(F.lower("sidecar").endswith(".json")).select("folder", "sidecar", core.alias("core"), F.regexp_extract("sidecar", r"(\(\d+\))\.json$", 1).alias("num"))
    num = F.regexp_extract("filename", r"(\(\d+\))\.[^.]*$", 1)
    stem, ext = F.lower(F.regexp_replace("filename", r"(\(\d+\))?(\.[^.]*)?$", "")), F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    # Step by step, so that each is computed once and not for every use of it.
    m = media.select("id", "folder", num.alias("num"), stem.alias("stem"), ext.alias("ext"))
    m = m.withColumn("stem", F.element_at(stem_variants(F.col("stem")), -1)).withColumn("name", F.concat("stem", "ext"))
    # Every rule is an equality: a core that ends in the supplement, whole or cut, is met by the name before it, any other by
    # the name, the stem, or what is left of the name when it is cut to a length that some core has.
    tail = F.concat(F.lit("."), F.substring_index("core", ".", -1))
    more = F.col("core").contains(".") & F.lit(SUPPLEMENTAL).startswith(tail)
    before = F.substring("core", F.lit(1), F.length("core") - F.length(tail))
    own = F.struct(F.col("core").alias("key"), F.lit(None).cast("int").alias("added"))
    added = F.struct(before.alias("key"), F.when(tail == SUPPLEMENTAL, 1).otherwise(2).alias("added"))
    lengths = s.where(F.length("core") >= SHORTEST_CUT).agg(F.collect_set(F.length("core")).alias("lengths"))  # no more numbers than a name has characters
    s = s.select("folder", "num", "sidecar", F.inline(F.array_compact(F.array(own, F.when(more, added)))))
    key = lambda text, rank, other: F.struct(text.alias("key"), F.lit(rank).alias("rank"), other.alias("other"))  # noqa: E731 - other: cut to what is not the photo's own stem
    cuts = F.transform(F.filter("lengths", lambda n: n < F.length("name")), lambda n: key(F.substring(F.col("name"), F.lit(1), n), 2, n != F.length("stem")))
    no = F.lit(False)
    m = m.crossJoin(F.broadcast(lengths)).select("id", "folder", "num", F.inline(F.concat(F.array(key(F.col("name"), 0, no), key(F.col("stem"), 3, no)), cuts)))  # one row is broadcast
    hashed = lambda rows: rows.withColumn("h", F.xxhash64("folder", "num", "key"))  # noqa: E731 - sorts faster than long names
    # Dealt and sorted as the join needs it.
    whole = F.max(F.col("rank") != 2).over(Window.partitionBy("h", "folder", "num", "key"))
    m = hashed(m).withColumn("whole", whole).where(~F.col("other") | ~F.col("whole")).drop("other", "whole")
    met = m.join(hashed(s), ["h", "folder", "num", "key"]).where(F.col("added").isNull() | (F.col("rank") == 0))
    return met.groupBy("id").agg(F.min_by("sidecar", F.struct(F.coalesce("added", "rank"), -F.length("sidecar"), "sidecar")).alias("sidecar"))


def read_icloud(spark: SparkSession, path: str) -> DataFrame:
    """(img_name, created_ts, favorite, hidden, deleted) of details files; dates like "Saturday June 26,2021 10:25 AM
    GMT", whose comma may have split the line."""
    lines = spark.read.text(path).where(~F.lower("value").startswith("imgname"))
    name = F.regexp_extract("value", r"^([^,]*)", 1)
    when = F.regexp_extract("value", r"([A-Z][a-z]+ \d{1,2}, ?\d{4} \d{1,2}:\d{2} [AP]M)", 1)
    # Spark's "LLLL" reads full month names in the session's language; the text is English.
    created = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(when, ", ?", " "), F.lit("MMMM d yyyy h:mm a"))).cast("double")
    rest = F.split(F.regexp_replace("value", r"^.*GMT\"?,?", ""), ",")
    yes = lambda i: F.lower(F.trim(F.coalesce(F.get(rest, F.lit(i)), F.lit("")))).isin("yes", "true", "1")
    return lines.where(name != "").select(name.alias("img_name"), created.alias("created_ts"), yes(0).alias("favorite"), yes(1).alias("hidden"), yes(2).alias("deleted"))


def _tag(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(path, track, ts, lat, lon): the timed points of tracks and routes; files that are not XML have none."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for where, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    root = ET.fromstring(content)
                except ET.ParseError:
                    continue
                track = next((e.text.strip() for e in root.iter() if _tag(e) == "name" and e.text), None)
                for e in root.iter():
                    time = next((c.text for c in e if _tag(c) == "time" and c.text), None) if _tag(e) in ("trkpt", "rtept") else None
                    try:
                        at = datetime.fromisoformat(time.strip().replace("Z", "+00:00"))
                        out.append((where, track, (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp(), float(e.get("lat")), float(e.get("lon"))))
                    except (AttributeError, TypeError, ValueError):
                        continue
            yield pd.DataFrame(out, columns=["path", "track", "ts", "lat", "lon"])

    points = _files(spark, path, "*.gpx").mapInPandas(run, "path string, track string, ts double, lat double, lon double")
    return points.where(real_position(F.col("lat"), F.col("lon")))


def read_xmp(spark: SparkSession, path: str) -> DataFrame:
    """(path, rating, keywords, description, people): ratings of 0 to 5, subjects, and names of face regions or below a
    "People" subject; a name is no keyword."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for where, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    root = ET.fromstring(content)
                except ET.ParseError:
                    continue
                rating, words, people, about = 0, [], [], None
                for e in root.iter():
                    attributes = {k.rsplit("}", 1)[-1]: v for k, v in e.attrib.items()}
                    value = attributes.get("Rating") or (e.text if _tag(e) == "Rating" else None)
                    try:
                        rating = max(rating, min(5, max(0, int(float(value))))) if value else rating
                    except ValueError:
                        pass
                    items = [i.text.strip() for i in e.iter() if _tag(i) == "li" and i.text and i.text.strip()]
                    if _tag(e) == "subject":
                        words += items
                    elif _tag(e) == "description" and items:
                        about = items[0]
                    elif _tag(e) == "hierarchicalSubject":
                        people += [h.split("|")[-1].strip() for h in items if "|" in h and h.split("|")[0].strip().lower() in ("people", "persons", "faces")]
                    named = attributes.get("PersonDisplayName") or (attributes.get("Name") if attributes.get("Type", "Face") == "Face" else None)
                    people += [named.strip()] if named and named.strip() else []
                people = list(dict.fromkeys(people))
                low = {p.lower() for p in people}
                out.append((where, rating, [w for w in dict.fromkeys(words) if w.lower() not in low], about, people))
            yield pd.DataFrame(out, columns=["path", "rating", "keywords", "description", "people"])

    return _files(spark, path, "*.xmp").mapInPandas(run, "path string, rating int, keywords array<string>, description string, people array<string>")


def match_xmp(media: DataFrame, names: DataFrame) -> DataFrame:
    """(id, xmp): a file's own sidecar (name.ext.xmp), else one named like its stem, which goes to the RAW file where
    several share the stem. ``media`` (id, folder, filename, stem, media_type), ``names`` (folder, xmp)."""
    s = names.select("folder", "xmp", F.lower("xmp").alias("low"))
    own = media.select("id", "folder", F.concat(F.lower("filename"), F.lit(".xmp")).alias("low")).join(s, ["folder", "low"]).select("id", "xmp", F.lit(0).alias("rank"))
    by = Window.partitionBy("folder", "stem").orderBy(F.when(F.col("media_type") == "raw", 0).otherwise(1), "id")
    first = media.withColumn("r", F.row_number().over(by)).where("r = 1").select("id", "folder", F.concat("stem", F.lit(".xmp")).alias("low"))
    shared = first.join(s, ["folder", "low"]).select("id", "xmp", F.lit(1).alias("rank"))
    return own.unionAll(shared).groupBy("id").agg(F.min_by("xmp", F.struct("rank", "xmp")).alias("xmp"))


# The columns of the gazetteer's tab-separated file.
GAZETTEER = (
    "geonameid long, name string, asciiname string, alternatenames string, lat double, lon double, fclass string, fcode string, country string, cc2 string, "
    "admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation string, dem string, timezone string, modified string"
)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Populated places that still exist, once each: (geonameid, name, lat, lon, fcode, country, admin1, population)."""
    rows = spark.read.csv(path, schema=GAZETTEER, sep="\t", quote="")
    kept = rows.where((F.col("fclass") == "P") & ~F.coalesce("fcode", F.lit("")).isin("PPLH", "PPLQ", "PPLW"))
    return kept.dropDuplicates(["geonameid"]).select("geonameid", "name", "lat", "lon", "fcode", "country", "admin1", F.coalesce("population", F.lit(0)).alias("population"))


def capture_date(exif: Column, digitized: Column, xmp: Column, named: Column, modified: Column, folder: Column, mtime: Column, ctime: Column) -> Column:
    """Struct (ts, source, confidence): the first date there is, from the most to the least sure. ``named`` is
    the struct of ``date_from_filename``; the others are timestamps."""
    made = lambda ts, source, sure: F.when(ts.isNotNull(), F.struct(ts.alias("ts"), F.lit(source).alias("source"), F.lit(sure).alias("confidence")))
    exact = F.when(named["precision"] == "datetime", named["ts"])
    return F.coalesce(
        made(exif, "exif", "high"), made(digitized, "exif_digitized", "high"), made(xmp, "xmp", "high"), made(exact, "filename", "medium"), made(modified, "exif_modified", "medium"),
        made(named["ts"], "filename", "medium"), made(folder, "folder", "low"), made(F.least(mtime, ctime), "mtime", "low"),
    )
