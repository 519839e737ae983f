"""File listings as a source: which files of a folder tree count as media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Media file endings.
IMAGES = (".jpg", ".jpeg", ".jpe", ".jfif", ".png", ".webp", ".heic", ".heif", ".avif", ".tif", ".tiff", ".bmp", ".gif")
RAWS = (".cr2", ".cr3", ".nef", ".arw", ".dng", ".orf", ".rw2", ".raf", ".srw", ".pef", ".nrw")
VIDEOS = (".mp4", ".mov", ".m4v", ".3gp", ".avi", ".mkv", ".webm", ".mts", ".m2ts", ".wmv", ".mpg", ".mpeg")
# Folders that never hold media.
SKIPPED_FOLDERS = ("$recycle.bin", "system volume information", "@eadir", ".thumbnails", ".thumbs", ".trash", ".trashes", ".git", "node_modules", "__pycache__", ".picasaoriginals", ".spotlight-v100", ".fseventsd", "#recycle", ".tmp.drivedownload")


def read_listing(spark: SparkSession, root: str, root_id: int = 0) -> DataFrame:
    """(root_id, rel_path, size, mtime) of all files below ``root``, by Spark's own lister; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    tail = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/+", "/")
    return files.select(F.lit(root_id).alias("root_id"), F.ltrim(F.substring(tail, F.length(base) + 1, F.length(tail)), F.lit("/")).alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))


def media(listing: DataFrame) -> DataFrame:
    """``listing`` without empty files, other endings, resource forks, files in the trash of a phone, and whatever
    lies in a skipped or hidden folder, with ``media_type``
    (image, raw or video) and ``folder``, ``filename``, ``stem``, ``ext``."""
    parts = F.split("rel_path", "/")
    rows = listing.withColumn("filename", F.element_at(parts, -1)).withColumn("folder", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    rows = rows.withColumn("ext", F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1))).withColumn("stem", F.lower(F.regexp_replace("filename", r"\.[^.]+$", "")))
    kind = F.when(F.col("ext").isin(*IMAGES), "image").when(F.col("ext").isin(*RAWS), "raw").when(F.col("ext").isin(*VIDEOS), "video")
    skipped = F.exists(F.split(F.lower("folder"), "/"), lambda x: x.isin(*SKIPPED_FOLDERS) | x.startswith("."))
    return rows.withColumn("media_type", kind).where((F.col("size") > 0) & F.col("media_type").isNotNull() & ~F.col("filename").startswith("._") & ~F.lower("filename").startswith(".trashed-") & ~skipped)
