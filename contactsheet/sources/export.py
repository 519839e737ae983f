"""Sinks: sidecars rendered from what people entered, backup plans, and the audit log, as rows to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _escaped(text: Column) -> Column:
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def xmp_sidecars(photos: DataFrame) -> DataFrame:
    """K8: (path, xml), one for each photo with a rating, keywords, names or a description. ``photos`` (folder, filename,
    rating, keywords array, people array, description)."""
    words = F.array_union(F.coalesce("keywords", F.array().cast("array<string>")), F.transform(F.coalesce("people", F.array().cast("array<string>")), lambda p: F.concat(F.lit("People|"), p)))
    items = F.array_join(F.transform(words, lambda w: F.concat(F.lit("<rdf:li>"), _escaped(w), F.lit("</rdf:li>"))), "")
    about = F.coalesce(F.nullif("description", F.lit("")), F.lit(""))
    has = (F.coalesce("rating", F.lit(0)) > 0) | (F.size(words) > 0) | (about != "")
    xml = F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:lr="http://ns.adobe.com/lightroom/1.0/" xmp:Rating="'),
        F.coalesce("rating", F.lit(0)).cast("string"),
        F.lit('"><lr:hierarchicalSubject><rdf:Bag>'),
        items,
        F.lit("</rdf:Bag></lr:hierarchicalSubject><dc:description><rdf:Alt><rdf:li>"),
        _escaped(about),
        F.lit("</rdf:li></rdf:Alt></dc:description></rdf:Description></rdf:RDF></x:xmpmeta>"),
    )
    return photos.where(has).select(F.concat_ws("/", F.nullif("folder", F.lit("")), F.concat("filename", F.lit(".xmp"))).alias("path"), xml.alias("xml"))


def backup_plan(files: DataFrame, target: DataFrame, *, slack: float = 2.0) -> DataFrame:
    """(rel_path, action): copy what the target lacks or holds in an older form, keep what is newer there, and leave
    equal files. Nothing is ever deleted. ``files`` and ``target`` (rel_path, size, mtime)."""
    there = target.select("rel_path", F.col("size").alias("t_size"), F.col("mtime").alias("t_mtime"))
    rows = files.join(there, "rel_path", "left")
    action = (
        F.when(F.col("t_size").isNull(), "copy")
        .when((F.col("size") == F.col("t_size")) & (F.abs(F.col("mtime") - F.col("t_mtime")) <= slack), "equal")
        .when(F.col("t_mtime") > F.col("mtime") + slack, "keep")
        .otherwise("copy")
    )
    return rows.select("rel_path", action.alias("action"))


def audit_rows(changes: DataFrame, action: str, entity: str, key: str, actor: str) -> DataFrame:
    """Log rows to append, one a change, with the row as JSON."""
    return changes.select(F.lit(action).alias("action"), F.lit(entity).alias("entity_type"), F.col(key).alias("entity_id"), F.to_json(F.struct(*changes.columns)).alias("details"), F.lit(actor).alias("actor"))


def utc_of(taken_ts: Column, offset_min: Column, zone: str = "UTC") -> Column:
    """True epoch seconds of a wall clock: by the photo's own offset, else by the zone given."""
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros((taken_ts * 1_000_000).cast("long")), zone)) / 1e6
    return F.when(offset_min.isNotNull(), taken_ts - offset_min * 60).otherwise(local)
