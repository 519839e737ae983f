"""Incremental maintenance as new snapshots: differences, guarded upserts, and what a change touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.operators.predicates import live


def snapshot_diff(known: DataFrame, listing: DataFrame, *, complete: bool = True, slack: float = 1.0, unread: DataFrame | None = None) -> DataFrame:
    """S3: (root_id, rel_path, change): new, changed (size, or a time more than ``slack`` seconds off), unchanged,
    restored, or missing. Missing is told only of a ``complete`` listing, only of roots that list anything, never of what
    went on purpose (trashed, deleted), and not of what lies at or below an ``unread`` path (root_id, rel_path; "" is the
    root): a file meets these by its own ancestors, so a scan that could not read some folders still tells the rest.
    ``known`` (root_id, rel_path, size, mtime, status), ``listing`` (root_id, rel_path, size, mtime)."""
    k = known.select("root_id", "rel_path", F.col("size").alias("k_size"), F.col("mtime").alias("k_mtime"), "status")
    n = listing.select("root_id", "rel_path", F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"), F.lit(True).alias("listed"))
    alive = listing.select("root_id").distinct().withColumn("alive", F.lit(True))
    both = k.join(n, ["root_id", "rel_path"], "full").join(alive, "root_id", "left")
    differs = ~F.col("k_size").eqNullSafe(F.col("n_size")) | (F.abs(F.col("k_mtime") - F.col("n_mtime")) > slack)
    change = (
        F.when(F.col("listed").isNull(), F.when(F.col("alive") & F.lit(complete) & ~F.col("status").isin("missing", "trashed", "deleted"), "missing"))
        .when(F.col("status").isNull(), "new")
        .when(F.col("status") == "missing", "restored")
        .when(F.coalesce(differs, F.lit(True)), "changed")
        .otherwise("unchanged")
    )
    found = both.select("root_id", "rel_path", change.alias("change")).where(F.col("change").isNotNull())
    if unread is None:
        return found
    parts = F.split("rel_path", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    gone = found.where("change = 'missing'")
    hidden = gone.select("root_id", "rel_path", F.explode(above).alias("above")).join(unread.select("root_id", F.col("rel_path").alias("above")).distinct(), ["root_id", "above"], "left_semi")
    return found.where("change <> 'missing'").unionAll(gone.join(hidden.select("root_id", "rel_path").distinct(), ["root_id", "rel_path"], "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], priority: Column) -> DataFrame:
    """K3: one row a key: the one of higher ``priority``, of equal ones the new. So a user's row outranks a derived one,
    and a later derived one replaces an earlier."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(priority.desc(), F.col("__new").desc()))
    return both.withColumn("__r", rank).where("__r = 1").drop("__r", "__new")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K4: ``old`` and the rows of ``new`` whose keys it lacks, once each."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def changes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """K5: (keys, change): insert, update or delete; equal rows, nulls included, are left out."""
    a = old.select(*keys, F.struct(*values).alias("a"), F.lit(True).alias("in_old"))
    b = new.select(*keys, F.struct(*values).alias("b"), F.lit(True).alias("in_new"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "delete").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    return both.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def moved_files(missing: DataFrame, found: DataFrame) -> DataFrame:
    """K1: (old_id, new_id): a new file with a missing one's content is that file moved; each takes part once."""
    pairs = missing.select(F.col("id").alias("old_id"), "sha256").join(found.select(F.col("id").alias("new_id"), "sha256"), "sha256")
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("new_id").orderBy("old_id"))).where("r = 1")
    return first.withColumn("r", F.row_number().over(Window.partitionBy("old_id").orderBy("new_id"))).where("r = 1").select("old_id", "new_id")


def overrides(photos: DataFrame, corrected: DataFrame) -> DataFrame:
    """A user's date and place come before derived ones. ``corrected`` (photo_id, user_ts, user_place)."""
    return photos.join(corrected, photos["id"] == corrected["photo_id"], "left").select(photos["id"], F.coalesce("user_ts", "taken_ts").alias("taken_ts"), F.coalesce("user_place", "place_id").alias("place_id"))


def grid_rows(photos: DataFrame) -> DataFrame:
    """K6: the grid's payload, a row a photo: shape within 0.2 to 6 (turned by a quarter for the rotations that do so),
    time, rating, the seconds of a film, and flags: 1 favourite, 2 faces, 4 film, 8 live, 16 head of a stack. ``rotation``
    in degrees is 0 where there is no such column."""
    turned = F.coalesce(F.col("rotation"), F.lit(0)) % 180 != 0 if "rotation" in photos.columns else F.lit(False)
    across, down = F.when(turned, F.col("height")).otherwise(F.col("width")), F.when(turned, F.col("width")).otherwise(F.col("height"))
    ratio = F.least(F.lit(6.0), F.greatest(F.lit(0.2), across / F.nullif(down, F.lit(0))))
    marks = ((1, F.col("rating") >= 5), (2, F.col("face_count") > 0), (4, F.col("media_type") == "video"), (8, live()), (16, F.col("stack_id") == F.col("id")))
    flags = sum((F.when(on, bit).otherwise(0) for bit, on in marks), F.lit(0))
    return photos.select("id", F.round(ratio, 3).alias("ratio"), F.col("taken_ts").alias("ts"), F.coalesce("rating", F.lit(0)).alias("rating"), F.when(F.col("media_type") == "video", F.round("duration").cast("long")).alias("seconds"), flags.cast("int").alias("flags"))
