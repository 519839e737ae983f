"""Exact duplicates: rows grouped by a 128-bit hash of their content, bytes compared inside groups.

Only hashes, lengths and ids are grouped; texts are read a second time for groups of two rows or more, and each is
compared, byte by byte, with the text of the row its group keeps. A text that shares the hash but differs goes into
another round, among others of its kind, so a collision costs a round and never joins two texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactsheet.llm._common import materialise, only_wanted

#: What is deleted before texts are compared.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without blanks and the control characters 9 to 13; of a null, the empty text."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def content_hash(text: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(text.cast("binary")))


def duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", norm: Callable[[Column], Column] = normalised, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Rows are equal if ``norm`` makes the same bytes of their texts; of equal rows the one with the most code points in
    the original text, then the least id, is kept (a null id last). A null text counts as an empty one, and texts of
    blanks only are equal to it. Rows that repeat an id take part each; of rows that repeat id and text alike exactly one
    is kept. ``text_sha256`` names the normalised text. Texts of any length are compared whole; further columns are
    ignored, whatever their names; an empty table gives an empty table.

    The first row of a group is found by aggregates that combine before the shuffle; members meet its text in a join of
    which Spark splits a large group, its one text going to each part.
    """
    found, rows = [], docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    while True:
        same, differ = _round(rows, norm, hash_of)
        found.append(same)
        if differ is None:
            break
        rows = differ
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _round(rows: DataFrame, norm: Callable[[Column], Column], hash_of: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """(result of all rows but those that differ from the kept row of their hash, those rows (doc_id, text) or None)."""
    text = norm(F.col("text"))
    points = F.coalesce(F.length("text"), F.lit(0))
    hashed = rows.select("doc_id", points.alias("points"), text.alias("norm")).select("doc_id", "points", hash_of(F.col("norm")).alias("hash"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"))
    keys = materialise(hashed, "content-hashes")
    first = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    groups = materialise(keys.groupBy("hash").agg(F.count("*").alias("n"), first).where(F.col("n") > 1).select("hash", "first.less", F.col("first.doc_id").alias("first_id")), "content-groups")

    alone = keys.join(groups.select("hash"), "hash", "left_anti")
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    if not groups.limit(1).count():
        return alone, None

    named = rows.select("doc_id", "text", points.alias("points"), text.alias("norm")).withColumn("hash", hash_of(F.col("norm")))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("points") == -F.col("less"))
    # What may be a group's first row is found by id and length; several rows may be so, and one of their texts is taken.
    openers = groups.select("hash", "less", "first_id").withColumnRenamed("hash", "of")
    at = (F.col("hash") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("points") == -F.col("less"))
    opening = only_wanted(named, "hash", groups, salt=(F.col("doc_id"), F.col("points")), wanted_salt=(F.col("first_id"), -F.col("less")))
    texts = materialise(opening.join(openers.hint("merge"), at).groupBy("hash").agg(F.min("norm").alias("first_norm")), "first-texts")
    firsts = materialise(groups.join(texts, "hash"), "firsts")

    members = only_wanted(named, "hash", groups).join(firsts.hint("merge"), "hash")
    differs = F.col("norm") != F.col("first_norm")
    members = members.select("hash", "doc_id", "first_id", is_first.alias("is_first"), differs.alias("differs"), F.when(differs, F.col("text")).alias("text"), F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"))
    members = materialise(members.withColumn("row", F.monotonically_increasing_id()), "members")
    equal = members.where(~F.col("differs"))
    stats = materialise(equal.groupBy("hash").agg(F.count("*").alias("group_size"), F.min(F.when(F.col("is_first"), F.col("row"))).alias("kept_row")), "group-sizes")
    same = equal.join(stats, "hash").select("doc_id", F.col("first_id").alias("keep_id"), "group_size", (F.col("row") == F.col("kept_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    differ = members.where(F.col("differs")).select("doc_id", "text")
    return alone.unionByName(same), differ if differ.limit(1).count() else None


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, by the rule of ``duplicates``. What goes, not what stays, is
    joined with the rows; of rows that repeat id and text alike one stays."""
    judged = duplicates(docs, id_col=id_col, text_col=text_col)
    marks = judged.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.lit(1).alias("__mark")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows"))
    marks = materialise(marks.where(~F.col("__kept") | (F.col("__rows") > 1)), "duplicate-marks")
    own = F.sha2(normalised(docs[text_col]).cast("binary"), 256)
    of_row = lambda m: docs[id_col].eqNullSafe(m["__id"]) & (own == m["__sha"])
    single = docs.join(marks, of_row(marks), "left_anti")
    repeated = marks.where("__kept")
    again = docs.join(repeated, of_row(repeated), "left_semi")
    longest = again.groupBy(id_col, normalised(F.col(text_col)).alias("__norm")).agg(F.max_by(F.struct(*docs.columns), F.coalesce(F.length(text_col), F.lit(0))).alias("__row"))
    return single.unionAll(longest.select("__row.*"))
