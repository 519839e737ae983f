"""Helpers the operators of this subpackage share: parts of batches, small column expressions, usable vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactsheet.storage import materialise, shared_dir, shared_path

__all__ = ["crc_mod", "materialise", "shared_dir", "shared_path", "only_wanted", "parts_of", "shuffle_partitions", "slices", "usable_vectors"]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows, so that what a task makes of long texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def parts_of(batches: Iterable[pa.RecordBatch], column: int, *, size: int = 4 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts that hold at most ``size`` bytes of one text column, or a single row, and ``rows`` rows."""
    for batch in batches:
        lengths = np.array([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            reach = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            stop = min(max(reach, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def only_wanted(rows: DataFrame, key: str, wanted: DataFrame, *, salt: tuple[Column, ...] = (), wanted_salt: tuple[Column, ...] = (), most_bits: int = 1 << 29, bits_a_key: int = 16) -> DataFrame:
    """``rows`` without most of those whose ``key`` (with ``salt``) is not among the keys of ``wanted`` (with
    ``wanted_salt``); none that is goes missing. Keys are not null.

    A filter of ``bits_a_key`` bits a wanted key, ``most_bits`` (64 MB) at most, is broadcast, so that rows are held back
    before a shuffle. Where more is wanted than that allows, it holds back fewer.
    """
    size = min(most_bits, bits_a_key << max(1, wanted.count()).bit_length())
    place = lambda *of: F.pmod(F.xxhash64(*of), F.lit(size))
    bits = wanted.select(place(F.col(key), *wanted_salt).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))
    at = F.bitmap_bit_position(place(F.col(key), *salt))
    octet = F.conv(F.hex(F.substring(F.col("__bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("__bucket", F.bitmap_bucket_number(place(F.col(key), *salt))).join(F.broadcast(bits), "__bucket")  # most_bits / 8 bytes at most
    return marked.where(F.getbit(octet, (at % 8).cast("int")) == 1).select(*rows.columns)


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of the column's decimal text, modulo ``mod``; null for a null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def usable_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, drop_zero: bool = False) -> DataFrame:
    """(id_col, vector_col as array<double>): the rows whose vectors can be scored.

    Left out: a null id, a null or empty vector, a vector with a null, NaN or infinite component and, with
    ``drop_zero``, one whose components are all 0. Rows that repeat an id stay, and take part each.
    """
    vector = F.col(vector_col).cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    keep = F.col(id_col).isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & ~odd
    if drop_zero:
        keep &= F.exists(vector, lambda x: x != 0)
    return embeddings.where(F.coalesce(keep, F.lit(False))).select(F.col(id_col).cast("long").alias(id_col), vector.alias(vector_col))
