"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes capacity/k. Documents may be cut freely, so each is cut into pieces of
exactly a class's length (k a power of two, so k pieces fill a bin to the last token), and every class fills its bins
with its fixed count k on its own. Workers number their own pieces; the only thing they share is a table of one count
per class and bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.llm._common import materialise, shuffle_partitions
from contactsheet.llm.tokens import OUT_ROWS, encode_text, encoder

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def _tokenizer(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@lru_cache(maxsize=2)
def _special_tokens(json_path: str) -> tuple[str, ...]:
    # The file's tokenizer is not kept for it: few workers meet a text that needs it.
    return tuple(x.content for x in _tokenizer.__wrapped__(json_path).get_added_tokens_decoder().values())


def text_ids(text: str | None, json_path: str, rank_path: str, pattern: str) -> np.ndarray:
    """The ids the ``tokenizers`` file gives a text, as int32.

    The rank file holds the same vocabulary and merges, and its library gives the same ids four times as fast; only
    where a text spells one of the file's special tokens do the two differ, and there the file itself decides.
    """
    if text and any(x in text for x in _special_tokens(json_path)):
        return np.array(_tokenizer(json_path).encode(text, add_special_tokens=False).ids, np.int32)
    return encode_text(text, encoder(rank_path, pattern))


def class_lengths(tokens: int, capacity: int) -> list[int]:
    """The lengths of a document's pieces: whole bins first, then the binary digits of the rest, longest first."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut(docs: DataFrame, json_path: str, rank_path: str, pattern: str, *, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens): every document's tokens, then ``end_id``, cut at class lengths."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    rows = docs.select(id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                source, start, length, crc, total = [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    ids = np.append(text_ids(text.as_py(), json_path, rank_path, pattern), end_id).astype("<u4")
                    done = 0
                    for n in class_lengths(len(ids), capacity):
                        source.append(i)
                        start.append(done)
                        length.append(n)
                        crc.append(zlib.crc32(ids[done : done + n].tobytes()))
                        total.append(len(ids))
                        done += n
                columns = [part.column(0).take(pa.array(source, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {PIECES}")


def fill(pieces: DataFrame, *, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with (sequence_id, offset): each class's pieces dealt into its bins by their rank in the class.

    The rank is a bucket's base, from the table of counts, plus the rank inside the bucket, so no class passes through
    one task. What is left of a class after its last full bin is dealt by the binary digits of its count into
    sequences whose size is a power of two, so that nothing is padded.
    """
    buckets = shuffle_partitions(pieces.sparkSession)
    order = [id_col, "start", "ids_crc32", "doc_tokens"]
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    per_class = Window.partitionBy("length")
    counts = counts.select(
        "length",
        "bucket",
        F.coalesce(F.sum("n").over(per_class.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("n").over(per_class).alias("total"),
    )
    per_bin = F.lit(capacity) / F.col("length")
    counts = counts.withColumn("k", per_bin.cast("long"))
    left = F.col("total") % F.col("k")
    sequences = F.floor(F.col("total") / F.col("k")) + F.bit_count(left)
    classes = counts.groupBy("length").agg(F.first(sequences).alias("sequences"))
    longest_first = Window.partitionBy(F.lit(0)).orderBy(F.col("length").desc())
    classes = classes.select("length", F.coalesce(F.sum("sequences").over(longest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_sequence"))
    counts = counts.join(classes, "length")

    ranked = dealt.withColumn("in_bucket", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)))
    ranked = ranked.join(counts, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("in_bucket") - 1)
    k, bins = F.col("k"), F.floor(F.col("total") / F.col("k"))
    over, rest = F.col("rank") - bins * k, F.col("total") % k
    digit = F.length(F.bin(over.bitwiseXOR(rest))) - 1  # the block of the left-over pieces: the highest digit in which they differ
    above = F.call_function("shiftright", rest, (digit + 1).cast("int"))
    block_start = F.call_function("shiftleft", above, (digit + 1).cast("int"))
    full = F.col("rank") < bins * k
    return ranked.select(
        id_col,
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.when(full, F.floor(F.col("rank") / k)).otherwise(bins + F.bit_count(above))).cast("long").alias("sequence_id"),
        (F.when(full, F.col("rank") % k).otherwise(over - block_start) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, json_path: str, rank_path: str, pattern: str, *, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    A null or empty text is its end id alone. A null id is carried; repeated rows are packed each; further columns are
    ignored; an empty table gives an empty table. Ties in the order of pieces are between equal pieces.
    """
    pieces = materialise(cut(docs, json_path, rank_path, pattern, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    return fill(pieces, capacity=capacity, id_col=id_col)
