"""Training-order materialisation: token sequences written in a keyed pseudo-random order as fixed-stride shards.

A Feistel network keyed by a number permutes the sequences' places; places outside the domain are walked along their
cycle until they fall inside. Ranges of permuted places are the shards: each is one file of records of the same size,
written in order by one task, so a reader can seek to any record and resume there.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.llm._common import materialise, shared_path, shuffle_partitions
from contactsheet.llm.tokens import encode_text, encoder

ROUNDS = 6


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    """A round function: a 64-bit finaliser of the half and the round's key."""
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def feistel(places: np.ndarray, domain: int, key: int) -> np.ndarray:
    """The permutation of range(domain) at ``places``, with cycle-walking. It has an even number of bits to work on,
    fewer than four times the domain, so a place walks four steps at most on average."""
    bits = max(2, (domain - 1).bit_length())
    half = np.uint64((bits + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64((key * (2 * r + 1) + 0x632BE59BD9B4E019 * (r + 1)) % (1 << 64)) for r in range(ROUNDS)]
    out = np.asarray(places, np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> half, out[todo] & mask
            for k in keys:
                left, right = right, left ^ (_mix(right, k) & mask)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= np.uint64(domain)]
    return out.astype(np.int64)


def _write_shard(folder: str, shard: int, stride: int, records: Iterable[bytes]) -> None:
    """One file, complete or absent: written under the attempt's own name, then moved."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    context = TaskContext.get()
    attempt = f"{root}/.{shard:08d}.{context.taskAttemptId() if context else os.getpid()}"
    with system.open_output_stream(attempt) as out:
        for record in records:
            out.write(record.ljust(stride, b"\0"))
    system.move(attempt, f"{root}/shard-{shard:08d}.bin")


def read_shard(folder: str, shard: int, seq_len: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """Records start.. of a shard as (records, seq_len) uint16, by one seek and one read: how a reader resumes."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{root}/shard-{shard:08d}.bin") as data:
        data.seek(start * seq_len * 2)
        raw = data.read() if count is None else data.read(count * seq_len * 2)
    return np.frombuffer(raw, "<u2").reshape(-1, seq_len)


def read_slots(folder: str, seq_len: int, first: int, count: int) -> np.ndarray:
    """Records ``first``.. of the whole order as (records, seq_len) uint16, fewer at its end: the manifest tells the
    shards, each of which is read from the record where the slots begin in it. A reader resumes at any slot."""
    from pyarrow import fs
    from pyarrow import parquet

    system, root = fs.FileSystem.from_uri(folder)
    files = [f.path for f in system.get_file_info(fs.FileSelector(f"{root}/manifest")) if f.path.endswith(".parquet")]
    shards = pa.concat_tables([parquet.read_table(f, filesystem=system) for f in files]).sort_by("first_slot").to_pylist()
    parts, last = [np.zeros((0, seq_len), "<u2")], first + count
    for s in shards:
        start, stop = max(first, s["first_slot"]), min(last, s["first_slot"] + s["records"])
        if start < stop:
            parts.append(read_shard(folder, s["shard"], seq_len, start - s["first_slot"], stop - start))
    return np.concatenate(parts)


def write_in_training_order(
    docs: DataFrame, rank_path: str, pattern: str, *, folder: str | None = None, seq_len: int = 512, end_id: int = 50256, key: int = 20_240_229, shard_mb: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[str, DataFrame]:
    """Writes the shards; returns their folder and the index
    (id_col, part, shard, position, n_tokens, ids_crc32, slot), one row per sequence.

    A document's ids, then ``end_id``, are cut every ``seq_len``; the last sequence is padded with zeros on disk. A
    document reserves as many places as its bytes could need at most (a token has one byte or more), so places are
    known before anything is tokenised and texts are tokenised once; slots number the used places without gaps in
    permuted order: slot = sequences in earlier shards + position in the shard.

    Places follow the order of rows in the input's partitions, so ``docs`` has to be a table scan, which a retried task
    reads in the same order; a scan that is split otherwise than when places were counted, or ids beyond 65,535, stop the
    job with an error. Shards are dealt to tasks in ranges. ``folder``/manifest has each shard's first slot, from which
    ``read_slots`` finds any. A null or empty text is one sequence of its end id; a null id is carried; repeated rows
    are written each; further columns are ignored; an empty table writes no shard.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "training-order")
    rows = docs.select(id_col, text_col)
    reserved = F.floor(F.coalesce(F.octet_length(text_col), F.lit(0)) / F.lit(seq_len)) + 1
    bounds = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(reserved).alias("n")).orderBy("p").collect()  # one row per input split
    domain = max(1, sum(int(x["n"]) for x in bounds))
    shards = max(1, -(-domain * seq_len * 2 // (shard_mb << 20)))
    base, total = {}, 0  # of each split, the places it begins and ends at
    for x in bounds:
        base[x["p"]] = total, total + int(x["n"])
        total += int(x["n"])
    id_type = rows.schema[0].dataType.simpleString()

    def sequences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, split, place, end = encoder(rank_path, pattern), TaskContext.get().partitionId(), None, None
        for batch in batches:
            if place is None:
                if split not in base:
                    raise RuntimeError("the table was split otherwise when its places were counted")
                place, end = base[split]
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                source, number, places, tokens = [], [], [], []
                for i, text in enumerate(part.column(1)):
                    text = text.as_py()
                    ids = np.append(encode_text(text, coder), end_id)
                    if ids.max() > 0xFFFF:
                        raise ValueError("a token's id needs more than two bytes")
                    ids = ids.astype("<u2")
                    for j in range(0, len(ids), seq_len):
                        source.append(i)
                        number.append(j // seq_len)
                        places.append(place + j // seq_len)
                        tokens.append(ids[j : j + seq_len].tobytes())
                    place += len((text or "").encode("utf-8", "replace")) // seq_len + 1
                if place > end:
                    raise RuntimeError("the table was split otherwise when its places were counted")
                slots = feistel(np.array(places, np.uint64), domain, key)
                columns = [part.column(0).take(pa.array(source, pa.int64())), pa.array(number, pa.int64()), pa.array(slots), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "part", "place", "tokens"])

    cut = rows.mapInArrow(sequences, f"`{id_col}` {id_type}, part long, place long, tokens binary")
    cut = cut.withColumn("shard", F.floor(F.col("place") * F.lit(float(shards)) / F.lit(float(domain))).cast("long"))
    tasks = max(1, min(shards, 20 * shuffle_partitions(spark)))
    ordered = cut.repartitionById(tasks, F.floor(F.col("shard") * tasks / F.lit(shards)).cast("int")).sortWithinPartitions("shard", "place")

    def write(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def runs() -> Iterator[tuple[int, pd.DataFrame]]:
            for frame in frames:
                for shard, run in frame.groupby("shard", sort=True):
                    yield int(shard), run

        waiting = None
        stream = runs()
        waiting = next(stream, None)
        while waiting is not None:
            shard, index = waiting[0], []

            def records() -> Iterator[bytes]:
                nonlocal waiting
                position = 0
                while waiting is not None and waiting[0] == shard:  # noqa: B023
                    run = waiting[1]
                    tokens = list(run["tokens"])
                    index.append(  # noqa: B023
                        pd.DataFrame({id_col: run[id_col], "part": run["part"], "shard": run["shard"], "position": np.arange(position, position + len(run)), "n_tokens": [len(x) // 2 for x in tokens], "ids_crc32": [zlib.crc32(x) for x in tokens]})
                    )
                    yield from map(bytes, tokens)
                    position += len(run)
                    waiting = next(stream, None)

            _write_shard(folder, shard, seq_len * 2, records())
            yield from index

    index = ordered.mapInPandas(write, f"`{id_col}` {id_type}, part long, shard long, position long, n_tokens long, ids_crc32 long")
    index = materialise(index, "training-index")
    counts = index.groupBy("shard").agg(F.count("*").alias("n"))  # one row per file
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"), F.col("n").alias("records"))
    bases.coalesce(1).write.parquet(f"{folder}/manifest")  # one row per file
    bases = spark.read.schema(bases.schema).parquet(f"{folder}/manifest").select("shard", "first_slot")
    return folder, index.join(bases, "shard").select(id_col, "part", "shard", "position", "n_tokens", "ids_crc32", (F.col("first_slot") + F.col("position")).alias("slot"))
