"""Bounded samples of labelled documents, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactsheet.llm._common import crc_mod


def held_out(id_col: str = "doc_id", mod: int = 3, remainder: int = 1) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text modulo ``mod`` is ``remainder``; a null id is not."""
    return F.coalesce(crc_mod(id_col, mod) == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label 0/1, weight): about ``per_class`` labelled, not held-out documents of either label.

    Which ones is decided by a hash of the id; ``weight`` is the number of labelled documents one of the sample
    stands for. A document with several labels counts once, with the largest; null labels and null texts do not count.
    """
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    share = {label: min(1.0, per_class / n) for label, n in sizes.items()}
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) < F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)) * 1_000_000
    weight = F.when(F.col("label") == 1, 1.0 / share.get(1, 1.0)).otherwise(1.0 / share.get(0, 1.0))
    few = known.where(chosen).withColumn("weight", weight)
    if sum(min(per_class, n) for n in sizes.values()) <= 100_000:  # the bound of what is broadcast: ids and labels
        few = F.broadcast(few)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(few, "doc_id")
