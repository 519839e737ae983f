"""Ranked lexical search by scanning texts with an Aho-Corasick automaton of all search terms.

The automaton holds each term between two guards, and a text is scanned with every separator turned into a guard, so
an output is a whole term; guards are shared by neighbours, as outputs may overlap. One scan gives each document's
counts of the terms and its length: no index of the documents is made. The counts, a small table, give the corpus
figures and then the scores: the terms' outputs are mapped to the items that ask for them, and every task passes on its
best documents of an item only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.llm._common import materialise, parts_of

# What makes up a term, and the figures of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WEIGHT_SCALE, TF_SCALE, TF_ADD, LENGTH_BASE, LENGTH_SHARE = 1000, 1_000_000_000, 20, 100, 50

#: (item, term) pairs of a block of items, in expectation: what a block's automaton and its map to the items hold. More items
#: are more blocks, each with its own scan; an item is never divided.
BLOCK_TERMS = 100_000

GUARD = 0x20
_CODES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else GUARD for b in range(256))


def guarded(text: bytes | None) -> bytes:
    """The text with A-Z lower-cased, every separator a guard, and a guard at either end."""
    return b" " + (text or b"").translate(_CODES) + b" "


def terms(text: Column) -> Column:
    """The text's terms in order, only A-Z lower-cased."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))


def automaton(numbered: list[tuple[int, str]]) -> ahocorasick.Automaton:
    """Finds the number of every term, between guards."""
    found = ahocorasick.Automaton()
    for number, term in numbered:
        found.add_word(f" {term} ", number)
    found.make_automaton()
    return found


def _scan(docs: DataFrame, numbered: list[tuple[int, str]]) -> DataFrame:
    """(row, doc_id, n, terms array<int>, tfs array<int>): of every whole text, its length in terms and the counts of the given ones."""
    known = docs.sparkSession.sparkContext.broadcast(numbered)  # the terms of one block

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(known.value)
        empty = not known.value
        for part in parts_of(batches, 1):
            lengths, sizes, held, counts = [], [], [], []
            for text in part.column(1).cast(pa.binary()).to_pylist():
                plain = guarded(text)
                codes = np.frombuffer(plain, np.uint8) == GUARD
                lengths.append(int(np.count_nonzero(codes[:-1] & ~codes[1:])))
                tf = Counter() if empty else Counter(number for _, number in machine.iter(plain.decode("utf-8", "replace")))
                sizes.append(len(tf))
                held.extend(tf.keys())
                counts.extend(tf.values())
            offsets = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (held, counts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def _scores(counts: DataFrame, items: list[tuple[int, list[int]]], weights: dict[int, int], k: int, figures: tuple[int, int]) -> DataFrame:
    """(item, doc_id, score): of each task of ``counts``, the ``k`` best documents of every item with a score above 0.

    ``items`` are (number, its terms' numbers), ``weights`` those of the terms that occur, ``figures`` N and L.
    """
    order = sorted(weights)
    place = {t: i for i, t in enumerate(order)}
    users: list[list[int]] = [[] for _ in order]
    for at, (_, held) in enumerate(items):
        for t in held:
            if t in place:
                users[place[t]].append(at)
    offsets = np.cumsum([0, *map(len, users)])
    flat = np.array([at for held in users for at in held], np.int64)
    values = np.array([weights[t] for t in order], np.int64)
    shared = counts.sparkSession.sparkContext.broadcast((np.array(order, np.int64), values, offsets, flat, np.array([i for i, _ in items], np.int64)))  # one block's pairs
    total_docs, total_terms = figures

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, start, user, names = shared.value
        best: pa.Table | None = None
        floor = np.zeros(len(names), np.int64)  # no score below an item's k-th best so far is kept
        waiting: list[pa.Table] = []

        def pruned(tables: list[pa.Table]) -> pa.Table:
            table = pa.concat_tables(tables)
            table = table.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
            item = table.column("item").to_numpy()
            head = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
            rank = np.arange(len(item)) - np.repeat(head, np.diff(np.append(head, len(item))))
            score = table.column("score").to_numpy()
            full = rank == k - 1
            floor[item[full]] = score[full]
            return table.filter(pa.array(rank < k))

        step = max(1, min(1000, 4_000_000 // max(1, len(names))))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists, tfs = part.column(2), part.column(3)
                sizes = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(sizes)), sizes)
                term = lists.flatten().to_numpy().astype(np.int64)
                tf = tfs.flatten().to_numpy().astype(np.int64)
                here = np.searchsorted(known, term)
                wanted = (here < len(known)) & (known[np.minimum(here, len(known) - 1)] == term) if len(known) else np.zeros(len(term), bool)
                doc, tf, here = doc[wanted], tf[wanted], here[wanted]
                n = part.column(1).to_numpy()
                m = np.array([LENGTH_BASE - LENGTH_SHARE + LENGTH_SHARE * int(x) * total_docs // total_terms for x in n], np.int64) if total_terms else np.zeros(len(n), np.int64)
                gain = weight[here] * ((TF_SCALE * tf) // (WEIGHT_SCALE * tf + TF_ADD * m[doc]))
                asked = start[here + 1] - start[here]
                index = np.repeat(start[here] - (np.cumsum(asked) - asked), asked) + np.arange(asked.sum())
                score = np.zeros(len(sizes) * len(names), np.int64)
                np.add.at(score, np.repeat(doc, asked) * len(names) + user[index], np.repeat(gain, asked))
                score = score.reshape(len(sizes), len(names))
                row, item = np.nonzero((score > 0) & (score >= floor))
                if len(row):
                    waiting.append(pa.table({"item": item, "score": score[row, item], "doc_id": part.column(0).take(pa.array(row))}))
                if sum(t.num_rows for t in waiting) > 4 * k * len(names):
                    best = pruned(([best] if best is not None else []) + waiting)
                    waiting = []
        if waiting:
            best = pruned(([best] if best is not None else []) + waiting)
        if best is not None and best.num_rows:
            item = pa.chunked_array([names[best.column("item").to_numpy()]])
            yield from pa.table({"item": item, "doc_id": best.column("doc_id"), "score": best.column("score")}).to_batches(max_chunksize=10_000)

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.mapInArrow(run, f"item long, doc_id {kind}, score long")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 50, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``k`` documents of the highest scores above 0, ties to the lesser id.

    N counts the documents with a term, L all their terms, df a term's documents; a term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), and gives w * (1e9 tf div (1000 tf + 20 m)) with m = 50 + (50 n N div L).

    A null text, of document or item, has no term; such items, and items whose terms no document holds, have no row. Rows
    that repeat an item's id are one item with the terms of all; each row of ``docs`` is a document, repeated ids and null
    ids (last among ties) included. Texts are scanned whole; further columns are ignored; empty tables give an empty
    table. The items are the stated query set; blocks of them with ``block_terms`` terms are scanned for one after the other.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = items.select(F.col(item_col).alias("item_id"), F.explode(terms(F.col(item_text))).alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))  # an item's own terms
    held = materialise(held.withColumn("item", F.monotonically_increasing_id()), "items")
    pairs = held.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-pairs // block_terms))
    kind = rows.schema["doc_id"].dataType.simpleString()
    best = held.sparkSession.createDataFrame([], f"item long, doc_id {kind}, score long")
    for block in range(blocks):
        asked = held.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "terms").orderBy("item").collect()  # block_terms pairs
        if not asked:
            continue
        number = {t: i for i, t in enumerate(sorted({t for r in asked for t in r["terms"]}))}
        counts = materialise(_scan(rows, [(i, t) for t, i in number.items()]), "term-counts")
        figures = counts.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = counts.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df")).collect()  # a row a term of the block
        weights = {r["number"]: math.floor(WEIGHT_SCALE * math.log((2 * figures["docs"] + 2) / (2 * r["df"] + 1))) for r in df}
        best = best.unionByName(_scores(counts, [(r["item"], [number[t] for t in r["terms"]]) for r in asked], weights, k, (figures["docs"], figures["terms"])))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    top = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(held.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
