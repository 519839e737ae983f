"""Exact top-k search by inner product over vectors grouped by length.

Vectors fall into length classes, and a class into blocks of bounded size; queries into blocks too. Each pair of a
query block and a vector block is one small task: a query's k-th best score so far and the block's greatest length
give a local cosine threshold, which skips the block, shortens it to its long vectors, or leaves only vectors whose
coordinates lie in the range that threshold allows; what is left is scored exactly. The pairs are the stated query
set against all rows, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.llm._common import materialise

#: From this local cosine threshold on, coordinates prune more than they cost.
COORDINATE_FROM = 0.35

#: Coordinates of a query, largest first, whose ranges are tested.
FOCUS = 3

#: Doubles hold every whole number up to here.
EXACT = 2.0**53


class _Block:
    """A block of vectors of one dimension, longest first, with its coordinates' orders made when first asked for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.units = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        self.largest = np.abs(vectors).max(initial=0.0)
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._sorted:
            order = np.argsort(self.units[:, f], kind="stable")
            self._sorted[f] = order, self.units[order, f]
        return self._sorted[f]

    def candidates(self, query: np.ndarray, norm: float, least: float) -> np.ndarray:
        """Rows whose product with the query may reach ``least``; a superset of those that do."""
        if not len(self.ids) or norm == 0 or least <= 0:
            return np.arange(len(self.ids)) if least <= 0 or norm > 0 else np.zeros(0, np.int64)
        slack = 1e-9
        long_enough = int(np.searchsorted(-self.norms, -(least / norm) * (1 - slack), side="right"))
        if not long_enough:
            return np.zeros(0, np.int64)
        cosine = min(1.0, least / (norm * self.norms[0])) - slack
        if cosine < COORDINATE_FROM:
            return np.arange(long_enough)
        unit = query / norm
        met = np.zeros(len(self.ids), np.int8)
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        for f in focus:
            spread = np.sqrt(max(0.0, 1 - cosine * cosine) * max(0.0, 1 - unit[f] * unit[f])) + slack
            low = -1.0 if unit[f] < 0 and cosine <= -unit[f] else unit[f] * cosine - spread
            high = 1.0 if unit[f] > 0 and cosine <= unit[f] else unit[f] * cosine + spread
            order, values = self.by_coordinate(int(f))
            met[order[np.searchsorted(values, low - slack) : np.searchsorted(values, high + slack, side="right")]] += 1
        return np.flatnonzero(met[:long_enough] == len(focus))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products as whole numbers: by doubles where these are exact, else by 64-bit integers."""
        if self.largest * np.abs(query).max(initial=0.0) * len(query) < EXACT:
            return (self.vectors[rows] @ query).astype(np.int64)
        return self.vectors[rows].astype(np.int64) @ query.astype(np.int64)


def _search(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best of the block that reach the query's threshold (null: none yet)."""
    found: list[tuple] = []
    by_size = {n: _Block(part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_numpy())) for n, part in block.groupby(block["v"].map(len))} if len(block) else {}
    for query_id, vector, least in zip(queries["query_id"], queries["q"], queries["least"], strict=True):
        part = by_size.get(len(vector))
        if part is None:
            continue
        query = np.asarray(vector, np.float64)
        open_ended = least is None or np.isnan(least)
        rows = np.arange(len(part.ids)) if open_ended else part.candidates(query, float(np.sqrt(query @ query)), float(least))
        rows = rows[part.ids[rows] != query_id]
        scores = part.scores(rows, query)
        if not open_ended:
            reach = scores >= least
            rows, scores = rows[reach], scores[reach]
        if len(scores) > k:
            reach = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[reach], scores[reach]
        best = np.lexsort((part.ids[rows], -scores))[:k]
        found += zip([query_id] * len(best), part.ids[rows[best]].tolist(), scores[best].tolist(), strict=True)
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int, *, classes: int = 16, block: int = 4096, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products, ties to the smaller vec_id.

    ``queries`` (query_id long, q array<double>) and ``vectors`` (vec_id long, v array<double>) hold whole numbers; a
    vector is no candidate of the query with its own id, nor of one of another dimension. With fewer candidates than
    ``k``, all are returned; without any, the query has no row. Vectors of zeros take part, as queries and as candidates. Products must fit 64 bits. Rows that repeat a vec_id are
    candidates each; of queries that repeat an id, the best of all are returned together.
    """
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    vectors = materialise(vectors.select("vec_id", "v", norm.alias("norm"), F.monotonically_increasing_id().alias("row")), "vectors")
    cuts = vectors.agg(F.percentile_approx("norm", F.array(*[F.lit(i / classes) for i in range(1, classes)]), F.lit(10_000)).alias("c")).first()["c"] or []
    length_class = sum((F.when(F.col("norm") > F.lit(float(x)), 1).otherwise(0) for x in sorted(set(cuts))), F.lit(0))
    classed = vectors.withColumn("class", length_class)
    sizes = classed.groupBy("class").agg(F.count("*").alias("n")).orderBy("class").collect()  # at most ``classes`` rows
    if not sizes:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    first_block, parts, total = {}, {}, 0
    for r in sizes:
        first_block[r["class"]], parts[r["class"]] = total, -(-r["n"] // block)
        total += parts[r["class"]]
    of_class = lambda table: F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), F.col("class"))
    blocked = classed.select("vec_id", "v", (of_class(first_block) + F.pmod(F.xxhash64("row"), of_class(parts))).cast("int").alias("block"))  # by row: rows that repeat an id are dealt too
    query_blocks = max(1, -(-queries.count() // query_block))
    asked = queries.select("query_id", "q", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(query_blocks)).cast("int").alias("query_block"))
    result = "query_id long, vec_id long, score long"
    every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block")

    # The first threshold: each query's k-th best among a block of the longest vectors. A real score, so nothing better is lost.
    longest = blocked.where(F.col("block") == first_block[sizes[-1]["class"]]).select("vec_id", "v", every)
    first = (
        asked.withColumn("least", F.lit(None).cast("double"))
        .groupBy("query_block")
        .cogroup(longest.groupBy("query_block"))
        .applyInPandas(lambda a, b: _search(a, b, k), result)
        .groupBy("query_id")
        .agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
    )
    # How long a vector must be to reach a query's threshold; queries of like need are put together, so that whole blocks
    # of them pass by the blocks of shorter vectors: the first pruning by length.
    # A query of zeros scores 0 with every vector and needs no length.
    need = F.try_divide(F.col("least"), F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)))
    asked = materialise(asked.drop("query_block").join(first, "query_id", "left").withColumn("need", F.coalesce(F.nullif(need, F.lit(float("inf"))), F.lit(float("-inf")))), "asked")
    groups = min(classes, query_blocks)
    cut_at = F.array(*[F.lit(i / groups) for i in range(1, groups)]).cast("array<double>")
    needs = asked.agg(F.percentile_approx("need", cut_at, F.lit(10_000)).alias("c")).first()["c"] or [] if groups > 1 else []
    need_class = sum((F.when(F.col("need") > F.lit(float(x)), 1).otherwise(0) for x in sorted(set(needs)) if math.isfinite(x)), F.lit(0))
    parts_of_need = max(1, -(-query_blocks // groups))
    asked = asked.withColumn("query_block", (need_class * parts_of_need + F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(parts_of_need))).cast("int"))
    blocks = blocked.groupBy("block").agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("longest"))
    pairs = asked.groupBy("query_block").agg(F.min("need").alias("least_need")).join(blocks, F.col("least_need") <= F.col("longest") * (1 + 1e-9)).select("block", "query_block")
    pairs = materialise(pairs, "block-pairs")  # a row for each block of vectors and block of queries that must meet
    key = ["block", "query_block"]
    asked = asked.select("query_id", "q", "least", "query_block").join(pairs, "query_block")
    near = asked.groupBy(*key).cogroup(blocked.join(pairs, "block").groupBy(*key)).applyInPandas(lambda a, b: _search(a, b, k), result)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
