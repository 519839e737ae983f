"""Visual ranking of many searches at once: what stands out from the library for each of a table of search vectors.

A pass over the library takes many searches together, whose vectors go to every task. It keeps, for each search, moments and a
histogram of scores: state of fixed size, which adds up over tasks. The histogram tells from which score on rows can be in
the result, and in which bin the best half per cent ends. A second pass hands on just these rows, and of the half per cent
the sum above that bin and the scores in it, so its mean is exact. Each pass is written before the next one begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.operators.neighbours import unit
from contactsheet.params import VISUAL_HEAD, VISUAL_MAX, VISUAL_MIN, VISUAL_SIGMA
from contactsheet.storage import drop, materialise, shared_path

# Fixed value: fewer results of a search without a filter let the whole library be ranked.
FEW_RESULTS = 20

BINS = 1024  #: of a search's histogram, over cosines from -1 to 1
SEARCHES = 2048  #: that a pass over the library takes together: their vectors go to every task (512 doubles each are 8 MB, the counts 16 MB)
TOGETHER = 256  #: searches of a pass in one product


def _bin(scores):
    return np.clip(((scores + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of ``SEARCHES`` searches at a time; the driver holds one block."""
    ids, vectors = [], []
    for r in queries.where(F.col("vec").isNotNull()).select("query_id", "vec").orderBy("query_id").toLocalIterator():
        ids.append(r["query_id"])
        vectors.append(r["vec"])
        if len(ids) == SEARCHES:
            yield np.array(ids), unit(pd.Series(vectors))
            ids, vectors = [], []
    if ids:
        yield np.array(ids), unit(pd.Series(vectors))


def _products(vectors: np.ndarray, rows: pd.Series) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first search, first row, scores) of a frame's rows and all searches of a pass, in pieces."""
    units = unit(rows)
    for i in range(0, len(vectors), TOGETHER):
        for at in range(0, len(units), 4096):
            yield i, at, np.round(vectors[i : i + TOGETHER] @ units[at : at + 4096].T, 9)


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("vec").isNotNull()).select("id", "vec")


def _totals(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(query_id, mu, sd): of each search's scores of all ``rows``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, np.zeros((2, len(ids)))
        for frame in frames:
            n += len(frame)
            for i, _, scores in _products(vectors, frame["vec"]) if len(frame) else ():
                sums[0, i : i + len(scores)] += scores.sum(axis=1)
                sums[1, i : i + len(scores)] += np.einsum("ij,ij->i", scores, scores)
        if n:
            yield pd.DataFrame({"query_id": ids, "n": n, "s": sums[0], "s2": sums[1]})

    return _moments(_usable(rows).mapInPandas(run, "query_id long, n long, s double, s2 double"))


def _limits(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(query_id, mu, sd, n, end, above, low): of each search the moments and number of its scores of all ``rows``, the bin in
    which its best half per cent ends, how many scores lie above it, and the bin from which on rows can be in its result."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros((len(ids), BINS), np.int64), np.zeros((2, len(ids)))
        for frame in frames:
            for i, _, scores in _products(vectors, frame["vec"]) if len(frame) else ():
                q = len(scores)
                sums[0, i : i + q] += scores.sum(axis=1)
                sums[1, i : i + q] += np.einsum("ij,ij->i", scores, scores)
                counts[i : i + q] += np.bincount((_bin(scores) + np.arange(q)[:, None] * BINS).ravel(), minlength=q * BINS).reshape(q, BINS)
        for i in range(len(ids)) if counts.any() else ():
            full = np.flatnonzero(counts[i])
            yield pd.DataFrame({"query_id": ids[i : i + 1], "s": sums[0, i], "s2": sums[1, i], "first": full[0], "counts": [counts[i, full[0] : full[-1] + 1]]})

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, list] = {}  # of a pass's searches
        for frame in frames:
            for q, s, s2, first, counts in zip(*(frame[c] for c in ("query_id", "s", "s2", "first", "counts")), strict=True):
                own = state.setdefault(q, [0.0, 0.0, np.zeros(BINS, np.int64)])
                own[0], own[1] = own[0] + s, own[1] + s2
                own[2][first : first + len(counts)] += counts
        out, edges = [], np.arange(BINS) / (BINS / 2) - 1
        for q, (s, s2, counts) in state.items():
            n = int(counts.sum())
            mu = s / n
            sd = np.sqrt(max(0.0, s2 / n - mu * mu)) + 1e-6
            down = np.cumsum(counts[::-1])[::-1]  # as many in a bin or above it
            lies = lambda k: int(np.flatnonzero(down >= min(k, n))[-1])  # noqa: B023, E731 - the bin of the k-th best
            want = min(n, max(3, n // 200))
            end = lies(want)
            above = int(down[end] - counts[end])
            head = ((counts[end + 1 :] * edges[end + 1 :]).sum() + (want - above) * edges[end]) / want  # no less than this
            cut = int(_bin(max(mu + VISUAL_SIGMA * sd, mu + VISUAL_HEAD * (head - mu)) - 1e-8))
            out.append((q, mu, sd, n, end, above, max(lies(VISUAL_MAX), min(lies(VISUAL_MIN), cut))))
        yield pd.DataFrame(out, columns=["query_id", "mu", "sd", "n", "end", "above", "low"])

    counted = _usable(rows).mapInPandas(count, "query_id long, s double, s2 double, first int, counts array<long>")
    return counted.repartition("query_id").mapInPandas(fold, "query_id long, mu double, sd double, n long, end int, above long, low int")


def _ends(bins: DataFrame) -> DataFrame:
    """(query_id, end, above, above_sum, want): of each search, the bin in which its best half per cent (three rows at least)
    ends, and what lies above that bin. ``bins`` (query_id, bin, n, s)."""
    down = Window.partitionBy("query_id").orderBy(F.col("bin").desc())  # BINS rows a search
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("query_id"))
    want = F.least(total, F.greatest(F.lit(3), F.floor(total / 200)))
    rows = bins.select("query_id", F.col("bin").alias("end"), "n", want.alias("want"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"), F.coalesce(F.sum("s").over(above), F.lit(0.0)).alias("above_sum"))
    return rows.where((F.col("above") < F.col("want")) & (F.col("above") + F.col("n") >= F.col("want"))).drop("n")


def _heads(ends: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, head): the mean of the best half per cent. ``scores`` (query_id, score, n): the scores of the bin in which it
    ends, equal ones counted together."""
    down = Window.partitionBy("query_id").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = scores.join(ends, "query_id").withColumn("before", F.col("above") + F.coalesce(F.sum("n").over(down), F.lit(0)))
    taken = F.greatest(F.lit(0), F.least("n", F.col("want") - F.col("before")))
    return rows.groupBy("query_id").agg(((F.first("above_sum") + F.sum(taken * F.col("score"))) / F.first("want")).alias("head"))


def _cut(moments: DataFrame, heads: DataFrame) -> DataFrame:
    """(query_id, cut): mean + 1.6 deviations, or mean + 0.6 of the way to the head, whichever is more."""
    cut = F.greatest(F.col("mu") + VISUAL_SIGMA * F.col("sd"), F.col("mu") + VISUAL_HEAD * (F.col("head") - F.col("mu")))
    return moments.join(heads, "query_id").select("query_id", cut.alias("cut"))


def _kept(top: DataFrame, cuts: DataFrame) -> DataFrame:
    """(query_id, rank, id, score): the rows at the cut or above, ``VISUAL_MIN`` at least and ``VISUAL_MAX`` at most."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    ranked = top.withColumn("rank", rank).where(F.col("rank") <= VISUAL_MAX).join(cuts, "query_id")
    return ranked.where((F.col("score") >= F.col("cut")) | (F.col("rank") <= VISUAL_MIN)).select("query_id", "rank", "id", "score")


def _moments(bins: DataFrame) -> DataFrame:
    sums = bins.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    mu = F.col("s") / F.col("n")
    return sums.select("query_id", mu.alias("mu"), (F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mu * mu)) + 1e-6).alias("sd"))


def visual_cuts(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank, id, score): for each search the rows of the library that stand out: at or above the greater
    of mean + 1.6 deviations and mean + 0.6 of the way to the mean of the best half per cent (three at least); forty rows at
    least, eight hundred at most; ties to the lower id. ``rows`` (id, vec), ``queries`` (query_id, vec), of one dimension; null
    vectors take no part; scores are cosines, rounded to nine digits. Statistics cover all rows."""
    spark = rows.sparkSession
    schema = "query_id long, rank int, id long, score double"
    path = shared_path(spark, "visual-cuts")
    spark.createDataFrame([], schema).write.parquet(path)
    for ids, vectors in _blocks(queries):
        limits = materialise(_limits(rows, ids, vectors), "limits")
        known = {r["query_id"]: (r["low"], r["end"]) for r in limits.select("query_id", "low", "end").collect()}  # SEARCHES rows at most
        if not known:
            continue
        low, end = (np.array([known[i][j] for i in ids.tolist()]) for j in (0, 1))
        least = np.minimum(low, end) / (BINS / 2) - 1  # scores have nine digits, as have the edges of bins

        def pick(frames: Iterator[pd.DataFrame], ids=ids, vectors=vectors, low=low, end=end, least=least) -> Iterator[pd.DataFrame]:
            above = np.zeros(len(ids))
            for frame in frames:
                own = frame["id"].to_numpy()
                for i, at, scores in _products(vectors, frame["vec"]) if len(frame) else ():
                    row, col = np.nonzero(scores >= least[i : i + len(scores), None])
                    score, search, bins = scores[row, col], row + i, _bin(scores[row, col])
                    above += np.bincount(search, np.where(bins > end[search], score, 0.0), len(ids))
                    for kind, here in (("top", bins >= low[search]), ("end", bins == end[search])):
                        if here.any():
                            yield pd.DataFrame({"query_id": ids[search[here]], "kind": kind, "id": own[at + col[here]], "score": score[here]})
            yield pd.DataFrame({"query_id": ids, "kind": "above", "id": 0, "score": above})

        picked = materialise(_usable(rows).mapInPandas(pick, "query_id long, kind string, id long, score double"), "picked")
        want = F.least("n", F.greatest(F.lit(3), F.floor(F.col("n") / 200)))
        sums = picked.where("kind = 'above'").groupBy("query_id").agg(F.sum("score").alias("above_sum"))
        ends = limits.select("query_id", "above", want.alias("want")).join(sums, "query_id")
        last = picked.where("kind = 'end'").groupBy("query_id", "score").agg(F.count("*").alias("n"))
        kept = _kept(picked.where("kind = 'top'").select("query_id", "id", "score"), _cut(limits.select("query_id", "mu", "sd"), _heads(ends, last)))
        kept.write.mode("append").parquet(path)
        drop(picked)
    return spark.read.schema(schema).parquet(path)


def ranked_searches(rows: DataFrame, queries: DataFrame, candidates: DataFrame, limit: int = 500) -> DataFrame:
    """(query_id, rank, id, score): the candidates of each search by likeness.

    ``queries`` (query_id, vec, structured): of a structured search (people, place, date) all candidates stay, ``limit`` at
    most, and are only ordered. Of others those stay that stand out among the candidates, against the mean and deviation of
    all ``rows``; where fewer than twenty do, or there is none, the whole library is ranked instead (``visual_cuts``).
    ``candidates`` (query_id, id); ``rows`` (id, vec).
    """
    spark = rows.sparkSession
    schema = "query_id long, rank int, id long, score double"
    path, settled = shared_path(spark, "ranked"), shared_path(spark, "settled")
    spark.createDataFrame([], schema).write.parquet(path)
    spark.createDataFrame([], "query_id long").write.parquet(settled)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    for ids, vectors in _blocks(queries):

        def score(frames: Iterator[pd.DataFrame], ids=ids, vectors=vectors) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), 256):
                    part = frame.iloc[at : at + 256]
                    row = np.repeat(np.arange(len(part)), part["searches"].map(len))
                    asked, own, units = np.concatenate(part["searches"].to_numpy()), part["id"].to_numpy(), unit(part["vec"])
                    for i in range(0, len(row), 65_536):
                        q, r = asked[i : i + 65_536], row[i : i + 65_536]
                        yield pd.DataFrame({"query_id": q, "id": own[r], "score": np.round(np.einsum("ij,ij->i", vectors[np.searchsorted(ids, q)], units[r]), 9)})

        between = lambda df: df.where(F.col("query_id").between(int(ids[0]), int(ids[-1])))  # noqa: B023, E731 - blocks are ranges
        known = between(queries).where(F.col("vec").isNotNull()).select("query_id", "structured")
        # A row's searches are one list, so its vector meets them all at once; at most SEARCHES.
        own = between(candidates).join(known.select("query_id"), "query_id", "left_semi").groupBy("id").agg(F.collect_set("query_id").alias("searches")).join(_usable(rows), "id")
        scored = materialise(own.mapInPandas(score, "query_id long, id long, score double"), "candidate-scores")
        exact = scored.join(known.where("structured"), "query_id", "left_semi").withColumn("rank", rank).where(F.col("rank") <= limit)
        exact.select("query_id", "rank", "id", "score").write.mode("append").parquet(path)

        loose = scored.join(known.where("not structured"), "query_id", "left_semi").withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("score") + 1) * (BINS / 2))).cast("int"))
        ends = materialise(_ends(loose.groupBy("query_id", "bin").agg(F.count("*").alias("n"), F.sum("score").alias("s"))), "ends")
        last = loose.join(ends.select("query_id", F.col("end").alias("bin")), ["query_id", "bin"]).groupBy("query_id", "score").agg(F.count("*").alias("n"))
        some = materialise(_kept(loose.select("query_id", "id", "score"), _cut(_totals(rows, ids, vectors), _heads(ends, last))).where(F.col("rank") <= limit), "standing-out")
        enough = some.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= FEW_RESULTS).select("query_id")
        enough.write.mode("append").parquet(settled)
        some.join(enough, "query_id", "left_semi").write.mode("append").parquet(path)
        drop(scored)
    again = queries.where(~F.col("structured")).join(spark.read.schema("query_id long").parquet(settled), "query_id", "left_anti").select("query_id", "vec")
    return spark.read.schema(schema).parquet(path).unionAll(visual_cuts(rows, again).where(F.col("rank") <= limit))
