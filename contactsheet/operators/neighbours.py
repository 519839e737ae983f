"""Exact nearest neighbours and visual ranking: blocked products of a stated query set against all rows.

Rows are dealt to blocks of bounded size and queries to blocks too; each pair of blocks is one matrix product in one
task, and every query keeps its best per block, so what is shuffled is the answer and not the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.params import DIVERSIFY, DIVERSIFY_LAST, TAG_STORED, TAGS_PER_PHOTO, VISUAL_HEAD, VISUAL_MAX, VISUAL_MIN, VISUAL_SIGMA
from contactsheet.storage import materialise

PRODUCTS = 1 << 20  #: that a task makes at a time, 8 MB; a pair of whole blocks has 16 times as many, in several copies


def unit(rows: pd.Series) -> np.ndarray:
    """The vectors as rows of length 1."""
    m = np.stack(rows.to_numpy()).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1), 1e-8)[:, None]


def knn(queries: DataFrame, rows: DataFrame, k: int, *, least: float | None = None, block: int = 8192, query_block: int = 2048) -> DataFrame:
    """(query_id, rank, id, cosine): the ``k`` nearest by cosine, never the row of the query's own id,
    ties to the lower id; with ``least``, only at that cosine or more. ``queries`` (query_id, vec), ``rows`` (id, vec),
    all of one dimension; a null vector takes no part. Cosines are rounded to 6."""
    queries, rows = queries.where(F.col("vec").isNotNull()), rows.where(F.col("vec").isNotNull())
    nb, nq = max(1, -(-rows.count() // block)), max(1, -(-queries.count() // query_block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query_id", F.col("vec").alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb"), spread(nb).alias("rb"))
    held = rows.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("rb2"), spread(nq).alias("qb2"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        if not len(a) or not len(b):
            return empty
        ids, own = b["id"].to_numpy(), a["query_id"].to_numpy()
        asked, held, keep, found = unit(a["q"]), unit(b["vec"]), min(k, len(ids)), []
        step = max(1, PRODUCTS // len(ids))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            sims = np.round(asked[at : at + step] @ held.T, 6)
            sims[ids[None, :] == some[:, None]] = -np.inf
            if least is not None:
                sims[sims < least] = -np.inf
            floor = -np.partition(-sims, keep - 1, axis=1)[:, keep - 1]
            r, c = np.nonzero((sims >= floor[:, None]) & np.isfinite(sims))
            found.append(pd.DataFrame({"query_id": some[r], "id": ids[c], "cosine": sims[r, c]}))
        return pd.concat(found)

    near = asked.groupBy("qb", "rb").cogroup(held.groupBy("qb2", "rb2")).applyInPandas(run, "query_id long, id long, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")


def scores(rows: DataFrame, vectors: list[list[float]], names: list[str]) -> DataFrame:
    """(id, tag, score): the product of every row's vector with a few given vectors (a vocabulary or one query), which
    travel in the plan because their number is fixed. One pass, no join."""
    matrix = np.array(vectors, np.float64)

    def run(frames):
        for frame in frames:
            s = np.stack(frame["vec"].to_numpy()).astype(np.float64) @ matrix.T
            yield pd.DataFrame({"id": np.repeat(frame["id"].to_numpy(), len(names)), "tag": names * len(frame), "score": np.round(s, 9).ravel()})

    return rows.where(F.col("vec").isNotNull()).select("id", "vec").mapInPandas(run, "id long, tag string, score double")


def zero_shot_tags(scored: DataFrame, *, least: float = TAG_STORED, per_photo: int = TAGS_PER_PHOTO) -> DataFrame:
    """(id, tag, z): a tag's score among its own scores over all photos and among the photo's scores over all
    tags, the lesser of the two deviations; kept at ``least``, ``per_photo`` at most. Statistics cover all photos."""
    by_tag = scored.groupBy("tag").agg(F.avg("score").alias("mean"), (F.stddev_pop("score") + 1e-6).alias("std"))
    z_tag = scored.join(F.broadcast(by_tag), "tag").withColumn("z_tag", (F.col("score") - F.col("mean")) / F.col("std"))  # a row per tag of the fixed vocabulary
    own = Window.partitionBy("id")
    z_photo = (F.col("z_tag") - F.avg("z_tag").over(own)) / (F.stddev_pop("z_tag").over(own) + 1e-6)
    both = z_tag.select("id", "tag", F.round(F.least("z_tag", z_photo), 3).alias("z")).where(F.col("z") >= least)
    return both.withColumn("r", F.row_number().over(own.orderBy(F.col("z").desc(), "tag"))).where(F.col("r") <= per_photo).select("id", "tag", "z")


def visual_cut(scored: DataFrame) -> DataFrame:
    """The rows of one query that stand out: at or above the greater of mean + 1.6 deviations and mean + 0.6
    of the way to the mean of the best 3 (or half a per cent); at least 40, at most 800. ``scored`` is (id, score), written
    once. The best half per cent is summed above an approximate quantile; only the rows about that quantile, about one
    in a hundred thousand, are put in order."""
    scored = materialise(scored.select("id", "score"), "scored")
    facts = scored.agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"), F.count("*").alias("n")).first()
    n = facts["n"]
    if not n:
        return scored
    want = max(3, n // 200)
    share, near = want / n, 1e-5
    ends = F.percentile_approx("score", F.array(F.lit(max(0.0, 1 - share - near)), F.lit(min(1.0, 1 - share + near))), F.lit(200_000))
    low, high = scored.agg(ends.alias("e")).first()["e"]
    above = scored.where(F.col("score") > high).agg(F.count("*").alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("s")).first()
    if above["n"] <= want <= scored.where(F.col("score") >= low).count():
        band = scored.where(F.col("score").between(low, high)).orderBy(F.col("score").desc()).limit(want - above["n"]) if want > above["n"] else scored.limit(0)
        total = above["s"] + (band.agg(F.sum("score").alias("s")).first()["s"] or 0.0)
    else:  # the quantile missed
        total = scored.orderBy(F.col("score").desc()).limit(want).agg(F.sum("score").alias("s")).first()["s"]
    head = total / want if n >= want else total / n
    cut = max(facts["mu"] + VISUAL_SIGMA * facts["sd"], facts["mu"] + VISUAL_HEAD * (head - facts["mu"]))
    best = scored.orderBy(F.col("score").desc(), "id").limit(VISUAL_MAX)
    whole = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "id")  # at most 800 rows
    return best.withColumn("r", F.row_number().over(whole)).where((F.col("score") >= cut) | (F.col("r") <= VISUAL_MIN)).select("id", "score")


def diversify(ranked: DataFrame, limit: int, *, cut: float = DIVERSIFY, last: int = DIVERSIFY_LAST) -> DataFrame:
    """Down a ranked list (rank, id, vec), leaves out what is within ``cut`` of one of the last ``last`` kept; the
    list is a result page of at most three times ``limit`` rows, so one task walks it."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        vectors, kept = unit(frame["vec"]), []
        for i in range(len(frame)):
            if not any(vectors[i] @ vectors[j] > cut for j in kept[-last:]):
                kept.append(i)
            if len(kept) == limit:
                break
        return pd.DataFrame({"place": range(1, len(kept) + 1), "id": frame["id"].to_numpy()[kept]})

    page = ranked.orderBy("rank").limit(3 * limit)
    return page.withColumn("page", F.lit(0)).groupBy("page").applyInPandas(walk, "place int, id long")
