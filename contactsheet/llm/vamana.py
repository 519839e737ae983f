"""Approximate nearest neighbours over sharded, robustly pruned directed graphs.

Equal vectors are one point, and points are dealt to shards of bounded size. In each, points are inserted by greedy
search from an entry point: what the search meets proposes neighbours, and pruning with a relaxed distance keeps edges
that point in different directions (copies would only point at each other). Queries are answered by beam search in every
shard, which streams them past its graph, and merged; points that several rows have are then told apart by their ids.
Inner products become distances by one more coordinate: with M the shard's greatest length, (x, sqrt(M^2 - |x|^2)) has
the length M, and the nearest points to (q, 0) are those of the largest inner product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.llm._common import materialise


@dataclass(frozen=True)
class GraphParams:
    degree: int = 28  #: edges of a point
    beam: int = 56  #: points a search keeps
    relax: float = 1.2  #: how much nearer a kept neighbour must be to a candidate to make that candidate redundant
    width: int = 4  #: points a search expands at a time
    entries: int = 8  #: of the longest vectors, from which a search for a direction sets out besides the middle one
    batch: int = 256  #: points inserted, or queries asked, together
    seed: int = 11


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The points of one length whose distances order as inner products."""
    squares = (vectors * vectors).sum(axis=1)
    return np.hstack([vectors, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))[:, None]])


def beam_search(points: np.ndarray, edges: np.ndarray, entry: np.ndarray, queries: np.ndarray, keep: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances), each (queries, keep), nearest first; -1 and inf where fewer were met.

    The search sets out from the points ``entry``, at most ``keep`` of them.
    """
    n, m = len(points), len(queries)
    squares = (points * points).sum(axis=1)
    rows = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), bool)
    seen[:, entry] = seen[:, n] = True
    ids = np.full((m, keep), n)
    far = np.full((m, keep), np.inf)
    open_ = np.zeros((m, keep), bool)
    ids[:, : len(entry)], open_[:, : len(entry)] = entry, True
    offset = (queries * queries).sum(axis=1)
    far[:, : len(entry)] = squares[entry] - 2 * queries @ points[entry].T + offset[:, None]
    while open_.any():
        nearest = np.argsort(np.where(open_, far, np.inf), axis=1, kind="stable")[:, :width]
        chosen = np.where(np.take_along_axis(open_, nearest, 1), np.take_along_axis(ids, nearest, 1), n)
        np.put_along_axis(open_, nearest, False, 1)
        next_ = edges[np.minimum(chosen, n - 1)]
        next_[chosen == n] = n
        next_ = next_.reshape(m, -1)
        next_ = np.sort(next_, axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = n
        next_[seen[rows, next_]] = n
        seen[rows, next_] = True
        real = np.minimum(next_, n - 1)
        gap = squares[real] - 2 * np.matmul(points[real], queries[:, :, None])[:, :, 0] + offset[:, None]
        gap[next_ == n] = np.inf
        far, ids, open_ = np.hstack([far, gap]), np.hstack([ids, next_]), np.hstack([open_, next_ < n])
        best = np.argsort(far, axis=1, kind="stable")[:, :keep]
        far, ids, open_ = (np.take_along_axis(x, best, 1) for x in (far, ids, open_))
    ids[~np.isfinite(far)] = -1
    return ids, far


def robust_prune(points: np.ndarray, at: np.ndarray, proposed: np.ndarray, relax: float, degree: int) -> np.ndarray:
    """(len(at), degree) neighbours out of ``proposed`` (-1: none): the nearest first, each removing those it is much nearer to."""
    own = np.sort(proposed, axis=1)
    own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
    own[own == at[:, None]] = -1
    cloud = points[np.maximum(own, 0)]
    squares = (cloud * cloud).sum(axis=2)
    gap = squares - 2 * np.matmul(cloud, points[at][:, :, None])[:, :, 0] + (points[at] ** 2).sum(axis=1)[:, None]
    gap[own < 0] = np.inf
    order = np.argsort(gap, axis=1, kind="stable")
    own, gap, squares = (np.take_along_axis(x, order, 1) for x in (own, gap, squares))
    cloud = np.take_along_axis(cloud, order[:, :, None], 1)
    between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(cloud, cloud.transpose(0, 2, 1))
    alive = np.isfinite(gap)
    out = np.full((len(at), degree), -1)
    rows = np.arange(len(at))
    for slot in range(degree):
        has = alive.any(axis=1)
        if not has.any():
            break
        pick = alive.argmax(axis=1)
        out[:, slot] = np.where(has, own[rows, pick], -1)
        alive &= relax * relax * between[rows, pick] > gap
        alive[rows, pick] = False
    return out


def build_graph(points: np.ndarray, p: GraphParams) -> tuple[np.ndarray, int]:
    """(edges (n, degree) with n for none, entry point) over one shard's points, which are lifted.

    A point proposes what a search for itself meets, and what a search for its own direction does, as a query would: the
    long vectors, which the short ones are far from and would not be tied to.
    """
    n = len(points)
    asked = points.copy()
    asked[:, -1:] = 0
    longest = np.argsort(points[:, -1], kind="stable")[: p.entries]
    random = np.random.default_rng(p.seed)
    edges = np.full((n, p.degree), -1)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    if n > 1:
        edges[:, : min(p.degree // 2, n - 1)] = random.integers(0, n, (n, min(p.degree // 2, n - 1)))
    for relax in (1.0, p.relax):
        order = random.permutation(n)
        for start in range(0, n, p.batch):
            at = order[start : start + p.batch]
            known = np.where(edges < 0, n, edges)
            met, _ = beam_search(points, known, np.array([entry]), points[at], p.beam, p.width)
            wanted, _ = beam_search(points, known, np.unique(np.append(longest, entry)), asked[at], p.beam, p.width)
            edges[at] = robust_prune(points, at, np.hstack([met, wanted, edges[at]]), relax, p.degree)
            source, target = np.repeat(at, p.degree), edges[at].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by_target = np.argsort(target, kind="stable")
            source, target = source[by_target], target[by_target]
            heads, first, counts = np.unique(target, return_index=True, return_counts=True)
            for few in np.array_split(np.arange(len(heads)), max(1, len(heads) // 512)):
                most = int(counts[few].max(initial=0))
                extra = np.full((len(few), most), -1)
                inside = np.arange(most)[None, :] < counts[few][:, None]
                extra[inside] = source[(first[few][:, None] + np.arange(most))[inside]]
                both = np.hstack([edges[heads[few]], extra])
                full = (both >= 0).sum(axis=1) > p.degree
                room = np.sort(both, axis=1)[:, ::-1][:, : p.degree]
                edges[heads[few]] = room
                if full.any():
                    edges[heads[few][full]] = robust_prune(points, heads[few][full], both[full], relax, p.degree)
    return np.where(edges < 0, n, edges), entry


def distinct_points(vectors: DataFrame) -> DataFrame:
    """(node, v, vec_id, copies), written once: every distinct vector, the least id that has it, and how many rows do."""
    points = vectors.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    return materialise(points.withColumn("node", F.monotonically_increasing_id()), "points")


def build_index(points: DataFrame, *, shard_size: int = 4096, params: GraphParams | None = None) -> DataFrame:
    """(dim, shard, pos, node, vec_id, copies, v, edges array<int>, entry): every distinct vector, as a point of its
    shard's graph.

    ``points`` is that of ``distinct_points``. Shards hold about ``shard_size`` points of one dimension, dealt by a hash of
    the point, so a shard's task needs the same memory at every size of the input and however often a vector occurs.
    """
    p = params or GraphParams()
    sized = points.select("node", "vec_id", "copies", "v", F.size("v").alias("dim"))
    shards = sized.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard_size)).alias("shards"))
    dealt = sized.join(F.broadcast(shards) if shards.count() < 1000 else shards, "dim")  # a row per dimension
    dealt = dealt.select("dim", F.pmod(F.xxhash64("node"), F.col("shards")).alias("shard"), "node", "vec_id", "copies", "v")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        edges, entry = build_graph(lifted(np.stack(rows["v"].to_numpy())).astype(np.float32), p)
        return rows.assign(pos=np.arange(len(rows)), edges=list(edges), entry=entry)[["dim", "shard", "pos", "node", "vec_id", "copies", "v", "edges", "entry"]]

    return dealt.groupBy("dim", "shard").applyInPandas(run, "dim int, shard long, pos int, node long, vec_id long, copies long, v array<double>, edges array<int>, entry int")


def _shard_search(points: pd.DataFrame, p: GraphParams, k: int, beam: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function that finds the ``k`` best of one shard's ``points`` for queries (id, v); a query's own row is none."""
    vectors, ids, nodes = np.stack(points["v"].to_numpy()), points["id"].to_numpy(), points["node"].to_numpy()
    copies = points["copies"].to_numpy()
    edges, entry = np.stack(points["edges"].to_numpy()).astype(np.int64), int(points["entry"].iloc[0])
    cloud = lifted(vectors).astype(np.float32)
    keep = min(max(beam, k + 1), len(ids))
    # The search sets out from as many points as it keeps, evenly spread, the middle one among them.
    entries = np.linspace(0, len(ids) - 1, keep).astype(np.int64)
    entries[np.abs(entries - entry).argmin()] = entry
    entries = np.unique(entries)

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        queries, own = np.stack(asked["v"].to_numpy()), asked["id"].to_numpy()
        flat = np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32)
        met, _ = beam_search(cloud, edges, entries, flat, keep, p.width)
        at = np.maximum(met, 0)
        score = np.einsum("mkd,md->mk", vectors[at], queries)
        drop = (met < 0) | ((ids[at] == own[:, None]) & (copies[at] == 1))
        score[drop] = -np.inf
        order = np.lexsort((ids[at], -score), axis=1)[:, :k]
        score, met, drop = (np.take_along_axis(x, order, 1) for x in (score, met, drop))
        found = met.ravel()[~drop.ravel()]
        return pd.DataFrame({"query_id": np.repeat(own, met.shape[1])[~drop.ravel()], "node": nodes[found], "vec_id": ids[found], "copies": copies[found], "score": score.ravel()[~drop.ravel()]})

    return run


def search(index: DataFrame, members: DataFrame, queries: DataFrame, k: int, *, beam: int = 96, params: GraphParams | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products that beam search finds over all shards.

    ``queries`` is (query_id, q array<double>), ``members`` (node, vec_id) the rows of all points that several rows have. A
    query meets the shards of its dimension only, never the vector with its own id; ties go to the smaller vec_id; scores
    are of the given vectors in double precision. Every shard is moved once, to a task that loads it and then streams all
    queries past it: the work is queries times shards, each a search of a few hundred products. Rows that repeat a
    vec_id are candidates each; of queries that repeat an id, the best of all are returned together. Null vectors do not
    belong here (``usable_vectors`` leaves them out); empty tables give an empty table.
    """
    p = params or GraphParams()
    shards = index.select("dim", "shard").distinct().toDF("of_dim", "shard")
    points = index.select("dim", "shard", F.lit(0).alias("kind"), "pos", F.col("vec_id").alias("id"), "v", "node", "copies", "edges", "entry")
    none = lambda kind: F.lit(None).cast(kind)
    asked = queries.join(shards, F.size("q") == F.col("of_dim")).select(F.col("of_dim").alias("dim"), "shard", F.lit(1).alias("kind"), F.lit(0).alias("pos"), F.col("query_id").alias("id"), F.col("q").alias("v"), none("long").alias("node"), none("long").alias("copies"), none("array<int>").alias("edges"), none("int").alias("entry"))
    ordered = points.unionAll(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "pos")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, find = None, [], None
        for frame in frames:
            for (dim, shard, kind), part in frame.groupby(["dim", "shard", "kind"], sort=True):
                if now != (dim, shard):
                    now, held, find = (dim, shard), [], None
                if kind == 0:
                    held.append(part)
                    continue
                if find is None:
                    find, held = _shard_search(pd.concat(held), p, k + 1, beam), []
                for start in range(0, len(part), p.batch):
                    yield find(part.iloc[start : start + p.batch])

    near = ordered.mapInPandas(run, "query_id long, node long, vec_id long, copies long, score double")
    best = lambda n: F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")) <= n
    near = materialise(near.withColumn("keep", best(k + 1)).where("keep").drop("keep"), "near-points")
    # Of a point's rows, the first k + 1 ids suffice (one may be the query's own), and of an id the first k rows.
    of_point = Window.partitionBy("node").orderBy("vec_id")
    few = members.withColumn("d", F.dense_rank().over(of_point)).where(F.col("d") <= k + 1).withColumn("r", F.row_number().over(Window.partitionBy("node", "vec_id").orderBy(F.lit(0)))).where(F.col("r") <= k)
    several = near.where("copies > 1").drop("vec_id").join(few.select("node", "vec_id"), "node").where(F.col("vec_id") != F.col("query_id"))
    rows = near.where("copies = 1").select("query_id", "vec_id", "score").unionAll(several.select("query_id", "vec_id", "score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, shard_size: int = 4096, params: GraphParams | None = None) -> DataFrame:
    """``search`` in a graph index built over all of ``vectors`` (vec_id, v array<double>) and kept in the shared folder."""
    points = distinct_points(vectors)
    index = materialise(build_index(points, shard_size=shard_size, params=params), "graph")
    members = materialise(vectors.join(points.where("copies > 1").select("node", "v"), "v").select("node", "vec_id"), "point-rows")
    return search(index, members, queries, k, params=params)
