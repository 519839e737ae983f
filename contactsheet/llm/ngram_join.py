"""N-gram Jaccard self-join of texts by T-occurrence search.

Two sets of shingles link when their Jaccard similarity reaches num/den; that needs an overlap of T shingles, which
depends on the two sizes alone. The search is of the DivideSkip kind at every level:

* Across the cluster, over a sample of every set: its lowest hashes, so many that linked sets have at least ``need``
  of them in common. Of a set's inverted lists the need - 1 longest are skipped; what is linked still meets in one of
  the short lists. Every short list names its least member as hub, and the sets of one hub form a block.
* In a block, over whole sets: the short lists of a probe are merged by a heap, the long ones probed by binary search
  for the sets that can still reach T, and the overlap is exact.

Sets that are equal are one class from the start. In a block that is too large for one task, members are compared with
the hub. Those that do not link with it are searched once more across the cluster, by the lists of whole sets, where
all but a fifth of a set's shingles are skipped: texts that only share a passage part there. A block that is large even
then is compared with its hub again and only the rest of it in cells, so no task holds more than a bounded number of
shingles (and two sets), and a large group of near copies costs its members rather than their pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactsheet.llm._common import materialise, shuffle_partitions, slices
from contactsheet.llm.shingles import WORDS, set_key, shingle_hashes
from contactsheet.operators.duplicates import components


@dataclass(frozen=True)
class JoinParams:
    num: int = 80  #: sets link when den * overlap >= num * union
    den: int = 100
    words: int = WORDS
    cell_shingles: int = 50_000  #: of one part of a block
    hot_sample: int = 20_000  #: sets, in expectation, among which frequent shingles are looked for
    hot_keys: int = 10_000  #: most shingles that are called frequent, and broadcast
    filter_bits: int = 1 << 29  #: most bits of the filter that holds back texts nobody wants: 64 MB at most are broadcast
    bits_a_text: int = 16  #: of the filter, at least, while they are no more than that

    def overlap(self, a, b):
        """T: the least overlap of linked sets of the sizes a and b."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def smallest(self, n):
        """The least size of a set that may link with one of the size n."""
        return -(-self.num * n // self.den)

    def least_overlap(self, n):
        """The least overlap that a set of the size n has with any set it links with."""
        return self.overlap(n, self.smallest(n))

    @staticmethod
    def margin(n):
        """Sampled shingles that linked sets have in common at least, if both sample ``sampled(n)``."""
        return n // 20 + 1

    def sampled(self, n):
        return np.minimum(n, n - self.least_overlap(n) + self.margin(n))

    def sample_need(self, n: Column) -> Column:
        """Of a set of the size n: sampled shingles in common with whatever it links with."""
        return F.floor(self._smallest(n) / 20) + 1

    def whole_need(self, n: Column) -> Column:
        """``least_overlap`` as a column: shingles of whole sets in common."""
        return F.floor((F.lit(self.num) * (n + self._smallest(n)) + (self.den + self.num - 1)) / (self.den + self.num))

    def _smallest(self, n: Column) -> Column:
        return F.floor((n * self.num + (self.den - 1)) / F.lit(self.den))


class Lists:
    """Inverted lists of a block's sets, kept as one sorted array of (shingle, set) numbers."""

    def __init__(self, sets: list[np.ndarray]):
        self.m = len(sets)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(self.m), [len(s) for s in sets])
        names, at = np.unique(flat, return_inverse=True)
        self.posts = np.sort(at * self.m + owner)
        self.sizes = np.bincount(at, minlength=len(names))
        self.starts = np.cumsum(self.sizes) - self.sizes
        bounds = np.cumsum([0, *(len(s) for s in sets)])
        self.of = [at[bounds[i] : bounds[i + 1]] for i in range(self.m)]  # each set's lists

    def merged(self, lists: np.ndarray, open_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sets, counts): the sets of ``open_to`` that the lists hold, and in how many, from a heap over the sorted lists."""
        sizes = self.sizes[lists]
        index = np.repeat(self.starts[lists] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        who, source = self.posts[index] % self.m, np.repeat(np.arange(len(lists)), sizes)
        wanted = open_to[who]
        who, source = who[wanted], source[wanted]
        runs = np.split(who, np.flatnonzero(np.diff(source)) + 1) if len(who) else []
        found = [(one, sum(1 for _ in same)) for one, same in groupby(heapq.merge(*(run.tolist() for run in runs)))]
        return np.array([one for one, _ in found], np.int64), np.array([count for _, count in found], np.int64)

    def probed(self, lists: np.ndarray, who: int) -> int:
        """How many of the lists hold one set, by binary search."""
        wanted = lists * self.m + who
        found = np.searchsorted(self.posts, wanted)
        return int((self.posts[np.minimum(found, len(self.posts) - 1)] == wanted).sum())


def search(sets: list[np.ndarray], p: JoinParams, *, part: np.ndarray | None = None, every: bool = False) -> list[tuple[int, int, int]]:
    """(i, j, overlap), i < j, of linked sets: all of them, or enough that linked sets stay connected.

    With ``part``, only sets of different parts are compared. Without ``every``, sets already connected are not
    compared again: all are probed for the first set, and then each merges the lists of other components only.
    """
    if len(sets) < 2:
        return []
    lists = Lists(sets)
    n = np.array([len(s) for s in sets])
    root = np.arange(len(sets))  # the least set of each one's component
    out = []

    def allowed(i: int) -> np.ndarray:
        return np.ones(len(sets), bool) if part is None else part != part[i]

    def join(i: int, j: int, overlap: int) -> None:
        out.append((min(i, j), max(i, j), overlap))
        a, b = sorted((root[i], root[j]))
        root[root == b] = a

    if not every:
        for i in np.flatnonzero(allowed(0))[1 if part is None else 0 :].tolist():
            overlap = lists.probed(lists.of[0], i)
            if overlap >= p.overlap(int(n[0]), int(n[i])):
                join(0, i, overlap)
    for i in range(1, len(sets)):
        open_to = allowed(i) & (np.arange(len(sets)) < i) & (n >= p.smallest(int(n[i]))) & (n[i] >= p.smallest(n))
        if not every:
            open_to &= root != root[i]
            open_to[0] = False
        if not open_to.any():
            continue
        own = lists.of[i]
        own = own[np.argsort(-lists.sizes[own], kind="stable")]
        least = int(p.least_overlap(int(n[i])))
        long, short = own[: least - 1], own[least - 1 :]
        near, counts = lists.merged(short, open_to)
        likely = counts + len(long) >= p.overlap(int(n[i]), n[near])
        near, counts = near[likely], counts[likely]
        for at in np.argsort(-counts, kind="stable").tolist():
            j = int(near[at])
            if not every and root[i] == root[j]:
                continue
            overlap = int(counts[at]) + lists.probed(long, j)
            if overlap >= p.overlap(int(n[i]), int(n[j])):
                join(i, j, overlap)
    return out


def shingle_sets(docs: DataFrame, p: JoinParams, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text_hash, n, set_key, sampled array<long>), written once: of every whole text, its set's size, name
    and sample (the upper 48 bits of its lowest hashes).

    A task gives the sample of a set that it meets again only once, so copies cost no more than a sample a task.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for part in slices(batches):
            sizes, keys, samples = [], [], []
            for text in part.column(2):
                hashes = shingle_hashes(text.as_py(), p.words)
                key = set_key(hashes) if len(hashes) else None
                sizes.append(len(hashes))
                keys.append(key)
                samples.append(None if key is None or key in met else (hashes[: int(p.sampled(len(hashes)))] >> np.uint64(16)).view(np.int64))
                met.add(key)
            lengths = pa.array([0 if s is None else len(s) for s in samples])
            offsets = np.concatenate([[0], np.cumsum(lengths.to_numpy())]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *(s for s in samples if s is not None)])
            sampled = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([s is None for s in samples]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), sampled], ["doc_id", "text_hash", "n", "set_key", "sampled"])

    sets = rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, text_hash long, n long, set_key binary, sampled array<long>")
    return materialise(sets.withColumn("row", F.monotonically_increasing_id()), "shingle-sets")


def _blocks(lists: DataFrame, need: Column, p: JoinParams) -> DataFrame:
    """(rep, n, hub): every set that may link with another, once for each hub of its short lists.

    ``lists`` (rep, n, keys); linked sets have at least ``need`` (of their own n) keys in common. The order of lists,
    longest first, is the same for all sets, so the shortest list two linked sets share is short for both.
    Frequent keys, at most ``hot_keys``, are known from a sample beforehand: their lists are long without being
    counted, are dealt to many tasks, and have the least sampled set as hub.
    """
    spark = lists.sparkSession
    posts = lists.select("rep", "n", F.explode("keys").alias("key"))
    share = min(1.0, p.hot_sample / max(1, lists.count()))
    few = posts.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < share * 1_000_000)
    hot = few.groupBy("key").agg(F.count("*").alias("seen"), F.min("rep").alias("hot_hub")).where(F.col("seen") >= 8).orderBy(F.col("seen").desc(), "key").limit(p.hot_keys)
    posts = posts.join(F.broadcast(hot), "key", "left")  # at most ``hot_keys`` rows
    is_hot = F.col("seen").isNotNull()
    posts = posts.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("rep"), F.lit(4 * shuffle_partitions(spark)))).otherwise(F.lit(0)))
    one_list = Window.partitionBy("key", "salt")
    posts = posts.select(
        "rep",
        "n",
        "key",
        F.when(is_hot, F.lit(1 << 40) + F.col("seen")).otherwise(F.count("*").over(one_list)).alias("length"),
        F.when(is_hot, F.col("hot_hub")).otherwise(F.min("rep").over(one_list)).alias("hub"),
    ).where(F.col("length") > 1)
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.col("length").desc(), "key"))
    return posts.withColumn("place", place).where(F.col("place") >= need).groupBy("rep", "hub").agg(F.first("n").alias("n"))


def _sized(blocks: DataFrame, p: JoinParams) -> DataFrame:
    """``blocks`` of two members or more, each with the parts it is to be cut into: (rep, n, hub, parts), written once.

    Both tables are written first: Spark can then split the rows of one hub among the tasks of the join.
    """
    blocks = materialise(blocks, "blocks")
    sizes = blocks.groupBy("hub").agg(F.count("*").alias("members"), F.ceil(F.sum("n") / F.lit(p.cell_shingles)).cast("int").alias("parts"))
    sizes = materialise(sizes.where(F.col("members") > 1).select("hub", "parts"), "block-sizes")
    return materialise(blocks.join(sizes, "hub").select("rep", "n", "hub", "parts"), "sized-blocks")


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("rep", "hub"), parts).cast("int")


def _square(sized: DataFrame) -> DataFrame:
    """(hub, i, j, rep, side): all pairs of a block's parts are cells; in one of two parts, sides are compared with
    each other, in one of a single part (side -1) all with all."""
    dealt = sized.withColumn("part", _part(F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part"))
    return dealt.select("hub", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "rep", side.alias("side"))


def _rest(large: DataFrame, apart: DataFrame, p: JoinParams) -> DataFrame:
    """(hub, i, j, rep, side): what does not link with its hub against the whole block, in cells of bounded size."""
    apart = apart.join(large.select("hub", "rep", "n", "parts"), ["hub", "rep"])
    sizes = materialise(apart.groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(p.cell_shingles)).cast("int").alias("rows")), "rest-sizes")
    probes = apart.join(sizes, "hub").select("hub", _part(F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "rep", F.lit(0).alias("side"))
    index = large.join(sizes, "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), _part(F.col("parts")).alias("j"), "rep", F.lit(1).alias("side"))
    return probes.unionAll(index)


def _with_texts(docs: DataFrame, sets: DataFrame, rows: DataFrame, p: JoinParams, id_col: str, text_col: str) -> DataFrame:
    """``rows`` (rep, ...) with the texts of their sets, read again: cheaper than keeping every whole set.

    A filter of a few bits a wanted text, ``filter_bits`` at most, set by the hashes of those texts, holds back the others
    before they are shuffled. Where a corpus wants more texts than that allows, it holds back fewer; what is found is the
    same.
    A set's text goes by its id and hash, so rows that repeat an id do not meet each other's texts.
    """
    names = sets.select(F.col("row").alias("rep"), "doc_id", "text_hash")
    wanted = materialise(rows.join(names, "rep"), "wanted")
    size = min(p.filter_bits, p.bits_a_text << max(1, wanted.count()).bit_length())
    bit = lambda c: F.pmod(c, F.lit(size))
    bits = wanted.select(bit(F.col("text_hash")).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("own_hash")).where(F.col("text").isNotNull())
    place = F.bitmap_bit_position(bit(F.col("own_hash")))
    octet = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    texts = texts.withColumn("bucket", F.bitmap_bucket_number(bit(F.col("own_hash")))).join(F.broadcast(bits), "bucket")  # filter_bits / 8 bytes at most
    texts = texts.where(F.getbit(octet, (place % 8).cast("int")) == 1).select("own_id", "own_hash", "text")
    # Never a broadcast, which small tables would get: what is wanted grows with the corpus, and merging can spill.
    return texts.join(wanted.hint("merge"), (F.col("own_hash") == F.col("text_hash")) & F.col("own_id").eqNullSafe(F.col("doc_id"))).select(*rows.columns, "text")


def _whole_sets(docs: DataFrame, sets: DataFrame, reps: DataFrame, p: JoinParams, id_col: str, text_col: str) -> DataFrame:
    """(rep, n, keys array<long>), written once: the whole sets of ``reps`` (rep, each once)."""

    def shingle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes = [shingle_hashes(text.as_py(), p.words).view(np.int64) for text in part.column(1)]
            offsets = np.cumsum([0, *map(len, hashes)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(hashes)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) for h in hashes], pa.int64()), keys], ["rep", "n", "keys"])

    texts = _with_texts(docs, sets, reps, p, id_col, text_col)
    return materialise(texts.mapInArrow(shingle, "rep long, n long, keys array<long>").dropDuplicates(["rep"]), "whole-sets")


def _spokes(large: DataFrame, whole: DataFrame, p: JoinParams) -> DataFrame:
    """(hub, rep, overlap), written once: every member of a large block against its hub; a null overlap is no link."""
    members = large.where(F.col("rep") != F.col("hub")).select("hub", "rep").join(whole.select("rep", "keys"), "rep")
    rows = members.join(whole.select(F.col("rep").alias("hub"), F.col("keys").alias("hub_keys")), "hub").select("hub", "rep", "hub_keys", "keys")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            overlaps = []
            for a, b in zip(part.column(2), part.column(3), strict=True):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (a, b))
                found = np.searchsorted(y, x)
                o = int((y[np.minimum(found, len(y) - 1)] == x).sum())
                overlaps.append(o if o >= p.overlap(len(x), len(y)) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(overlaps, pa.int64())], ["hub", "rep", "overlap"])

    return materialise(rows.mapInArrow(run, "hub long, rep long, overlap long"), "spokes")


def _compared(placed: DataFrame, p: JoinParams, every: bool) -> DataFrame:
    """(a, b, overlap): the links of every cell of ``placed`` (hub, i, j, rep, side, and text or keys)."""
    placed = placed.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "rep")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, reps, sides, hashes = None, [], [], []

        def closed() -> Iterator[pa.RecordBatch]:
            if len(reps) > 1:
                links = search(hashes, p, part=None if sides[0] < 0 else np.array(sides), every=every)
                links = [(reps[a], reps[b], o) for a, b, o in links if reps[a] != reps[b]]
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b", "overlap"])

        for batch in batches:
            for hub, i, j, rep, side, raw in zip(*batch.columns, strict=True):
                here, rep, side = (hub.as_py(), i.as_py(), j.as_py()), rep.as_py(), side.as_py()
                if cell != here:
                    yield from closed()
                    cell, reps, sides, hashes = here, [], [], []
                if reps and (rep, side) == (reps[-1], sides[-1]):
                    continue  # rows that repeat an id and its text
                reps.append(rep)
                sides.append(side)
                hashes.append(np.asarray(raw.values).view(np.uint64) if isinstance(raw, pa.ListScalar) else shingle_hashes(raw.as_py(), p.words))
        yield from closed()

    return placed.mapInArrow(compare, "a long, b long, overlap long")


def _links(docs: DataFrame, sets: DataFrame, classes: DataFrame, p: JoinParams, id_col: str, text_col: str, every: bool) -> DataFrame:
    """(a, b, overlap) over classes' numbers: all links, or (not ``every``) enough that what is linked stays connected.

    A large block, such as thousands of near copies of one text, is first compared with its hub: members that link with
    it are connected. The others are searched among themselves by whole sets, since two of them that link share more
    than the frequent shingles that brought them here; so its work grows with its members, not their pairs. Members that
    do not link with a hub may link with ones that do, so a probe of the second search may also be a member that did.
    """
    samples = sets.where(F.col("sampled").isNotNull()).select(F.col("row").alias("rep"), "n", F.col("sampled").alias("keys"))
    blocks = _blocks(samples, p.sample_need(F.col("n")), p).join(classes.select("rep"), "rep", "left_semi")
    sized = _sized(blocks, p)
    small, large = sized.where(F.col("parts") <= 1), sized.where(F.col("parts") > 1)
    cells = lambda blocks: _square(blocks) if every else blocks.select("hub", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", F.lit(-1).alias("side"))
    columns = ["hub", "i", "j", "rep", "side"]
    links = _compared(_with_texts(docs, sets, cells(sized if every else small), p, id_col, text_col).select(*columns, "text"), p, every)
    if every or not large.limit(1).count():
        return links
    whole = _whole_sets(docs, sets, large.select("rep").union(large.select("hub")).distinct(), p, id_col, text_col)
    keyed = lambda cells: cells.join(whole.select("rep", "keys"), "rep").select(*columns, "keys")
    linked = lambda spokes: spokes.where(F.col("overlap").isNotNull()).select("hub", "rep", "overlap")
    spokes = _spokes(large, whole, p)
    # Members of blocks in which at least one is apart from its hub; blocks that their hub holds together are done.
    apart = spokes.where(F.col("overlap").isNull())
    left = large.join(apart.select("hub").distinct(), "hub", "left_semi").select("rep").distinct()
    again = _sized(_blocks(whole.join(left, "rep", "left_semi"), p.whole_need(F.col("n")), p), p)
    small, large = again.where(F.col("parts") <= 1), again.where(F.col("parts") > 1)
    links = links.unionAll(linked(spokes)).unionAll(_compared(keyed(cells(small)), p, every))
    if not large.limit(1).count():
        return links
    spokes = _spokes(large, whole, p)
    rest = _rest(large, spokes.where(F.col("overlap").isNull()).select("hub", "rep"), p)
    return links.unionAll(linked(spokes)).unionAll(_compared(keyed(rest), p, every))


def _classes(sets: DataFrame) -> DataFrame:
    """(set_key, rep, first_doc), written once: one row for each distinct set that is not empty."""
    return materialise(sets.where(F.col("n") > 0).groupBy("set_key").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first_doc")), "classes")


def linked_pairs(docs: DataFrame, p: JoinParams | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): all links between different sets as (a, b, overlap) over classes, and each document's class
    as (doc_id, n_shingles, class); documents of one class are linked with each other and with all links of the class."""
    p = p or JoinParams()
    sets = shingle_sets(docs, p, id_col, text_col)
    classes = _classes(sets)
    pairs = _links(docs, sets, classes, p, id_col, text_col, True).dropDuplicates(["a", "b"])
    members = sets.join(classes.select("set_key", "rep"), "set_key").select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("class"))
    return pairs, members


def _grouped(docs: DataFrame, p: JoinParams, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, linked): the sets of all texts, their classes, and (rep, root) of classes that link with another."""
    sets = shingle_sets(docs, p, id_col, text_col)
    classes = _classes(sets)
    links = _links(docs, sets, classes, p, id_col, text_col, False)
    return sets, classes, components(links.select("a", "b")).select(F.col("node").alias("rep"), "root")


def near_duplicates(docs: DataFrame, p: JoinParams | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): each document's least doc_id reachable over links, itself included.

    A null or empty text, or one without words, has no shingle, links with nothing and is its own component. Rows that
    repeat an id are returned each, by their own texts. A null id takes part and is null in the result; it is a
    component's id only if the component has no other. Further columns are ignored.
    """
    sets, classes, roots = _grouped(docs, p or JoinParams(), id_col, text_col)
    linked = classes.select("rep", "first_doc").join(roots, "rep")
    least = materialise(linked.groupBy("root").agg(F.min("first_doc").alias("component_id")), "component-ids")
    of_linked = linked.join(least, "root").select("rep", "component_id")
    by_set = classes.join(of_linked, "rep", "left").select("set_key", F.coalesce("component_id", "first_doc").alias("component_id"))
    full = sets.where(F.col("n") > 0).select("doc_id", F.col("n").alias("n_shingles"), "set_key").join(by_set, "set_key").select("doc_id", "n_shingles", "component_id")
    empty = sets.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionAll(empty)


def drop_near_duplicates(docs: DataFrame, p: JoinParams | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked texts: the one with the least id (a null id last).

    Rows go by id and text; of rows that repeat both, one stays. Rows without words all stay. What goes, rather than
    what stays, is joined with the texts.
    """
    sets, classes, roots = _grouped(docs, p or JoinParams(), id_col, text_col)
    of_set = classes.join(roots, "rep", "left").select("set_key", F.coalesce("root", "rep").alias("root"))
    members = materialise(sets.where(F.col("n") > 0).select("set_key", "doc_id", "text_hash").join(of_set, "set_key").select("root", "doc_id", "text_hash"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    # Written first, so that Spark can split the rows of a large group among the tasks of the join.
    kept = materialise(members.groupBy("root").agg(first, F.count("*").alias("size")).where(F.col("size") > 1).select("root", "first"), "kept")
    is_kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marks = members.join(kept, "root").groupBy("doc_id", "text_hash").agg(F.first(is_kept).alias("kept"), F.count("*").alias("rows"))
    marks = materialise(marks.where(~F.col("kept") | (F.col("rows") > 1)), "marks")
    text_hash = F.xxhash64(F.col(text_col))
    of_row = lambda m: docs[id_col].eqNullSafe(m["doc_id"]) & (text_hash == m["text_hash"])
    single = docs.join(marks, of_row(marks), "left_anti")
    repeated = marks.where("kept")
    return single.unionAll(docs.join(repeated, of_row(repeated), "left_semi").dropDuplicates([id_col, text_col]))
