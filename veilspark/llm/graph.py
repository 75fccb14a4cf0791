"""Group-wise work in Python without a frame for each group, and connected components on Spark tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def by_group(df: DataFrame, key: str, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, rows: int = 4096, most: int = 1 << 27) -> DataFrame:
    """Calls `work(table, bounds)` with rows sorted by the long column `key`, whole groups each: bounds are their edges.

    A call gets about `rows` rows or `most` bytes, or one group; callers keep groups small. Partitions are streamed, never
    held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0
        for batch in (whole.slice(lo, rows) for whole in batches for lo in range(0, len(whole), rows)):
            held.append(batch)
            n += len(batch)
            size += batch.nbytes
            if n < rows and size < most:
                continue
            t = pa.Table.from_batches(held)
            k = t.column(key).to_numpy()
            cut = int(np.searchsorted(k, k[-1], "left"))  # the last group may go on
            if cut:
                yield from work(t.slice(0, cut).combine_chunks(), edges(k[:cut]))
                rest = t.slice(cut).combine_chunks()
                held, n, size = rest.to_batches(), len(rest), rest.nbytes
        if n:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from work(t, edges(t.column(key).to_numpy()))

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def edges(sorted_keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def pairs_within(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i < j in the same group, for groups given by their edges."""
    size = np.diff(bounds)
    ahead = np.repeat(bounds[1:], size) - np.arange(bounds[-1]) - 1  # members after each in its group
    i = np.repeat(np.arange(bounds[-1]), ahead)
    j = np.arange(len(i)) - np.repeat(np.cumsum(ahead) - ahead, ahead) + i + 1
    return i, j


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components under links a - b."""
    r = np.arange(n)
    while len(a):
        m = np.minimum(r[a], r[b])
        before = r.copy()
        np.minimum.at(r, a, m)
        np.minimum.at(r, b, m)
        while not np.array_equal(r, q := r[r]):
            r = q
        if np.array_equal(r, before):
            break
    return r


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of `links` (a, b: longs): root is the smallest node reachable.

    Each round every node that has a smaller neighbour points at the smallest, pointers are followed to their ends, and
    links are moved to the ends; a link within one tree goes. At least the larger end of every link points elsewhere
    each round, so few rounds are needed. All state is in tables in the shared folder; joins are between plain tables,
    so that a node with very many links is split by adaptive execution.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    left = written(links.where("a <> b").select(a, b).distinct(), "links")
    forest = None
    while not left.isEmpty():
        point = written(left.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), "p"), "point")
        point = _follow(point)
        if forest is None:
            forest = point
        else:  # what pointed at a node that now points on
            moved = forest.join(point.select(F.col("v").alias("p"), F.col("p").alias("q")), "p", "left").select("v", F.coalesce("q", "p").alias("p"))
            forest = written(moved.unionByName(point.join(forest.select("v"), "v", "left_anti")), "forest")
        up = point.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        down = point.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        half = written(left.join(up, "a").select(F.col("pa").alias("a"), "b").where("a <> b").distinct(), "half")
        full = half.join(down, "b", "left").select("a", F.coalesce("pb", "b").alias("b")).where("a <> b")
        left = written(full.select(a, b).distinct(), "links")
    if forest is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    ends = forest.select(F.col("p").alias("v")).distinct()
    return forest.unionByName(ends.select("v", F.col("v").alias("p"))).select(F.col("v").alias("node"), F.col("p").alias("root"))


def _follow(point: DataFrame) -> DataFrame:
    """Pointers (v, p) followed to their ends, doubling the distance each time."""
    while True:
        on = point.select(F.col("v").alias("p"), F.col("p").alias("q"))
        if point.join(on, "p", "left_semi").isEmpty():
            return point
        point = written(point.join(on, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "point")


def split_large(df: DataFrame, key: str, member: str, count: str, most: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(`key`, `member`, side, `keep`) with every pair of one group's members together in a group of about `most` or fewer.

    A group of more than `most` (by its column `count`) is cut into blocks of half of that by a hash of the member, and
    every two blocks meet in a group of their own, and each with itself. Where two blocks meet, side is 0 or 1 by block:
    pairs of one side are for the block's own group. Elsewhere side is -1.
    """
    n = F.ceil(F.col(count) * 2 / most).cast("long")
    block, k, o = F.pmod(F.xxhash64(F.col(member), F.lit(7)), n), F.col("_k"), F.col("_o")
    large = (
        df.where(F.col(count) > most)
        .withColumn("_k", block)
        .withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
        .withColumn(key, F.xxhash64(key, F.least(k, o), F.greatest(k, o)))
        .withColumn("side", F.when(k == o, -1).when(k < o, 0).otherwise(1))
    )
    return df.where(F.col(count) <= most).select(key, member, F.lit(-1).alias("side"), *keep).unionByName(large.select(key, member, "side", *keep))
