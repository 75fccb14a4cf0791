"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

1. One pass over the texts gives each document its set's size, a 128-bit fingerprint and minwise tokens. Documents
   with equal sets fall together; one stands for all.
2. In each of a few trees a node's documents go, at every level, to a few children: those with the same minwise token
   under a function that the level selects. A pair at the threshold stays together in a child with its similarity as
   probability, so with two branches it is lost from a tree with a chance of 3 % at most at 0.85 (6 % at 0.8).
   `Plan` takes as many trees as leave 1e-4 of that. Only nodes of more than LEAF documents branch.
3. In each small node all pairs' similarities are estimated from the minwise tokens; documents without a partner near
   the threshold leave. Nodes left with the same members are the same work and count once.
4. Full sets, read again from the texts for what is left, decide each pair in the node. A node gives each document's
   smallest linked companion, never the pairs, and components are found on these links.
5. Nodes that are large and that branching doesn't help, or at the last level, are mostly near copies of each other. They
   are cut into blocks, and each block goes through 3 and 4 with a few documents of the node, the pivots, added: time in
   proportion to the node. Then those that are not in the node's largest component so far are compared with all of the node, in
   pairs of blocks. Two documents of one component needn't be compared, so nothing is lost at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import textbytes as tb
from .graph import by_group, components, pairs_within, roots, split_large

WIDTH = 5
LEVELS, LEAF, WIDE = 6, 256, 4
MINS = 64
#: Shingles of full sets that a task holds at once, if no two documents have more.
HELD = 6_000_000
_RNG = np.random.default_rng(99)
_MULTIPLY = _RNG.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Plan:
    """Branches, independent trees and minwise tokens for pairs at `percent`: lost with a chance of `miss` at most.

    With b branches the chance q of losing a pair of similarity s in one tree, however deep, solves q = (1 - s + s q) ** b.
    Every tree and level has minwise tokens of its own.
    """

    def __init__(self, percent: int, levels: int = LEVELS, miss: float = 1e-4):
        if not 30 <= percent <= 100:
            raise ValueError("percent must be between 30 and 100")
        self.percent, self.levels, s = percent, levels, percent / 100
        self.branch = 2 if s >= 0.75 else int(np.ceil(1.5 / s))
        q = 0.0
        for _ in range(10_000):
            q = (1 - s + s * q) ** self.branch
        self.trees = 1 if q <= miss else int(np.ceil(np.log(miss) / np.log(q)))
        self.mins = max(MINS, self.trees * levels * self.branch)
        #: fewer equal minwise tokens than this have a chance below 1e-5 at the threshold
        self.least = int(np.floor(self.mins * s - 4.5 * np.sqrt(self.mins * s * (1 - s))))


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, and their rows, in order of rows."""
    data = tb.LOWER[data]
    starts, stops, row, count = tb.words(data, off)
    word = tb.hashes(data, starts, stops)
    found, at = tb.windows(word, row, WIDTH)
    rows = row[at]
    short = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(short):  # the whole sequence is one shingle
        first = np.searchsorted(row, short)
        whole = np.array([_whole(word[f : f + c]) for f, c in zip(first, count[short], strict=True)], np.uint64)
        found, rows = np.concatenate([found, whole]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        found, rows = found[order], rows[order]
    key = tb.mix(found + tb.mix(rows.astype(np.uint64)))
    order = np.argsort(key)
    ranked = key[order]
    once = np.ones(len(key), bool)
    once[order[1:][ranked[1:] == ranked[:-1]]] = False
    return found[once], rows[once]


def _whole(words: np.ndarray) -> int:
    h = np.uint64(len(words))
    with np.errstate(over="ignore"):
        for w in words:
            h = tb.mix(np.array([h * np.uint64(31) + w], np.uint64))[0]
    return h


def fingerprints(found: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit sums for each of n rows that identify its set."""
    out = np.zeros((2, n), np.int64)
    edge = np.searchsorted(rows, np.arange(n + 1))
    for k in range(2):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(found * _MULTIPLY[k] + np.uint64(k)))])
        out[k] = (sums[edge[1:]] - sums[edge[:-1]]).view(np.int64)
    return out


def _sketch(size: int):
    """Step 1: doc_id, n_shingles, f0, f1 and `size` minwise tokens of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in tb.chunks(batch, "text"):
                found, rows = shingles(data, off)
                n = np.bincount(rows, minlength=hi - lo).astype(np.int64)
                has = np.flatnonzero(n)
                edge = np.concatenate([[0], np.cumsum(n)])[:-1][has]
                prints = fingerprints(found, rows, hi - lo)
                mins = np.zeros((hi - lo, size), np.int32)
                if len(has):
                    for k in range(size):
                        mins[has, k] = (np.minimum.reduceat(found * _MULTIPLY[k], edge) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * size, size, dtype=np.int32)), pa.array(mins.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(prints[0]), pa.array(prints[1]), lists], names=["doc_id", "n_shingles", "f0", "f1", "mins"])

    return run


def _near(least: int, count: int):
    """Step 3: (gkey, rep, size) of documents that have a partner in the node by at least `least` of `count` equal minwise tokens."""

    def work(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        rep = t.column("rep").to_numpy()
        mins = t.column("mins").combine_chunks().flatten().to_numpy().reshape(-1, count)
        i, j = pairs_within(bounds)
        alive = np.zeros(len(rep), bool)
        for lo in range(0, len(i), 200_000):
            a, b = i[lo : lo + 200_000], j[lo : lo + 200_000]
            same = np.zeros(len(a), np.int16)
            for k in range(count):
                col = mins[:, k]
                same += col[a] == col[b]
            ok = (same >= least) & (rep[a] != rep[b])
            alive[a[ok]] = True
            alive[b[ok]] = True
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[alive]
        if not len(group):
            return
        rep = rep[alive]
        key = np.zeros(len(bounds) - 1, np.uint64)
        np.add.at(key, group, tb.mix(rep.astype(np.uint64)))
        size = t.column("size").to_numpy()[alive]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)[group]), pa.array(rep), pa.array(size)], names=["gkey", "rep", "size"])

    return work


def _linked(percent: int):
    """Step 4: (a, b) of each document and the smallest that it is joined with in its group, by full sets."""

    def work(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        rep, sets = t.column("rep").to_numpy(), t.column("tokens").combine_chunks()
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            tokens = [np.frombuffer(x, np.uint64) for x in sets.slice(lo, hi - lo).to_pylist()]
            i, j = linked_pairs(tokens, percent)
            order = np.argsort(rep[lo:hi], kind="stable")
            back = np.empty_like(order)
            back[order] = np.arange(hi - lo)
            top = roots(hi - lo, back[i], back[j])  # by rank of id, so that the root has the smallest
            moved = np.flatnonzero(top != np.arange(hi - lo))
            a.append(rep[lo:hi][order[moved]])
            b.append(rep[lo:hi][order[top[moved]]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return work


def linked_pairs(tokens: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of sets with 100 * intersection >= percent * union, from exact intersection sizes."""
    size = np.array([len(x) for x in tokens], np.int64)
    n = len(tokens)
    if n == 2:
        both = len(np.intersect1d(tokens[0], tokens[1], assume_unique=True))
        hit = both and 100 * both >= percent * (size.sum() - both)
        one = np.zeros(int(hit), np.int64)
        return one, one + 1
    _, ids = np.unique(np.concatenate(tokens), return_inverse=True)
    member = np.repeat(np.arange(n), size)
    both = np.zeros((n, n), np.float32)  # whole numbers below 2 ** 24 are exact
    order = np.argsort(ids, kind="stable")
    ids, member = ids[order], member[order]
    for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, 8192):
        x, y = np.searchsorted(ids, [lo, lo + 8192])
        grid = np.zeros((n, 8192), np.float32)
        grid[member[x:y], ids[x:y] - lo] = 1
        both += grid @ grid.T
    both = both.astype(np.int64)
    hit = (both > 0) & (100 * both >= percent * (size[:, None] + size[None, :] - both))
    i, j = np.nonzero(hit)
    return i[i < j], j[i < j]


def _sets(bitmap: bytes):
    """(f0, f1, tokens) of documents that `bitmap` may hold: a fixed-size filter by id, so that few others are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            h = batch.column(0).to_numpy()
            keep = np.flatnonzero((known[h >> 3] >> (h & 7)) & 1)
            few = batch.select(["text"]).take(pa.array(keep))
            for lo, hi, data, off in tb.chunks(few, "text"):
                found, rows = shingles(data, off)
                edge = np.searchsorted(rows, np.arange(hi - lo + 1))
                tokens = [found[edge[k] : edge[k + 1]].tobytes() for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, fingerprints(found, rows, hi - lo)), pa.array(tokens, pa.binary())], names=["f0", "f1", "tokens"])

    return run


BITS = 1 << 22


def _bitmap(ids: DataFrame) -> bytes:
    """BITS bits with those of the ids' hashes set: made in the executors, of one size however many ids there are."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    rows = ids.select(bit.alias("h")).groupBy(F.floor(F.col("h") / 8).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(h % 8 as int))")).alias("v"))
    got = rows.toArrow()
    out = np.zeros(BITS // 8, np.uint8)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy().astype(np.uint8)
    return out.tobytes()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs`; other columns are not read.

    Documents are linked if 100 * intersection >= `percent` * union of their sets of distinct WIDTH-word shingles, words
    lower-cased in A-Z; a shorter text is one shingle. Null text, or text without words, has an empty set and is linked
    with nothing. component_id is the smallest doc_id reachable over links; kept says that it is the row's own. Rows
    with equal ids are one node with the links of all; a row with a null id links with nothing and is kept. An empty
    table gives an empty result.
    """
    plan = Plan(percent, levels)
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(few.mapInArrow(_sketch(plan.mins), "doc_id long, n_shingles long, f0 long, f1 long, mins array<int>"), "sketch")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    # one row and one number for each set; a repeated id with several sets stands for each of them
    reps = full.groupBy("f0", "f1").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size")).withColumn("rep", F.monotonically_increasing_id())
    reps = written(reps, "reps")
    first = full.select("doc_id", "f0", "f1", "mins").join(reps, ["doc_id", "f0", "f1"])
    sketch = written(first.select("rep", "mins", "size").dropDuplicates(["rep"]), "sets")
    found = _links(few, reps, sketch, plan, leaf)
    same = full.join(reps.select("f0", "f1", F.col("doc_id").alias("b")), ["f0", "f1"]).select(F.col("doc_id").alias("a"), "b").where("a <> b")
    names = reps.select("rep", "doc_id")
    found = found.join(names.select(F.col("rep").alias("a"), F.col("doc_id").alias("da")), "a").join(names.select(F.col("rep").alias("b"), F.col("doc_id").alias("db")), "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    ends = written(components(same.unionByName(found)), "components")
    out = rows.join(ends.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    whole = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(whole == F.col("doc_id"), F.lit(True)).alias("kept"))


def _links(few: DataFrame, reps: DataFrame, sketch: DataFrame, plan: Plan, leaf: int) -> DataFrame:
    """(a, b): numbers of sets, linked so that components are those of all links at the threshold."""

    def children(df: DataFrame, level: int) -> DataFrame:
        at = (F.col("tree") * plan.levels + level) * plan.branch
        kids = F.explode(F.array(*(F.xxhash64("node", F.lit(level), F.lit(b), F.element_at("mins", at + b + 1)) for b in range(plan.branch))))
        return df.select("tree", "rep", "parent", kids.alias("node"))

    roots = sketch.select("rep", "mins", F.explode(F.array(*map(F.lit, range(plan.trees)))).alias("tree"))
    nodes = children(roots.withColumn("node", F.col("tree").cast("long")).withColumn("parent", F.lit(None).cast("double")), 0)
    small: list[DataFrame] = []
    stuck: list[DataFrame] = []
    for level in range(1, plan.levels + 1):
        nodes = written(nodes, "nodes")
        counts = written(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
        met = written(nodes.join(counts, "node"), "met")
        # with b children of r times the size each, pairs to compare grow by b r ** 2: branch on while that is below 1
        idle = (plan.branch * F.col("n") ** 2 >= F.col("parent") ** 2) if level < plan.levels else F.lit(True)
        idle = F.coalesce(idle, F.lit(False))
        small.append(met.where(F.col("n") <= leaf).select("node", "rep"))
        large = met.where(F.col("n") > leaf)
        if large.isEmpty():
            break
        stuck.append(large.where(idle).select("node", "rep", "n"))
        nodes = children(large.where(~idle).withColumn("parent", F.col("n").cast("double")).join(sketch, "rep"), level)
    if not stuck:
        return _verified(few, reps, sketch, _union(small), plan)
    hard, leaf = written(_union(stuck), "stuck"), WIDE * leaf  # sketches are small, and fewer blocks are fewer pairs of them
    first = _verified(few, reps, sketch, _union([*small, _with_pivots(hard, leaf)]), plan)
    rest = _apart(hard, first, leaf)
    return first if rest is None else first.unionByName(_verified(few, reps, sketch, rest, plan))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_pivots(hard: DataFrame, leaf: int, pivots: int = 8) -> DataFrame:
    """(node, rep): each node of (node, rep, n) in blocks of about `leaf`, a few members of the node in all of them."""
    block = F.pmod(F.xxhash64("rep", F.lit(7)), F.ceil(F.col("n") / leaf).cast("long"))
    some = hard.groupBy("node").agg(F.array(*(F.min_by("rep", F.xxhash64("rep", F.lit(100 + j))) for j in range(pivots))).alias("some"), F.max("n").alias("n"))
    some = some.select("node", F.explode(F.array_distinct("some")).alias("rep"), F.ceil(F.col("n") / leaf).cast("long").alias("n"))
    both = hard.select("node", "rep", block.alias("k")).unionByName(some.select("node", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")))
    return both.select(F.xxhash64("node", "k", F.lit(1)).alias("node"), "rep").distinct()


def _apart(hard: DataFrame, links: DataFrame, leaf: int) -> DataFrame | None:
    """(node, rep): what is not in its node's largest component under `links`, in pairs of blocks with all of its node; or None."""
    ends = components(links).select(F.col("node").alias("rep"), "root")
    known = written(hard.join(ends, "rep", "left").select("node", "rep", "n", F.coalesce("root", "rep").alias("root")), "known")
    parts = known.groupBy("node", "root").agg(F.count(F.lit(1)).alias("c"))
    top = parts.groupBy("node").agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.max("c").alias("c"), F.sum("c").alias("n"))
    top = written(top.where("c < n").select("node", "top", (F.col("n") - F.col("c")).alias("m")), "top")
    if top.isEmpty():
        return None

    def blocks(count: str):
        return F.ceil(F.col(count) * 2 / leaf).cast("long")

    def all_of(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), blocks(count) - 1))

    both = known.join(top, "node")
    own = F.xxhash64("rep", F.lit(7))
    loose = both.where("root <> top").select("node", "rep", F.pmod(own, blocks("m")).alias("k"), all_of("n").alias("o"))
    every = both.select("node", "rep", all_of("m").alias("k"), F.pmod(own, blocks("n")).alias("o"))
    return loose.unionByName(every).select(F.xxhash64("node", "k", "o", F.lit(2)).alias("node"), "rep").distinct()


def _verified(few: DataFrame, reps: DataFrame, sketch: DataFrame, pieces: DataFrame, plan: Plan) -> DataFrame:
    """Steps 3 and 4 on groups (node, rep) of bounded size."""
    near = by_group(pieces.join(sketch, "rep").select("node", "rep", "mins", "size"), "node", _near(plan.least, plan.mins), "gkey long, rep long, size long").distinct()
    near = written(near, "near")
    alive = written(near.select("rep").distinct().join(reps, "rep"), "alive")
    asked = few.where("doc_id is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("h"), "text")
    sets = asked.mapInArrow(_sets(_bitmap(alive.select("doc_id"))), "f0 long, f1 long, tokens binary")
    sets = sets.join(alive.select("f0", "f1", "rep"), ["f0", "f1"]).select("rep", "tokens").dropDuplicates(["rep"])
    sized = near.join(near.groupBy("gkey").agg(F.sum("size").alias("held")), "gkey")
    groups = split_large(sized, "gkey", "rep", "held", HELD)  # long texts in smaller groups
    return written(by_group(groups.join(sets, "rep").select("gkey", "rep", "tokens"), "gkey", _linked(plan.percent), "a long, b long", rows=256, most=8 * HELD).distinct(), "linked")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, whose id is the smallest of its group; rows without words stay.

    Of rows with equal ids that are kept, all stay.
    """
    gone = written(near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone.withColumnRenamed("doc_id", "__gone"), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    return near_duplicates(table(spark, sf_dir, "documents"))
