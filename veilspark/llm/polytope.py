"""Near-duplicate vectors by cross-polytope hashing with fast Hadamard rotations.

A hash rotates a vector pseudo-randomly (three times: random signs, then a fast Hadamard transform) and names the axis
nearest to it, with its sign. A table's code joins as many hashes as leave few vectors in a bucket. A vector also probes
the buckets it most nearly fell into. The number of tables follows from the chance, measured on simulated pairs at the
threshold, that one table brings a pair together. Signs of the rotated vectors make a sketch of some hundred bits; vectors
without a partner in their bucket by sketches leave it, and only those left travel with their components. Every other
candidate pair is verified by its cosine in double precision, and counted by the first bucket that has it, so that
links are counted exactly and never listed.
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

LEAF, PROBES, MISS = 128, 3, 1e-4
#: Bits of a sketch, if the rotations have as many.
BITS = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


class Hasher:
    """Codes of unit vectors of one dimension: `tables` codes of `hashes` hashes each, and PROBES probes for each code."""

    def __init__(self, dim: int, hashes: int, tables: int, seed: int = 17):
        self.dim, self.hashes, self.tables = dim, hashes, tables
        self.width = max(2, 1 << (dim - 1).bit_length())
        self.seed = seed

    #: Sketches of vectors at the threshold differ in no more bits than this; None for all.
    reach: int | None = None

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, tables) codes and (rows, tables, PROBES) probes, as 64-bit values that hold the table's number."""
        return self.all(x)[:2]

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes and probes, and (rows, bytes) sketches."""
        n = len(x)
        signs: list[np.ndarray] = []
        rng = np.random.default_rng([self.seed, self.dim])
        padded = np.zeros((n, self.width))
        padded[:, : x.shape[1]] = x
        codes = np.zeros((n, self.tables), np.uint64)
        probes = np.zeros((n, self.tables, PROBES), np.uint64)
        for t in range(self.tables):
            best, second, third, gap2, gap3 = (np.zeros((n, self.hashes)) for _ in range(5))
            for k in range(self.hashes):
                y = padded
                for _ in range(3):
                    y = hadamard(y * rng.choice([-1.0, 1.0], self.width)) / np.sqrt(self.width)
                if len(signs) * self.width < BITS:
                    signs.append(y > 0)
                size = np.abs(y)
                for out, gap in ((best, None), (second, gap2), (third, gap3)):
                    at = size.argmax(1)
                    out[:, k] = 2 * at + (y[np.arange(n), at] < 0)
                    top = size[np.arange(n), at]
                    if gap is None:
                        first = top.copy()
                    else:
                        gap[:, k] = first - top
                    size[np.arange(n), at] = -1
            codes[:, t] = self._join(best, t)
            options = np.concatenate([gap2, gap3], axis=1)
            order = np.argsort(options, axis=1, kind="stable")
            for p in range(PROBES):
                pick = order[:, p % order.shape[1]]
                near = best.copy()
                k, which = pick % self.hashes, pick // self.hashes
                near[np.arange(n), k] = np.where(which == 0, second[np.arange(n), k], third[np.arange(n), k])
                probes[:, t, p] = self._join(near, t)
        bits = np.zeros((n, BITS), bool)
        flat = np.concatenate(signs, axis=1)[:, :BITS]
        bits[:, : flat.shape[1]] = flat
        return codes, probes, np.packbits(bits, axis=1)

    def set_reach(self, x: np.ndarray, y: np.ndarray) -> None:
        """Six deviations above the mean of simulated pairs at the threshold; in few dimensions bits depend too much on each other."""
        if self.dim >= 16:
            d = apart(self.all(x)[2], self.all(y)[2])
            self.reach = int(np.ceil(d.mean() + 6 * d.std() + 2))

    def _join(self, values: np.ndarray, table: int) -> np.ndarray:
        out = np.full(len(values), table + 1, np.uint64)
        for k in range(values.shape[1]):
            out = tb.mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, k].astype(np.uint64) + np.uint64(self.dim))
        return out


def meets(codes: tuple, other: tuple) -> np.ndarray:
    """(pairs, tables): whether each pair of rows shares a bucket by code, or by a probe of one and the code of the other."""
    (c, p), (d, q) = codes, other
    return (c == d) | (p == d[:, :, None]).any(2) | (q == c[:, :, None]).any(2)


def plan(dim: int, rows: int, cosine: float) -> Hasher:
    """Enough hashes that about `rows` vectors leave a bucket few, and tables that lose a pair at `cosine` with a chance below MISS."""
    hashes = max(1, round(np.log(max(rows, 2)) / np.log(2 * max(2, 1 << (dim - 1).bit_length()))))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = cosine * x + np.sqrt(1 - cosine**2) * z
    one = Hasher(dim, hashes, 1, seed=18)
    hit = meets(one.codes(x), one.codes(y)).mean()
    out = Hasher(dim, hashes, int(np.ceil(np.log(MISS) / np.log(1 - min(hit, 0.999)))))
    out.set_reach(x, y)
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the rows of sketches differ."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(1, dtype=np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a column of number lists, shorter ones padded with zeros; scaled first, so that nothing overflows."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    x = np.zeros((len(size), max(1, int(size.max(initial=0)))))  # in double precision
    x[np.arange(x.shape[1])[None, :] < size[:, None]] = flat
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hash(hashers: dict[int, Hasher]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 2048):
                batch = whole.slice(lo, 2048)
                vectors = batch.column(2)
                sizes = np.diff(vectors.offsets.to_numpy())
                for dim in np.unique(sizes):
                    at = pa.array(np.flatnonzero(sizes == dim))
                    part = batch.take(at)
                    codes, probes, bits = hashers[int(dim)].all(_matrix(part.column(2)))
                    label = tb.mix(part.column(1).to_numpy().astype(np.uint64) + np.uint64(77))
                    codes ^= label[:, None]
                    probes ^= label[:, None, None]
                    lists = [pa.array(list(v.reshape(len(part), -1).view(np.int64)), pa.list_(pa.int64())) for v in (codes, probes)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array([dim] * len(part), pa.int32())], names=["rep", "codes", "probes", "bits", "dim"])

    return run


def _close(reach: dict[int, int | None]):
    """The rows (key, rep, side, main, bucket) that have a partner in their group by sketches."""

    def work(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        rep, side, main, dim = (t.column(c).to_numpy() for c in ("rep", "side", "main", "dim"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(len(rep), -1)
        far = np.array([BITS if reach[int(d)] is None else reach[int(d)] for d in dim], np.int64)
        i, j = pairs_within(bounds)
        ok = (main[i] | main[j]) & (rep[i] != rep[j]) & ((side[i] < 0) | (side[i] != side[j])) & (dim[i] == dim[j])
        i, j = i[ok], j[ok]
        some = np.zeros(len(rep), bool)
        for lo in range(0, len(i), 100_000):
            a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
            near = apart(bits[a], bits[b]) <= far[a]
            some[a[near]] = some[b[near]] = True
        at = pa.array(np.flatnonzero(some))
        yield from t.select(["key", "rep", "side", "main", "bucket"]).take(at).combine_chunks().to_batches()

    return work


def _verify(cosine: float, tables: int):
    """(v, n, low): how many vectors each is newly linked with in its group, and the smallest it is joined with."""

    def work(t: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, rep, side, main, bucket, mult = (t.column(c).to_numpy() for c in ("key", "rep", "side", "main", "bucket", "mult"))
        x = _matrix(t.column("vector").combine_chunks())
        codes = t.column("codes").combine_chunks().flatten().to_numpy().reshape(len(rep), tables)
        probes = t.column("probes").combine_chunks().flatten().to_numpy().reshape(len(rep), tables, PROBES)
        i, j = pairs_within(bounds)
        ok = (main[i] | main[j]) & (rep[i] != rep[j]) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        cos = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[i[lo : lo + 50_000]], x[j[lo : lo + 50_000]]) for lo in range(0, len(i), 50_000))])
        i, j = i[cos >= cosine], j[cos >= cosine]
        own = [first_bucket((codes[a], probes[a]), (codes[b], probes[b])) for lo in range(0, len(i), 20_000) for a, b in [(i[lo : lo + 20_000], j[lo : lo + 20_000])]]
        fresh = np.concatenate([np.zeros(0, np.int64), *own]) == bucket[i]
        n = np.zeros(len(rep), np.int64)
        np.add.at(n, i[fresh], mult[j[fresh]])
        np.add.at(n, j[fresh], mult[i[fresh]])
        order = np.lexsort((rep, key))  # within its group, by id
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        low = rep[order][roots(len(rep), back[i], back[j])[back]]
        some = np.zeros(len(rep), bool)
        some[i] = some[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(n[some]), pa.array(low[some])], names=["v", "n", "low"])

    return work


def first_bucket(codes: tuple, other: tuple) -> np.ndarray:
    """The one bucket that counts each pair: in the first table that brings it together, by codes if these are equal."""
    (c, p), (d, q) = codes, other
    both, there, back = c == d, (p == d[:, :, None]).any(2), (q == c[:, :, None]).any(2)
    at = np.arange(len(c)), (both | there | back).argmax(1)
    c, d, both, there, back = (v[at] for v in (c, d, both, there, back))
    return np.where(both, c, np.where(there & back, np.minimum(c, d), np.where(there, d, c)))


def near_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `df`; other columns are not read.

    Two vectors are linked if their labels are equal and not null, their lengths are equal, and their cosine is at least
    `cosine`. Vectors that are null or zero, or hold null or non-finite components, and rows with a null id link with
    nothing and are kept. n_links counts the other vectors linked directly, equal ones included. Rows that are equal in
    id, label and vector are one vector; of one id with several vectors each is looked at, their links add up. An empty
    table gives an empty result.
    """
    v = F.col("vector")
    kind = dict(df.dtypes)[vector_col]
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    ids = df.select(F.col(id_col).cast("long").alias("vec_id"))
    all_rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))
    good = v.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    whole = all_rows.where(F.coalesce(good, F.lit(False))).select("*", *(F.xxhash64(F.lit(k), "label", v).alias(f"h{k}") for k in range(2)))  # 128 bits tell vectors apart
    rows = written(whole.select("vec_id", "label", "h0", "h1", F.size(v).alias("dim")).distinct(), "vectors")
    reps = rows.groupBy("h0", "h1").agg(F.min("vec_id").alias("vec_id"), F.min("dim").alias("dim"), F.count(F.lit(1)).alias("mult")).withColumn("rep", F.monotonically_increasing_id())
    reps = written(reps, "reps")
    sizes = {r[0]: r[1] for r in reps.groupBy("dim").count().collect()}  # one row for each length
    if not sizes:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    hashers = {d: plan(d, n, cosine) for d, n in sizes.items()}
    tables = max(h.tables for h in hashers.values())
    for h in hashers.values():
        h.tables = tables
    once = whole.join(reps.select("vec_id", "h0", "h1", "rep", "mult"), ["vec_id", "h0", "h1"]).select("rep", "label", "vector", "mult").dropDuplicates(["rep"])
    once = written(once, "once")
    coded = written(once.select("rep", "label", "vector").mapInArrow(_hash(hashers), "rep long, codes array<long>, probes array<long>, bits binary, dim int"), "codes")
    spots = coded.select("rep", F.explode("codes").alias("key"), F.lit(True).alias("main")).unionByName(coded.select("rep", F.explode(F.array_distinct("probes")).alias("key"), F.lit(False).alias("main")))
    counts = written(spots.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("main").alias("any")).where("n > 1 and any").select("key", "n"), "counts")
    met = spots.join(counts, "key").withColumn("bucket", F.col("key"))
    pieces = split_large(met, "key", "rep", "n", leaf, ("main", "bucket"))
    close = by_group(pieces.join(coded.select("rep", "bits", "dim"), "rep"), "key", _close({d: h.reach for d, h in hashers.items()}), "key long, rep long, side int, main boolean, bucket long", rows=2048)
    close = written(close, "close")
    payload = coded.select("rep", "codes", "probes").join(once.select("rep", "vector", "mult"), "rep").join(close.select("rep").distinct(), "rep")
    found = written(by_group(close.join(payload, "rep"), "key", _verify(cosine, tables), "v long, n long, low long", rows=2048), "found")
    names = reps.select(F.col("rep").alias("v"), "vec_id")
    linked = found.groupBy(F.col("v").alias("rep")).agg(F.sum("n").alias("n"))
    per_rep = reps.join(linked, "rep", "left").select("h0", "h1", F.col("vec_id").alias("rep"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"))
    far = found.where("v <> low").select("v", "low").distinct().join(names.withColumnRenamed("vec_id", "a"), "v").join(names.select(F.col("v").alias("low"), F.col("vec_id").alias("b")), "low").select("a", "b")
    mine = written(rows.join(written(per_rep, "counted"), ["h0", "h1"]).select("vec_id", "rep", "n"), "mine")
    ends = components(far.unionByName(mine.select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))).where("a <> b"))
    links = mine.groupBy("vec_id").agg(F.sum("n").alias("n"))
    ends = written(links.join(ends.select(F.col("node").alias("vec_id"), "root"), "vec_id", "left"), "components")
    out = ids.join(ends, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


def op3_polytope(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    return near_vectors(table(spark, sf_dir, "embeddings"))
