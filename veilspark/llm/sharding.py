"""Sharding by extendible hashing.

A document's place is given by the leading bits of its id's md5. The directory starts with one bucket of no bits; a bucket
whose documents exceed the byte limit splits on its next bit, and no other does. So a document's shard is its
shortest prefix whose bytes fit. Bytes are summed once for prefixes somewhat longer than needed, and the directory is
worked out from these sums; prefixes still too large there go on with more bits. Documents that share all BITS bits (one
id repeated) can't be told apart by hash: they fill shards in the order in which tasks read them.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BITS = 48
LIMIT = 64 * 1024 * 1024


def _prefix(h, bits):
    """The first `bits` of BITS."""
    return F.floor(h / F.pow(F.lit(2.0), F.lit(BITS) - bits)).cast("long")


def shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, depth, shard, shard_bytes of every row of `docs`; other columns are not read.

    n_bytes is the text's UTF-8 length, 0 for null. shard is the prefix in binary, depth its length. Every shard's bytes
    are at most `limit`, unless it is one document that exceeds it: such a document is alone in its shard, with `:big`
    and its id at the end. A null id hashes as empty text. Repeated rows count each. An empty table gives an empty result.
    """
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), h.alias("h")), "shard")
    big = F.col("n_bytes") > limit
    small = rows.where(~big)
    total = small.agg(F.sum("n_bytes")).first()[0] or 0
    at = min(BITS, max(0, ceil(log2(max(1, total / limit)))) + 6)
    left, done, low = small, [], 0
    while True:
        sums = written(left.groupBy(_prefix(F.col("h"), F.lit(at)).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")), "prefixes")
        depth = F.explode(F.sequence(F.lit(low), F.lit(at))).alias("depth")
        above = F.floor(F.col("p") / F.pow(F.lit(2.0), at - F.col("depth"))).cast("long")
        spread = sums.select("p", "b", depth).withColumn("q", above)
        buckets = spread.groupBy("depth", "q").agg(F.sum("b").alias("shard_bytes"))
        fit = buckets.where(F.col("shard_bytes") <= limit)
        leaf = written(spread.join(fit, ["depth", "q"]).groupBy("p").agg(F.min(F.struct("depth", "q", "shard_bytes")).alias("leaf")), "leaves")
        here = left.withColumn("p", _prefix(F.col("h"), F.lit(at))).join(leaf, "p", "left")
        found = here.where("leaf is not null").select("doc_id", "n_bytes", F.col("leaf.depth").cast("int").alias("depth"), F.lpad(F.bin("leaf.q"), F.col("leaf.depth").cast("int"), F.lit("0")).alias("shard"), F.col("leaf.shard_bytes").alias("shard_bytes"))
        done.append(found.withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(F.col("shard"))))
        over = here.where("leaf is null").select("doc_id", "n_bytes", "h")
        if at == BITS:
            break
        over = written(over, "over")
        if over.isEmpty():
            over = None
            break
        left, low, at = over, at + 1, min(BITS, at + 6)
    if over is not None:  # equal hashes: each task fills shards of its own, each at least half full but the last
        order = Window.partitionBy("h", "task").orderBy("doc_id", "n_bytes").rowsBetween(Window.unboundedPreceding, -1)
        piled = over.withColumn("task", F.spark_partition_id()).withColumn("half", F.col("n_bytes") * 2 > limit)
        piled = piled.withColumn("place", F.when(F.col("half"), F.row_number().over(Window.partitionBy("h", "task", "half").orderBy("doc_id", "n_bytes"))).otherwise(F.floor(F.coalesce(F.sum(F.when(~F.col("half"), F.col("n_bytes")).otherwise(0)).over(order), F.lit(0)) / (limit / 2))))
        name = F.concat_ws(":", F.lpad(F.bin("h"), BITS, "0"), F.col("task").cast("string"), F.when(F.col("half"), "h").otherwise("q"), F.col("place").cast("string"))
        piled = written(piled.select("doc_id", "n_bytes", F.lit(BITS).alias("depth"), name.alias("shard")), "piled")
        sizes = piled.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
        done.append(piled.join(sizes, "shard").select("doc_id", "n_bytes", "depth", "shard", "shard_bytes"))
    done.append(rows.where(big).select("doc_id", "n_bytes", F.lit(BITS).alias("depth"), F.concat(F.lpad(F.bin("h"), BITS, "0"), F.lit(":big:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shard"), F.col("n_bytes").alias("shard_bytes")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """`docs` in a folder for each shard; ids must be unique."""
    placed = docs.join(shards(docs, id_col=id_col, text_col=text_col, limit=limit).select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard")), F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    placed.repartition("__shard").write.partitionBy("__shard").parquet(path)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    return shards(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents
), b AS (
  SELECT depth::INTEGER AS depth, h >> (48 - depth) AS q, sum(n_bytes)::BIGINT AS shard_bytes
  FROM d, (SELECT unnest(range(0, 30)) AS depth) WHERE n_bytes <= {LIMIT} GROUP BY 1, 2
), leaf AS (
  SELECT doc_id, n_bytes, h, min(depth)::INTEGER AS depth, arg_min(b.q, depth) AS q, arg_min(shard_bytes, depth) AS shard_bytes
  FROM d JOIN b ON h >> (48 - depth) = b.q WHERE n_bytes <= {LIMIT} AND shard_bytes <= {LIMIT} GROUP BY ALL
)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(q), depth, '0') END AS shard, shard_bytes FROM leaf
"""
