"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Native: DataFrame functions only. The steps:

1. every row's size in words, the totals of each source, and targets by water filling (`targets`);
2. blocks of `block` words go to sources by the highest quotients target / (2k + 1), then in each source to its
   shards by size / (2k + 1) (`apportion`), so that each shard has an integer quota;
3. in a shard, rows stand in an order seeded by md5 and form one ring of words; the quota's blocks are the run that
   starts at a seeded block, once around or up to `most` times. A row's taken words are its overlap with that run.

Shards hold about `rows_per_shard` rows each, so a hot source is spread over many tasks. Neither sources nor shards meet in
one task: they are ranked by `numbered`, over ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

WORD = r"[^\x20\x09-\x0D]+"


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """`df` with `out`: each row's place, from 1, in the order of columns whose values together are unique.

    Rows are ranked in ranges of the order, and a range's rows come after those of all ranges before it: one count for
    each range, no more than there are shuffle partitions.
    """
    spread = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.join(F.broadcast(ahead), "_part").withColumn(out, F.col("_ahead") + place).drop("_part", "_ahead")


def targets(sources: DataFrame, most: int = 3) -> tuple[DataFrame, int]:
    """`sources` (src, src_null, source_size, n_rows) with rank, weight and target; and the total of all sizes.

    Weights 1, 2, 3 repeat over sources in code point order, null last. The total of all sizes is shared by weight;
    a target stops at `most` times its source's size and the excess is shared again, until none is above. Each round is
    one sum over the sources; the level only rises, so rounds are few.
    """
    ranked = numbered(sources, ["src_null", "src"], "rank").withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * most)
    ranked = written(ranked, "ranked")
    size, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    size, weight = size or 0, weight or 0
    full, heavy = 0, 0  # sizes and weights of the sources that are capped

    def share(x):
        return F.lit(str(x)).cast("decimal(18,0)")

    while True:
        capped = F.col("cap").cast("decimal(20,0)") * share(weight - heavy) <= share(size - full) * F.col("weight").cast("decimal(20,0)")
        got = ranked.where(capped).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (got[0], got[1]) == (full, heavy) or got[1] == weight:
            break
        full, heavy = got[0], got[1]
    level = (size - full) / max(1, weight - heavy)
    return ranked.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))), size


def apportion(df: DataFrame, group: list[str], key: str, share: str, seats: str, out: str) -> DataFrame:
    """`df` with `out`: how many of the group's `seats` a row gets by the highest quotients share / (2k + 1); ties by `key`.

    With m rows and total W, the divisor W / (seats - m / 2) gives out at most `seats` and leaves about m. So only
    those quotients that can still win are listed, about three a row; the work doesn't grow with the number of seats.
    """
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"), F.sum(F.col(share).cast("double")).alias("_w"))
    room = F.col(seats) - F.col("_m") / 2 - 0.5
    base = df.join(totals, group).withColumn("_base", F.when((room > 0) & (F.col("_w") > 0), F.floor(F.col(share) / (F.col("_w") / room) + 0.5)).otherwise(F.lit(0)).cast("long"))
    base = written(base, "base")
    left = base.groupBy(*group).agg((F.max(seats) - F.sum("_base")).alias("_left"))
    more = F.when(F.col(share) > 0, F.ceil((F.col("_m") + 1) * F.col(share) / F.col("_w")) + 1).otherwise(0).cast("long")
    turns = F.explode(F.when(more > 0, F.sequence(F.col("_base"), F.col("_base") + more)).otherwise(F.array().cast("array<bigint>")))
    bids = base.select(*group, key, F.col(share).alias("_share"), turns.alias("_k")).withColumn("_cost", (F.col("_k") * 2 + 1) / F.col("_share"))
    bids = written(numbered(bids.select(*group, "_cost", key, "_k"), [*group, "_cost", key, "_k"], "_n"), "bids")
    first = bids.groupBy(*group).agg(F.min("_n").alias("_first"))
    won = bids.join(first.join(left, group), group).where(F.col("_n") - F.col("_first") < F.col("_left")).groupBy(*group, key).agg(F.count(F.lit(1)).alias("_won"))
    return base.join(won, [*group, key], "left").withColumn(out, F.col("_base") + F.coalesce(F.col("_won"), F.lit(0))).drop("_m", "_w", "_base", "_won")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = 32, most: int = 3, seed: int = 42, rows_per_shard: int = 2048) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every row of `docs`; other columns are not read.

    Null text or text without words has size 0 and taken 0. A null source is a source of its own, ranked last; a null
    id counts as the empty string in the seeded order. Rows that are equal in id and text are interchangeable and share a
    shard. An empty table gives an empty result. Blocks have `block` words, but at most a 32nd of what a source has on
    average, and one at least. taken is at most `most` * size, and a source's taken differs from its target by
    at most a block, plus a block for each of its shards when the target is `most` times the size.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
            F.col(source_col).isNull().alias("src_null"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text))).alias("h"),
        ),
        "mix",
    )
    sources, all_size = targets(sizes.groupBy("src", "src_null").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")), most)
    block = max(1, min(block, all_size // (32 * max(1, sources.count()))))
    sources = sources.withColumn("all", F.lit(0)).withColumn("seats", F.lit(all_size // block).cast("long"))
    sources = apportion(sources, ["all"], "rank", "target", "seats", "blocks").select("src", "src_null", "rank", "source_size", "target", "blocks", F.ceil(F.col("n_rows") / rows_per_shard).cast("long").alias("n_shards"))
    placed = sizes.join(written(sources, "sources"), ["src", "src_null"]).withColumn("shard", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("n_shards"))
    shards = apportion(placed.groupBy("rank", "blocks", "shard").agg(F.sum("size").alias("ring")), ["rank"], "shard", "ring", "blocks", "quota").select("rank", "shard", "ring", "quota")
    order = Window.partitionBy("rank", "shard").orderBy("h", "doc_id", "size")
    ringed = placed.join(shards, ["rank", "shard"]).withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "rank", F.lit(":"), "shard")), 1, 8), 16, 10).cast("long") % F.ceil(F.col("ring") / block) * block
    ringed = (
        ringed.withColumn("take", F.least(F.col("quota") * block, F.col("ring") * most))
        .withColumn("start", F.when(F.col("ring") > 0, start).otherwise(0))
        .withColumn("laps", F.when(F.col("ring") > 0, F.floor(F.col("take") / F.col("ring"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("take") - F.col("laps") * F.col("ring"))
    )

    def overlap(lo, hi):
        return F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), hi) - F.greatest(F.col("at"), lo))

    end = F.col("start") + F.col("rest")
    taken = F.col("laps") * F.col("size") + overlap(F.col("start"), end) + overlap(F.lit(0), end - F.col("ring"))
    return ringed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.when(~F.col("src_null"), F.col("src")).alias("source"))


def sampled(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **mix_args) -> DataFrame:
    """`docs`, all columns, each row as many times as the mix takes it: taken / size rounded half up; rows without words go.

    Only rows where a shard's run of blocks begins or ends are taken in part, two a shard at most. Rows with equal ids and
    sizes share what they are taken.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    taken = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **mix_args).where("taken > 0")
    taken = taken.groupBy(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("source").alias("__source")).agg((F.sum("taken") / F.count(F.lit(1))).alias("__taken"))
    copies = F.floor(F.col("__taken") / F.col("__size") + 0.5).cast("int")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (size == F.col("__size")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
    out = docs.join(taken.where(copies > 0).withColumn("__copies", copies), same)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    return mix(table(spark, sf_dir, "documents"))


#: The same rows in DuckDB. Quotients are listed for every seat of the apportionment's closed form, as above.
OP1_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(source, '') AS src, source IS NULL AS src_null,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents
), s0 AS (
  SELECT src, src_null, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM sizes GROUP BY ALL
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY src_null, src) AS rank FROM s0
), s2 AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, source_size * 3 AS cap, sum(source_size) OVER ()::BIGINT AS all_size,
         greatest(1, least(32, sum(source_size) OVER ()::BIGINT // (32 * count(*) OVER ()))) AS block FROM s1
), s3 AS (
  SELECT *, sum(weight) OVER ()::BIGINT AS all_weight,
         coalesce(sum(cap) OVER w, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_before
  FROM s2 WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s4 AS (
  SELECT *, cap * (all_weight - weight_before) <= (all_size - cap_before) * weight AS capped FROM s3
), s5 AS (
  SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()::BIGINT AS cap_sum,
         sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ()::BIGINT AS weight_sum FROM s4
), s6 AS (
  SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE (all_size - cap_sum)::DOUBLE / (all_weight - weight_sum) * weight END AS target,
         all_size // block AS seats FROM s5
), b1 AS (
  SELECT rank, target, seats, row_number() OVER (ORDER BY (2 * k + 1) / target, rank) AS n
  FROM s6, LATERAL (SELECT unnest(range(0, CASE WHEN target > 0 THEN (seats * target / all_size)::BIGINT + 40 ELSE 0 END)) AS k)
), sources AS (
  SELECT s6.src, s6.src_null, s6.rank, source_size, target, ceil(n_rows / 2048)::BIGINT AS n_shards, coalesce(b.blocks, 0) AS blocks, block
  FROM s6 LEFT JOIN (SELECT rank, count(*) AS blocks FROM b1 WHERE n <= seats GROUP BY rank) b ON s6.rank = b.rank
), placed AS (
  SELECT z.*, s.rank, s.source_size, s.target, s.blocks, s.block, ('0x' || substr(h, 1, 8))::BIGINT % s.n_shards AS shard
  FROM sizes z JOIN sources s ON z.src = s.src AND z.src_null = s.src_null
), h0 AS (
  SELECT rank, shard, any_value(blocks) AS blocks, sum(size)::BIGINT AS ring FROM placed GROUP BY rank, shard
), h1 AS (
  SELECT *, sum(ring) OVER (PARTITION BY rank)::BIGINT AS all_ring, count(*) OVER (PARTITION BY rank) AS m FROM h0
), b2 AS (
  SELECT rank, shard, blocks, row_number() OVER (PARTITION BY rank ORDER BY (2 * k + 1) / ring, shard) AS n
  FROM h1, LATERAL (SELECT unnest(range(0, CASE WHEN ring > 0 THEN (blocks * ring / all_ring)::BIGINT + m + 2 ELSE 0 END)) AS k)
), shards AS (
  SELECT h1.rank, h1.shard, ring, coalesce(q.quota, 0) AS quota
  FROM h1 LEFT JOIN (SELECT rank, shard, count(*) AS quota FROM b2 WHERE n <= blocks GROUP BY rank, shard) q
  ON h1.rank = q.rank AND h1.shard = q.shard
), r0 AS (
  SELECT p.*, ring, least(quota * block, ring * 3) AS take,
         coalesce(sum(size) OVER (PARTITION BY p.rank, p.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING), 0)::BIGINT - size AS at_,
         CASE WHEN ring > 0 THEN ('0x' || substr(md5('42:' || p.rank || ':' || p.shard), 1, 8))::BIGINT % ceil(ring / block)::BIGINT * block ELSE 0 END AS start_
  FROM placed p JOIN shards s ON p.rank = s.rank AND p.shard = s.shard
), r1 AS (
  SELECT *, CASE WHEN ring > 0 THEN take // ring ELSE 0 END AS laps FROM r0
), r2 AS (
  SELECT *, start_ + take - laps * ring AS end_ FROM r1
)
SELECT doc_id, size, source_size, target,
       (laps * size + greatest(0, least(at_ + size, end_) - greatest(at_, start_)) + greatest(0, least(at_ + size, end_ - ring) - at_))::BIGINT AS taken,
       CASE WHEN NOT src_null THEN src END AS source
FROM r2
"""
