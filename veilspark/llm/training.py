"""Bounded samples of labelled rows, for models that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def sample_by_class(rows: DataFrame, id_col: str, class_col: str, each: int) -> list:
    """About `each` rows of every class, or all of a smaller class, by a hash of the id; ordered by it.

    `rows` are (`id_col`, `class_col`, text), class not null. Classes are counted first, so each is thinned by its own rate
    and what comes to the driver has a fixed size for each class.
    """
    counts = rows.groupBy(class_col).count().collect()
    if not counts:
        return []
    kind = dict(rows.dtypes)[class_col]
    rates = rows.sparkSession.createDataFrame([(r[0], min(1.0, (1.5 * each + 16) / r[1])) for r in counts], f"`{class_col}` {kind}, _rate double")
    rates = F.broadcast(rates) if len(counts) <= 10_000 else rates  # so that texts aren't shuffled
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(3))
    got = rows.withColumn("_h", h).join(rates, class_col).where((F.pmod("_h", F.lit(1 << 30)) / float(1 << 30)) < F.col("_rate")).drop("_rate").collect()
    got.sort(key=lambda r: (r["_h"], str(r[id_col])))
    seen: dict = {}
    out = []
    for r in got:
        if seen.setdefault(r[class_col], 0) < each:
            seen[r[class_col]] += 1
            out.append(r)
    return out
