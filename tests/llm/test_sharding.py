"""Splits against DuckDB, with a limit that makes many."""

from pathlib import Path

import duckdb
import pytest

from veilspark.llm import sharding
from veilspark.session import table


@pytest.mark.parametrize(("limit", "least"), [(65_536, 40), (3_000_000, 1), (20_000, 150)])
def test_only_oversized_buckets_split(spark, limit, least):
    sf = "/root/testdata/sf0.01"
    rows = sharding.shards(table(spark, sf, "documents"), limit=limit).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{Path(sf) / 'documents.parquet'}'")
    small = [r for r in rows if r.n_bytes <= limit]
    want = con.sql(sharding.OP5_SQL.replace(str(sharding.LIMIT), str(limit))).fetchall()
    assert sorted((r.doc_id, r.n_bytes, r.depth, r.shard, r.shard_bytes) for r in small) == sorted(want)
    assert len({r.shard for r in small}) >= least and all(r.shard_bytes <= limit for r in small)
    names = sorted({r.shard for r in small})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert {r.shard_bytes for r in rows if r.n_bytes > limit} == {r.n_bytes for r in rows if r.n_bytes > limit}
