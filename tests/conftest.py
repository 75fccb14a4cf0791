import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rounded(v):
    """A value that compares equal in both engines."""
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(rounded, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="session")
def same_as_duckdb(spark):
    """Runs a query and its SQL on one data folder and compares rows and columns."""
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def compare(query, sql):
        df, rel = query(spark, sf_dir), con.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(rel.columns)
        at = [rel.columns.index(c) for c in cols]
        got = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=repr)
        want = sorted((tuple(rounded(r[i]) for i in at) for r in rel.fetchall()), key=repr)
        assert got == want

    return compare
