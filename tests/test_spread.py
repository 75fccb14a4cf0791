"""Queries on a table of one row group: no task makes, reads or scores the texts of most rows."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from veilspark.operators import detect
from veilspark.plans import annotated, annotated_queries, catalogue
from veilspark.session import spread

ROWS = 3000
DEALT = "annotated_masked annotated_realistic_scores annotated_realistic_spans marked_texts annotated_structural_scores redact_reply_restore qi_extract_lieu siren_collisions score_corpus annotated_structural_spans annotated_adversarial_scores first_missed_names stream_redact annotated_adversarial_spans predictions_as_json_lines ingest_odt entity_counts".split()


@pytest.fixture(scope="module")
def one_group(tmp_path_factory):
    at = tmp_path_factory.mktemp("group")
    keys = list(range(ROWS))
    pq.write_table(pa.table({"c_custkey": keys, "c_name": [f"Customer#{k:09d}" for k in keys]}), at / "customer.parquet", row_group_size=ROWS)
    pq.write_table(pa.table({"o_orderkey": keys, "o_custkey": [k * 7 % 1000 for k in keys]}), at / "orders.parquet", row_group_size=ROWS)
    return str(at)


def largest_tasks(spark, run) -> list[tuple[int, int, int, float]]:
    """(records read, those of the largest task, records shuffled, bytes shuffled a record read) of the stages of `run`."""
    store, group = spark.sparkContext._jsc.sc().statusStore(), f"largest tasks {id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # three thousand rows of results are one task otherwise
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext._jsc.clearJobGroup()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    out = []
    tracker = spark.sparkContext.statusTracker()
    for stage in sorted({s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}):
        tasks, read, records, shuffled = store.taskList(stage, 0, 10_000), [0], 0, 0
        for i in range(tasks.size()):
            m = tasks.apply(i).taskMetrics().get()
            read.append(m.inputMetrics().recordsRead() + m.shuffleReadMetrics().recordsRead())
            records += m.shuffleWriteMetrics().recordsWritten()
            shuffled += m.shuffleWriteMetrics().bytesWritten()
        out.append((sum(read), max(read), records, shuffled / max(1, sum(read))))
    return out


@pytest.mark.parametrize("name", DEALT)
def test_no_task_has_most_rows(spark, one_group, name):
    assert annotated_queries
    found = largest_tasks(spark, lambda: catalogue.QUERIES[name](spark, one_group).write.format("noop").mode("overwrite").save())
    assert sum(total >= ROWS for total, *_ in found) >= 2
    for total, largest, _, shuffled in found:  # the first stage, one task, deals out keys and names
        assert total < ROWS or largest <= total / 2 or 0 < shuffled < 40, found


def test_orders_are_shuffled_not_their_candidates(spark, one_group):
    found = largest_tasks(spark, lambda: catalogue.resolve_overlaps(spark, one_group).write.format("noop").mode("overwrite").save())
    assert sum(records for _, _, records, _ in found if records >= ROWS) == ROWS, found
    assert any(total == ROWS and largest < ROWS / 2 for total, largest, *_ in found), found


def test_lists_resolved_at_once_are_as_one_by_one():
    rng = random.Random(5)

    def entity(width: int) -> dict:
        a = rng.randrange(width)
        return {"type": rng.choice(["t0", "t1", "é", "\ufb00", "\U0001d538"]), "start": a, "end": a + rng.randint(1, 12), "value": str(rng.random()), "confidence": rng.choice([0.5, 0.7, 0.9]), "tier": rng.choice([*detect.TIERS, "?", None])}

    for trial in range(60):
        rows = [rng.choice([None, []]) if rng.random() < 0.1 else [entity(rng.choice([5, 40, 200])) for _ in range(rng.choice([1, 2, 5, 16, 17, 30]))] for _ in range(50)]
        for r in rows[::9]:
            if r:
                r[0]["end"] = r[0]["start"] - rng.randint(0, 3)
        if trial % 10 == 0:
            rows[7] = [entity(9) | {"confidence": None}]
        got = detect.resolved_lists(pa.array(rows, detect._KIND).slice(trial % 3))
        got.validate(full=True)
        assert got.to_pylist() == [r and detect.resolved(r) for r in rows[trial % 3 :]]


def test_rows_are_dealt_evenly(spark, one_group):
    customer = spark.read.parquet(f"{one_group}/customer.parquet")
    assert customer.rdd.getNumPartitions() == 1
    for rows, parts in ((16_384, 4), (300, 10), (10_000, 4)):
        sizes = spread(customer, rows).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
        assert len(sizes) == parts and sum(sizes) == ROWS and max(sizes) <= min(sizes) + parts
    assert spread(customer.limit(0)).count() == 0


@pytest.mark.parametrize("name", annotated.TEMPLATES)
def test_texts_and_gold_of_one_pass_are_those_of_the_sql(spark, one_group, name):
    docs = catalogue.from_customers(spark, one_group, annotated.in_one_pass(name), "SELECT * FROM docs").cache()
    for what, cols, got in (("docs", "doc_id, text", docs.select("doc_id", "text")), ("gold", "doc_id, type, start_at, end_at", annotated_queries._gold(docs))):
        want = catalogue.from_customers(spark, one_group, annotated.ctes(name), f"SELECT {cols} FROM {what} WHERE doc_id < 500")
        assert sorted(map(tuple, got.where("doc_id < 500").collect())) == sorted(map(tuple, want.collect())), what
    docs.unpersist()
