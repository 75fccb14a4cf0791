"""Training reads all labelled rows: counts, features and weights against plain Python."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import toxicity
from veilspark.session import table


def test_every_labelled_row_counts(spark):
    """2,400 toxic and 12,000 clean rows; words that three toxic rows share count against all others, and each clean row has a word of its own."""
    rare = ["".join(x) for x in itertools.islice(itertools.product("bdfgk", "aeo", "mnprt", "aiu", "lsz", "o"), 0, 600, 31)]
    own = ["".join(x) for x in itertools.islice(itertools.product("абвгдежзиклмнопрстуфхцчшщ", repeat=3), 12_100) if len(set(x)) > 1][:12_000]
    toxic = [f"you {rare[k // 3]} person" if k < 3 * len(rare) else "you stupid person" for k in range(2400)]
    clean = [f"a kind person {w}" for w in own]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 2400).cast("int").alias("toxic"))
    scorer = toxicity.train(docs, labels)
    assert len(rare) > 15 and {f"{w}$" for w in rare} <= set(scorer.weights)
    assert set(own) <= set(scorer.reader.restorer.cost)
    assert all(scorer.score(f"you {w} person") > 0.5 for w in [*rare, "stupid"]) and scorer.score("a kind person") < 0.5


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("text is not null").select(F.col("toxic").alias("y"), "text").cache()
    got = [(r.y, r.text) for r in rows.collect()]
    n1 = sum(y for y, _ in got)
    return rows, got, n1, len(got) - n1


@pytest.mark.parametrize(("most", "at_once"), [(40, 100), (40, 1_000_000), (4000, 400)])
def test_best_features_are_those_of_all_rows_in_any_number_of_passes(labelled, most, at_once):
    rows, got, n1, n0 = labelled
    restorer = toxicity.model(rows)
    n = Counter()
    for _, t in got:
        n.update(toxicity.threes(Counter(toxicity.plain_words(t))))
    plain = toxicity.Restorer.of_threes(n)
    assert restorer.cost == plain.cost
    first = Counter(f for y, t in got if y for f in toxicity.Reader(plain).count(t)[0])
    reader = toxicity.Reader(plain, {f for f, k in first.items() if k >= 3})
    pos, neg = (Counter(f for y, t in got if y == want for f in reader.count(t)[0]) for want in (1, 0))

    def worth(f):
        m = (pos[f] + neg[f]) / (n1 + n0)
        return (pos[f] / n1 - neg[f] / n0) / np.sqrt(m * (1 - m) * (1 / n1 + 1 / n0) + 1e-12)

    want = sorted((-worth(f), f) for f in pos if worth(f) > 3)[:most]
    able = toxicity.best(rows, restorer, n1, n0, most, at_once)
    assert len(able) == len(want) > 30
    assert np.allclose([-worth(f) for f in able], [w for w, _ in want]) and able == [f for _, f in want]


def test_weights_are_at_the_minimum_and_reruns_agree(spark):
    rng = np.random.default_rng(5)
    data = []
    for _ in range(400):
        at = sorted(rng.choice(6, int(rng.integers(0, 4)), replace=False).tolist())
        data.append((int(rng.random() < (0.7 if 0 in at or 3 in at else 0.2)), at, [float(1 + (p * 7 + len(at)) % 4) for p in at]))
    rows = spark.createDataFrame(data, "y int, at array<int>, rate array<double>").groupBy("y", "at", "rate").agg(F.count("*").alias("n"))
    n1 = sum(y for y, _, _ in data)
    able = list("abcdef")
    restorer = toxicity.Restorer(Counter())
    one, two = (toxicity.weigh(restorer, able, r, n1, 400 - n1, 1e-3) for r in (rows, rows.repartition(3)))
    assert (one.weights, one.shares, one.bias) == (two.weights, two.shares, two.bias)
    x = np.zeros((400, 13))
    for i, (_, at, rates) in enumerate(data):
        x[i, at], x[i, [6 + p for p in at]], x[i, 12] = 1, rates, 1
    w = np.array([*one.weights.values(), *one.shares.values(), one.bias])
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - np.array([y for y, _, _ in data])) / 400 + 1e-3 * np.append(w[:-1], 0)
    assert np.abs(slope).max() < 1e-3
