"""The models read and learn from whole texts."""

from collections import Counter

import numpy as np
import pytest

from veilspark.llm import pii, toxicity


@pytest.fixture(scope="module")
def tagger():
    rng = np.random.default_rng(1)
    words = "please write to the office or call our desk before noon and bring all papers for review at home".split()
    hosts = "hopital-universitaire.example.org mail.example.com example.net post.data-service.example.org".split()
    names = "jean-baptiste.lefebvre joe anna.maria.lopez-garcia info k.wu".split()
    texts = []
    for _ in range(500):
        pick = [" ".join(rng.choice(words, int(rng.integers(2, 9)))) for _ in range(3)]
        texts.append(f"{pick[0]} {rng.choice(names)}{rng.integers(0, 99) if rng.random() < 0.3 else ''}@{rng.choice(hosts)} {pick[1]} 12 {pick[2]}")
    x, y = pii.windows_of(texts)
    m = pii.Tagger()
    m.fit(x, y, steps=400)
    return m


@pytest.mark.parametrize(
    "address",
    ["jean-baptiste.lefebvre @ hopital-universitaire.example.org", "anna dot lopez-garcia at mail dot example dot com", "joe arobase example point org", "jean-baptiste.lefebvre (at) hopital-universitaire (dot) example (dot) org"],
)
def test_long_and_spelt_addresses_are_masked_whole(tagger, spark, address):
    text = f"please write to {address} before noon"
    assert pii.masked(text, pii.all_spans(tagger, [text], [pii.base_spans(text)])[0]) == "please write to [EMAIL] before noon"
    docs = spark.createDataFrame([(1, text), (2, "look at the dot on this map at noon")], "doc_id long, text string")
    assert [r.text for r in pii.redact(docs, tagger).orderBy("doc_id").collect()] == ["please write to [EMAIL] before noon", "look at the dot on this map at noon"]


def test_stretches_end_where_words_do():
    text = f"{'a' * 50}@{'b' * 60} c" + " d" * 100 + f" {'e' * 30}1{'f' * 30}"
    lo, hi = pii.stretches(text)[0]
    assert lo == 0 and text[hi].isspace() and pii.stretches(text)[-1][1] == len(text)
    assert all(b < c for (_, b), (c, _) in zip(pii.stretches(text), pii.stretches(text)[1:]))


@pytest.mark.parametrize("insult", ["stuupid", "s,t,u,p,i,d", "s:t:u:p:i:d", "s;t;u;p;i;d", "s'tupid", "s  t  u  p  i  d", "s\tt\tu\tp\ti\td", "s\nt\nu\np\ni\nd", "s. t. u. p. i. d", "s - t - u - p - i - d"])
def test_every_disguise_of_the_lattice_is_read(insult):
    plain = Counter({w: 50 for w in "stupid idiot moron the and other worthless pathetic house small".split()})
    scorer = toxicity.Scorer(toxicity.Restorer(plain), {"stupid$": 5.0}, -2.0)
    assert scorer.score(f"the house, {insult}!") > 0.9
    assert scorer.score("the small house and the other, too") < 0.5


def test_training_reads_past_the_first_letters(spark):
    long = "the house is small and the garden is green " * 600
    docs = spark.createDataFrame([(k, long + (f"you {w} person" if k % 2 else "a kind person")) for k, w in enumerate(["stupid"] * 24)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(24)], "doc_id long, toxic int")
    assert len(long) > 20_000
    scorer = toxicity.train(docs, labels)
    assert "stupid$" in scorer.weights and scorer.score("you stupid person") > 0.5 > scorer.score("a kind person")
    late = spark.createDataFrame([(k, "plain words " * 2000 + f"call +1 (555) 555-{1000 + k} or mail joe{k}@ex.org") for k in range(8)], "doc_id long, text string")
    assert pii.train(late) is not None
