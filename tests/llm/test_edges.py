"""Every operator on nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from veilspark.llm import bpe, chat, language, minhash, mixing, pii, polytope, quality, sharding, toxicity

LONG = " ".join(f"word{i} gave" for i in range(12_000))
# names that operators use inside must not clash with further columns
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, shard string, kept boolean, rep long, node long, h long, _k long"
CLASH = (7, 1.5, "x", True, 1, 2, 3, 4)
TEXTS = [
    (1, "a small cat sat on the mat and then it ran away home", "en", "s1", 1),
    (2, "a small cat sat on the mat and then it ran away home", "en", "s2", 1),
    (2, "a small cat sat on the mat and then it ran away home", "en", "s2", 1),
    (3, None, None, None, None),
    (4, "", "fr", "s1", 0),
    (5, "   \n\t ", "fr", None, 5),
    (6, LONG, "fr", "s1", len(LONG)),
    (None, "un chat noir dort sur le lit de la grande maison", "fr", "s1", 3),
    (8, "one two", "en", "", 7),
    (9, "one TWO", "en", "s3", 7),
    (10, "é🙂 漢字 x", None, "s3", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in TEXTS], DOC_SCHEMA)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def ids(df, col="doc_id"):
    return sorted((r[col] for r in df.collect()), key=lambda x: (x is None, x))


ALL_IDS = [1, 2, 2, 3, 4, 5, 6, 8, 9, 10, None]


def test_mixing(docs, no_docs):
    out = mixing.mix(docs)
    rows = out.collect()
    assert ids(out) == ALL_IDS
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    assert {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    total = sum(r.size for r in rows)
    assert abs(sum(x[0].target for x in by.values()) - total) < 1e-6
    for x in by.values():
        assert abs(sum(r.taken for r in x) - x[0].target) <= 64
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(no_docs).count() == 0 and mixing.sampled(no_docs).count() == 0
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} <= set(ALL_IDS)


def test_quality(docs, no_docs):
    out = quality.judge(docs)
    assert ids(out) == ALL_IDS
    r = {x.doc_id: x for x in out.collect()}
    assert r[3].n_words == 0 and r[3].base_failed and not r[3].kept
    assert r[6].n_words == 24_000
    assert r[10].word_chars == 6
    assert quality.judge(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0
    assert quality.keep_good(docs).columns == docs.columns
    assert ids(quality.keep_good(docs)) == sorted(x.doc_id for x in out.collect() if x.kept)


def test_minhash(docs, no_docs):
    out = {(x.doc_id, x.n_shingles): x for x in minhash.near_duplicates(docs).collect()}
    assert out[2, 9].component_id == 1 and not out[2, 9].kept and out[1, 9].kept
    assert out[9, 1].component_id == 8  # A-Z in lower case, shorter than a shingle
    for k in ((3, 0), (4, 0), (5, 0)):
        assert out[k].kept and out[k].component_id == k[0]
    n = next(x for x in out.values() if x.doc_id is None)
    assert n.component_id is None and n.kept
    assert minhash.near_duplicates(no_docs).count() == 0
    assert ids(minhash.keep_one(docs)) == [1, 3, 4, 5, 6, 8, 10, None]


def test_pii(docs, no_docs, spark):
    out = pii.digests(docs, None)
    assert ids(out) == ALL_IDS
    assert {x.base_sha256 for x in out.collect()} == {hashlib.sha256(b"").hexdigest()}
    assert pii.digests(no_docs, None).count() == 0 and pii.train(no_docs) is None
    one = spark.createDataFrame([(1, "é mail joe@ex.org, 10.0.0.1 and +1 (555) 555-1234 🙂 4111 1111 1111 1111 end"), (2, None), (3, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in pii.digests(one, None).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1].spans.startswith("email:7:17,ip:19:27,card:")
    assert got[2].spans == "" and got[3].spans == ""
    hid = {x.doc_id: x.text for x in pii.redact(one, None).collect()}
    assert hid == {1: "é mail [EMAIL], [IP] and [PHONE] 🙂 [CARD] end", 2: None, 3: ""}


def test_toxicity_and_language(docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    s = toxicity.train(docs, labels)
    out = toxicity.score(docs, s)
    assert ids(out) == ALL_IDS and all(0 <= x.score <= 1 for x in out.collect())
    assert toxicity.train(no_docs, labels).score("x") < 0.5
    assert toxicity.score(no_docs, s).count() == 0
    m = language.train(docs)
    got = language.identify(docs, m)
    assert ids(got) == ALL_IDS
    by = {x.doc_id: x for x in got.collect()}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und"
    assert by[None].lang_pred == "fr" and by[1].lang_pred == "en"
    assert language.identify(no_docs, m).count() == 0
    assert {x.lang_pred for x in language.identify(docs, language.train(no_docs)).collect()} == {"und"}


def test_bpe(docs, no_docs):
    b = bpe.default_bpe()
    assert ids(bpe.digests(docs, b)) == ALL_IDS
    assert ids(bpe.encode(docs, b)) == ALL_IDS
    assert {x.n_tokens for x in bpe.digests(docs, b).collect() if x.doc_id in (3, 4)} == {0}
    assert bpe.digests(no_docs, b).count() == 0


def test_sharding(docs, no_docs):
    for limit in (100, 500, 10**6):
        rows = sharding.shards(docs, limit=limit).collect()
        assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x)) == ALL_IDS
        size = {}
        for r in rows:
            size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        for r in rows:
            assert size[r.shard] == r.shard_bytes
            assert r.shard_bytes <= limit or ":big:" in r.shard
    assert sharding.shards(no_docs).count() == 0


def test_sharding_of_one_repeated_id(spark):
    df = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 10).alias("text"))
    rows = sharding.shards(df, limit=100).collect()
    assert len(rows) == 300 and max(r.shard_bytes for r in rows) <= 100 and len({r.shard for r in rows}) <= 80


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, conv long, part int, h long, m string"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (2, 0, None, None), (3, None, "assistant", "x"), (None, 1, "user", "lost"), (4, 0, " User ", ""), (4, 1, "bot", "b"), (5, 0, "system", "s")]
    df = spark.createDataFrame([(*r, 9, 9, 9, "z") for r in rows], schema)
    out = chat.format_chats(df)
    assert out.count() == len(rows)
    text = {}
    for r in out.orderBy("conv_id", "place").collect():
        text[r.conv_id] = text.get(r.conv_id, "") + r.piece
    e = chat.END
    assert text[1] == f"<|user|>\nhi{e}<|assistant|>\nyo\nyo{e}"
    assert text[3] == f"<|user|>\n{e}<|assistant|>\nx{e}"
    assert text[4] == f"<|user|>\n{e}<|assistant|>\nb{e}"
    assert text[5] == f"<|user|>\ns{e}<|assistant|>\n{e}"  # one role changed and one empty turn cost less than two empty turns
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_polytope(spark):
    schema = "vec_id long, embedding array<float>, label int, key long, rep long, n long, mult long"
    v, w = [1.0, 2.0, 0.5], [1.001, 2.0, 0.5]
    rows = [(1, v, 0), (2, v, 0), (3, w, 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 2.0], 0), (9, [float("nan"), 1.0, 1.0], 0), (10, [], 0), (None, v, 0), (1, v, 0), (11, [1.0, 2.0], 0), (12, [float("inf"), 1.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema)
    out = [(x.vec_id, x.n_links, x.component_id, x.kept) for x in polytope.near_vectors(df).collect()]
    assert len(out) == len(rows)
    got = set(out)
    assert {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (None, 0, None, True)} <= got
    assert all((k, 0, k, True) in got for k in (6, 7, 8, 9, 10, 11, 12))
    assert polytope.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_minhash_refuses_what_it_cannot_promise(docs):
    with pytest.raises(ValueError, match="percent"):
        minhash.near_duplicates(docs, percent=20)
    for percent in (30, 50, 60, 70, 75, 80, 85, 95, 100):
        p = minhash.Plan(percent)
        assert p.trees * p.levels * p.branch <= p.mins <= len(minhash._MULTIPLY)
