"""The pipeline's stages against plain Python on a small table, and on an empty one."""

import itertools
import re

import pytest

import corpus_pipeline
from veilspark.llm import bpe, mixing, pii
from veilspark.session import table, written

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage, and what the last gives."""
    out = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), "stage"))
    return out


def good(text):
    w = WORD.findall(text)
    n = len(w)
    windows = {}
    for i in range(n - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = len(lines) - len(set(lines))
    chars, ups, alphas = sum(map(len, w)), len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    bad = (n < 20, 100 * len(repeated) > 30 * n, 100 * len(re.findall(r"[#*$%&|<>]", text)) > 6 * chars, alphas and 2 * ups > alphas, 100 * again > 30 * len(lines) and again >= 3, chars < 2 * n or chars > 20 * n, 100 * sum(a == b for a, b in itertools.pairwise(w)) > 30 * n)
    return not any(bad)


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "mixture", "tokens"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(stages):
    want = sorted(r.doc_id for r in stages[0].collect() if good(r.text))
    assert sorted(r.doc_id for r in stages[1].collect()) == want


def test_near_duplicates(stages):
    sets = {}
    for r in stages[1].collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(k for k, v in root.items() if k == v)


def test_personal_data(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    changed = 0
    for k, text in before.items():
        assert after[k].n_chars == len(after[k].text)
        assert not pii.base_spans(after[k].text)
        changed += text != after[k].text
        if not pii.base_spans(text) and not re.search("[0-9@]", text):
            assert text == after[k].text
    assert changed >= sum(bool(pii.base_spans(t)) for t in before.values())


def test_mixture(stages):
    rows = {r.doc_id: r for r in mixing.mix(stages[3]).collect()}
    count = {}
    for r in stages[4].collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {k: n for k, r in rows.items() if r.size and (n := int(r.taken / r.size + 0.5))}
    assert max(count.values()) <= 3


def test_tokens(stages):
    b = bpe.default_bpe()
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        assert len(r.ids) == r.n_tokens
        assert b"".join(b.tokens[i] for i in r.ids).decode() == texts[r.doc_id]


def test_empty_and_null_documents(spark):
    docs = table(spark, SF, "documents")
    for few in (docs.limit(0), spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "a", None), (2, "", None, None, 0)], docs.schema)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, few, SF).collect()
