"""Phrases of whole texts against a plain longest-match parse, and alphabets of any size."""

import random

import numpy as np
import pytest

from veilspark.llm import language


def parsed(sample, text):
    """Number of longest phrases of `text` that occur in `sample`; an unknown letter is a phrase."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def spelt(symbols):
    return "".join(map(chr, symbols.tolist()))


@pytest.fixture(scope="module")
def three():
    rng = random.Random(3)
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(120)] for k, a in {"a": "abcdefgh", "b": "abcdxyzw", "c": "xyzabc"}.items()}
    return lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))


def test_phrases_cross_pieces(three):
    m = language.Model({k: [three(k, 500) for _ in range(3)] for k in "abc"}, letters=9000)
    texts = [m.symbols(t) for t in (three("a", 1100) + three("b", 300), "ab " * 2000, "q" * 3000, three("b", 7), "", " ".join([three("c", 9)] * 300))]
    texts += [m.texts[0], np.concatenate([m.texts[1][500:4000], m.texts[0][100:4000]])]  # phrases longer than a piece
    assert max(map(len, texts)) > 5 * language.PIECE
    got = m.phrases(texts)
    for i, t in enumerate(texts):
        assert got[i].tolist() == [parsed(spelt(s), spelt(t)) for s in m.texts]


def test_every_letter_is_told_apart():
    """Six languages of six thousand letters; two scripts are shared."""
    rng = random.Random(5)
    alphabets = {
        "zh": [chr(0x4E00 + i) for i in range(3000)],
        "ja": [chr(0x4E00 + i) for i in range(1500, 4500)] + [chr(0x3041 + i) for i in range(80)],
        "ko": [chr(0xAC00 + 3 * i) for i in range(2500)],
        "ru": [chr(0x430 + i) for i in range(32)],
        "uk": [*(chr(0x430 + i) for i in range(30)), *"іїєґ"],
        "el": [chr(0x3B1 + i) for i in range(24)],
    }
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randint(1, 4))) for _ in range(1200)] for k, a in alphabets.items()}
    texts = {k: [" ".join(rng.choice(w) for _ in range(300)) for _ in range(30)] for k, w in words.items()}
    m = language.Model({k: t[:20] for k, t in texts.items()})
    assert len(m.symbol) > 5000
    assert sum(t.nbytes for t in m.tables()) < 40_000_000
    for k, t in texts.items():
        assert m.predict(t[20:])[0] == [k] * 10


def test_a_long_row_gives_letters_from_anywhere(spark):
    docs = spark.createDataFrame([(k, "x" * 50_000 + " ".join(["palabra cosa"] * 5000), "es") for k in range(12)], "doc_id long, text string, lang string")
    m = language.train(docs, stretch=500)
    told = "".join(map(str, m.symbols("palabra")[:3]))
    assert len(m.symbol) > 1 and told in "".join(map(str, m.texts[0]))


def test_many_languages_and_equal_rows(spark):
    docs = spark.createDataFrame([(k % 700, f"w{chr(97 + k % 7)}rd {chr(97 + k % 11)}ther", f"l{k % 350}") for k in range(1400)], "doc_id long, text string, lang string")
    m = language.train(docs, each=2)
    assert len(m.languages) == 350
    got = language.identify(docs, m).collect()
    assert len(got) == 1400 and {r.lang_pred for r in got} <= set(m.languages)
