"""Restoration against every path of the lattice, and features that don't depend on how a text is disguised."""

import gc
import itertools
import random
from collections import Counter

import pyarrow as pa
import pytest

from veilspark.llm import toxicity

WORDS = "stupid idiot moron loser clown trash the and other worthless pathetic house small letter green".split()


@pytest.fixture(scope="module")
def restorer():
    return toxicity.Restorer(Counter({w: 50 for w in WORDS}))


def cheapest(r, token):
    """The least cost of all paths, and the texts that have it, by enumeration."""
    best, texts = float("inf"), set()
    for path in itertools.product(*r.lattice(token)):
        word = "".join(c for c, _ in path)
        padded = f"^^{word}^"
        cost = sum(x for _, x in path) + sum(r.step(padded[i - 2 : i], padded[i]) for i in range(2, len(padded)))
        if cost < best - 1e-9:
            best, texts = cost, {word}
        elif cost < best + 1e-9:
            texts.add(word)
    return best, texts


def test_viterbi_is_the_cheapest_path(restorer):
    rng = random.Random(4)
    for _ in range(300):
        word = rng.choice(WORDS)
        token = "".join(rng.choice([c, c, c + c, c + rng.choice(".-*+"), rng.choice("013457@$!|*" + c)]) for c in word)[:9]
        assert restorer.restore(token) in cheapest(restorer, token)[1], token


def test_only_tokens_that_can_matter_are_left_undecoded(restorer):
    """With known features a reader skips tokens; what it counts is what it would count without skipping."""
    known = {f for w in ("stupid", "idiot", "loser", "all", "i") for f in toxicity.features(w)}
    some, every = toxicity.Reader(restorer, known), toxicity.Reader(restorer)
    rng = random.Random(9)
    for _ in range(3000):
        word = rng.choice([*WORDS, "all", "i", "stupidity", "idiots"])
        token = "".join(rng.choice([c, c, c, c + c, c + rng.choice(".-_*+~'/,:;"), rng.choice("01234567890@$!|+(€£¡*#%" + c)]) for c in word)
        want = {f: n for f, n in every.count(token)[0].items() if f in known} if not toxicity._SPACED.search(token) else None
        if want is not None:
            assert some.count(token)[0] == want, token


@pytest.mark.parametrize("text", ["you are an i d i o t now", "you are an i-d i-o-t now", "you are a i d i o t", "an 1 d 1 0 t", "idiiot", "i_d_i_o_t", "1d!0t", "@n id!ot!!", "(idiot)", "ID10T"])
def test_disguises_of_one_word(restorer, text):
    s = toxicity.Scorer(restorer, {"idiot$": 5.0}, -2.0)
    assert s.score(text) > 0.9, text


@pytest.mark.parametrize("text", ["", "a b c d e f", "it is a 1 2 3 list", "| a | b | c |", "i do it", "x" * 200_000, "1" * 50_000, "a-" * 20_000, "!!!! ((( ###"])
def test_plain_or_long_texts_stay_clean(restorer, text):
    s = toxicity.Scorer(restorer, {"idiot$": 5.0, "stup": 3.0}, -2.0)
    assert s.score(text) < 0.5


def test_a_share_of_the_text_counts(restorer):
    s = toxicity.Scorer(restorer, {"clow": 0.0}, -2.0, {"clow": 1.0})
    assert s.score("clown " * 5 + "the house " * 40) > 0.5 > s.score("clown " + "the house " * 40)


def test_labels_that_clash_count_as_toxic(spark):
    docs = spark.createDataFrame([(k, f"the house {'stupid' if k % 2 else 'small'} letter") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(1, 0), (3, 0), (1, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).score("stupid") > 0.5


def test_doubled_letters_are_restored_without_a_lattice(restorer, monkeypatch):
    rng = random.Random(21)
    tokens = ["".join(rng.choice([c, c + c]) for c in rng.choice(WORDS))[:9] for _ in range(200)]
    tokens = [t for t in tokens if not toxicity._RUN.search(t)]
    want = [cheapest(restorer, t)[1] for t in tokens]
    monkeypatch.setattr(toxicity.Restorer, "lattice", None)
    assert len(tokens) > 150 and all(restorer.restore(t) in w for t, w in zip(tokens, want, strict=True))


def test_cycles_are_not_searched_for_while_rows_are_read():
    batch = pa.RecordBatch.from_arrays([pa.array(range(600))], names=["k"])
    assert gc.isenabled()
    assert [(len(b), gc.isenabled()) for b in toxicity.some_rows([batch, batch])] == 2 * [(256, False), (256, False), (88, False)]
    assert gc.isenabled()


ODD = "abcdeilostllss   \n\t\x1c.,;!?'\"-_*+1|0@$(%#\xa0éßıİñ中\u0301ΣσИ😀𝒜𐌰²½"


def test_texts_read_at_once_count_as_one_by_one(restorer):
    rng = random.Random(12)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choice([c, c, c + c, c * 3]) for c in rng.choice(WORDS)) for _ in range(20)) for _ in range(300)]
    texts += ["", "\n", "x" * 300, "a" * 33 + "b", "i d i o t", "an i-d i-o-t", "y a o", "!" * 500, "stupid..", "stuppid stupid stupiddd"]
    every = toxicity.Reader(restorer)
    known = sorted({f for t in texts for f in sorted(every.present(t))[::3]} | set(toxicity.features("stupid")) | set(toxicity.features("idiot")))
    rng.shuffle(known)
    got = []
    for lo, n, row, place, times in toxicity.Reader(restorer, known).found(texts):
        assert lo == len(got)
        some = [({}, x) for x in n.tolist()]
        for r, p, k in zip(row.tolist(), place.tolist(), times.tolist(), strict=True):
            some[r][0][known[p]] = k
        got += some
    one = toxicity.Reader(restorer, set(known))
    assert got == [one.count(t) for t in texts] and sum(map(len, (f for f, _ in got))) > 5000


def test_tokens_of_letters_are_not_read_one_by_one(restorer, monkeypatch):
    s = toxicity.Scorer(restorer, {"idiot$": 5.0, "stup": 3.0}, -2.0)
    rng, slow = random.Random(2), []
    found = toxicity.Reader._found
    monkeypatch.setattr(toxicity.Reader, "_found", lambda self, token: slow.append(token) or found(self, token))
    words = ["".join(rng.choice("abdeilmnorst") for _ in range(rng.randrange(2, 12))) for _ in range(500)]
    words = [w for w in words if not toxicity._RUN.search(w)]
    assert s.score(" ".join([*words, "well,", "1d!ot"])) == s.score(" ".join([*words, "well,", "idiot"])) > 0.9
    assert set(slow) == {"1d!ot"}


def test_threes_of_many_texts_are_those_of_their_words(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["", "aaa bb", "brrr is 𝒜b 😀ab"]
    want = toxicity.threes(Counter(w for t in texts for w in toxicity.plain_words(t)))
    rows = spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts)], "y int, text string")
    assert toxicity.model(rows).cost == toxicity.Restorer.of_threes(want).cost
