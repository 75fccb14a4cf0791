"""The tagger's parts against enumeration and differences, its spans on texts it wasn't trained on, and texts of any kind."""

import itertools
import random

import numpy as np
import pytest

from veilspark.llm import pii


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(2)
    t = pii.Tagger(embed=4, hidden=3, seed=5)
    t.p["T"] = rng.normal(size=t.p["T"].shape)
    t.p["S"] = rng.normal(size=t.p["S"].shape)
    return t


def all_paths(t, e):
    """(score, path) of every path of scores (time, tags)."""
    trans, start = t.p["T"] + pii._FORBID, t.p["S"] + pii._START
    for path in itertools.product(range(pii.TAGS), repeat=len(e)):
        yield start[path[0]] + sum(e[k, y] for k, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])), path


def test_viterbi_and_marginals_by_enumeration(small):
    rng = np.random.default_rng(7)
    length = np.array([4, 4, 3, 2, 1])
    e = rng.normal(0, 2, (4, len(length), pii.TAGS))
    path, chance = small.decode(e, length)
    marginals = small.chances(e, length)
    for i, n in enumerate(length):
        every = list(all_paths(small, e[:n, i]))
        top = max(s for s, _ in every)
        z = sum(np.exp(s - top) for s, _ in every)
        assert tuple(path[:n, i]) == max(every)[1]
        want = np.zeros((n, pii.TAGS))
        for s, p in every:
            want[np.arange(n), p] += np.exp(s - top) / z
        assert np.allclose(marginals[:n, i], want)
        if path[:n, i].any():
            assert np.allclose(chance[:n, i], want[np.arange(n), path[:n, i]])


def test_gradient_is_the_loss_by_differences():
    """One step from the same weights moves the loss as finite differences say, for every kind of weight."""
    rng = np.random.default_rng(3)
    s = rng.integers(0, pii.SYMBOLS, (6, 12)).astype(np.uint8)
    y = np.zeros((6, 12), np.int64)
    y[:, 3], y[:, 4:6] = 1, 2
    seen = {}

    class Spy(pii.Tagger):
        def _lstm_back(self, x, d, kept, dout, grad):
            out = super()._lstm_back(x, d, kept, dout, grad)
            seen.update({k: v.copy() for k, v in grad.items()})
            return out

    def loss(p):
        t = pii.Tagger(embed=4, hidden=3, seed=5)
        t.p = p
        e = t.emissions(s).transpose(1, 0, 2)
        z = t.marginals(e)[2]
        trans, start = t.p["T"] + pii._FORBID, t.p["S"] + pii._START
        gold = sum(start[y[i, 0]] + e[np.arange(12), i, y[i]].sum() + trans[y[i, :-1], y[i, 1:]].sum() for i in range(6))
        return (z.sum() - gold) / 6

    t = Spy(embed=4, hidden=3, seed=5)
    before = {k: v.copy() for k, v in t.p.items()}
    s, y = np.repeat(s[:1], 6, 0), np.repeat(y[:1], 6, 0)  # all rows alike, so that any draw is the same
    t.fit(s, y, steps=1, batch=6)
    checked = 0
    for k, g in seen.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 7)]:
            up, down = ({n: v.copy() for n, v in before.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert np.isclose((loss(up) - loss(down)) / 2e-5, g[at], rtol=1e-3, atol=1e-6), (k, at)
            checked += 1
    assert checked > 40 and {"W", "b", "T", "S", "fx", "fh", "fc", "bx", "bh", "bc"} <= seen.keys()


def a_span(kind, rng):
    if kind == "email":
        return f"{rng.choice(['joe', 'anna.lee', 'k_wu'])}{rng.randrange(100)}@{rng.choice(['mail', 'post', 'x1'])}.example.{rng.choice(['com', 'org', 'net'])}"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "phone":
        return f"+{rng.choice([1, 33, 49])} ({rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
    body = "".join(str(rng.randrange(10)) for _ in range(15))
    return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))


def corpus(seed, n, respell):
    """Texts with one span each, or with none but numbers; (text, kind, start, end) or (text, None, 0, 0)."""
    rng, nrng = random.Random(seed), np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "th re on en la que ment ung ció ble".split() for b in "a e o er ing tion ly de".split()]
    out = []
    for i in range(n):
        left, right = (" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(2))
        if i % 4 == 3:
            number = rng.choice([f"{rng.randrange(3000)}", f"version {rng.randrange(9)}.{rng.randrange(20)}", f"{rng.randrange(99)} {rng.randrange(99)}", f"9{rng.randrange(10**11)}"])
            out.append((f"{left} {number} {right}", None, 0, 0))
            continue
        kind = rng.choice(pii.KINDS)
        span = a_span(kind, rng)
        span = pii.respelt(kind, span, nrng) if respell else span
        out.append((f"{left} {span} {right}", kind, len(left) + 1, len(left) + 1 + len(span)))
    return out


@pytest.fixture(scope="module")
def tagger():
    x, y = pii.windows_of([t for t, *_ in corpus(1, 1500, False)])
    t = pii.Tagger()
    t.fit(x, y)
    return t


def test_spans_that_patterns_miss_are_found_in_new_texts(tagger):
    rows = corpus(99, 600, True)
    texts = [t for t, *_ in rows]
    base = [pii.base_spans(t) for t in texts]
    found = pii.all_spans(tagger, texts, base)
    missed = [i for i, (_, k, a, b) in enumerate(rows) if k and (k, a, b) not in base[i]]
    hit = sum((rows[i][1], rows[i][2], rows[i][3]) in found[i] for i in missed)
    wrong = sum(len(f) for f, (_, k, _, _) in zip(found, rows) if k is None)
    assert len(missed) > 250
    assert hit >= 0.8 * len(missed), (hit, len(missed))
    assert wrong <= 3
    assert all(set(b) <= set(f) for b, f in zip(base, found))


def test_numbers_side_by_side_are_told_apart(tagger):
    """A telephone pattern reads on into the number after it, and then fails its check."""
    rng = random.Random(12)
    texts = [f"the quede ing {a_span('phone', rng)} {a_span('ip', rng)} blee on" for _ in range(60)]
    base = [pii.base_spans(t) for t in texts]
    alone = [i for i, b in enumerate(base) if [k for k, _, _ in b] == ["ip"]]
    assert len(alone) > 40
    found = pii.all_spans(tagger, texts, base)
    right = [("phone", 14, texts[i].rindex(" ", 0, base[i][0][1])) in found[i] for i in alone]
    assert sum(right) >= 0.7 * len(alone), (sum(right), len(alone))


def test_texts_of_any_kind_with_a_tagger(tagger, spark):
    span = "joe7 @ mail.example.com"
    long = "theing blee quede " * 20_000 + span + " 12 " * 30_000 + span + " laon" * 100
    rows = [(1, None), (2, ""), (3, "   "), (4, long), (5, "1" * 60_000), (6, f"re {span} on"), (6, f"re {span} on"), (None, f"re {span} on"), (7, "é🙂 @@@ 1.2.3.4.5 漢字 9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.digests(docs, tagger).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].spans == by[2][0].spans == by[3][0].spans == "" and by[1][0].n_email == 0
    assert by[6][0] == by[6][1] and by[6][0].spans == by[None][0].spans == f"email:3:{3 + len(span)}"
    first, second = long.index(span), long.rindex(span)
    assert by[4][0].spans == f"email:{first}:{first + len(span)},email:{second}:{second + len(span)}"
    assert all(not r.spans or r.doc_id != 5 for r in got)
    masked = {r.doc_id: r.text for r in pii.redact(docs, tagger).collect()}
    assert masked[4] == long.replace(span, "[EMAIL]") and masked[1] is None and masked[2] == ""


def test_long_stretches_are_read_in_parts_without_a_difference(tagger, monkeypatch):
    text = " ".join(t for t, *_ in corpus(5, 120, True)) + " 77 88 " * 300
    whole = pii.model_spans(tagger, [text])
    assert whole[0]
    monkeypatch.setattr(pii, "PART", 1500)
    monkeypatch.setattr(pii, "HELD", 4000)
    assert pii.model_spans(tagger, [text]) == whole
