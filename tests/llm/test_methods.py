"""Methods against brute force, libraries and held-out labels."""

import array
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import bpe, chat, graph, language, minhash, pii, polytope, quality, toxicity
from veilspark.llm import textbytes as tb
from veilspark.session import table

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_texts(seed, n):
    """Families of texts at all distances, some sharing a passage."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(25)]
    out = []
    for _ in range(n // 20):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 90))] + (passage if rng.random() < 0.4 else [])
        for _ in range(20):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("percent", "leaf"), [(85, 128), (85, 8), (80, 6), (65, 10), (50, 6)])
def test_near_duplicates_match_all_pairs(spark, percent, leaf):
    texts = dict(enumerate(near_texts(3, 400), 100))
    sets = {k: shingle_set(t) for k, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(texts, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0]
    want = smallest_reachable(texts, links)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, percent=percent, leaf=leaf).collect()}
    assert {k: r.n_shingles for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert {k: r.component_id for k, r in got.items()} == want


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(500, k) for k in range(100, 200)] + [(900 + i, 900 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    nodes = {x for p in links for x in p}
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.root for r in graph.components(df).collect()} == smallest_reachable(nodes, links)


@pytest.mark.parametrize("leaf", [128, 6])
def test_vector_links_match_all_pairs(spark, leaf):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([c + rng.normal(size=(25, 24)) * s for c, s in zip(centres, np.linspace(0.02, 0.25, 12), strict=True)]).astype(np.float32)
    label = np.repeat(np.arange(12) % 3, 25)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = (u @ u.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    want = smallest_reachable(range(len(x)), list(zip(*map(list, np.nonzero(hit)), strict=True)))
    df = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(len(x))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in polytope.near_vectors(df, leaf=leaf).collect()}
    assert [got[i].n_links for i in range(len(x))] == hit.sum(1).tolist()
    assert {i: r.component_id for i, r in got.items()} == want


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(2).normal(size=(5, 16))
    assert np.allclose((polytope.hadamard(x) ** 2).sum(1), 16 * (x**2).sum(1))


def test_words_and_windows_match_split():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é🙂\n\t \x0b\x0c\r\x85 ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts, stops, row, count = tb.words(data, off)
    want = [r.split() for r in raw]
    assert count.tolist() == list(map(len, want))
    assert [data[a:b].tobytes() for a, b in zip(starts, stops, strict=True)] == [w for ws in want for w in ws]
    h = tb.hashes(data, starts, stops)
    assert (h == tb.hashes(data, starts, stops, most=16)).all()
    flat = [w for ws in want for w in ws]
    assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(flat, h.tolist(), strict=True)))


def test_quality_order_does_not_change_verdicts(spark):
    docs = table(spark, SF, "documents")
    one = {r.doc_id: r.kept for r in quality.judge(docs, rules=quality.RULES).collect()}
    two = {r.doc_id: r.kept for r in quality.judge(docs, rules=tuple(reversed(quality.RULES))).collect()}
    assert one == two and {r.name for r in quality.order_rules(docs)} == {r.name for r in quality.RULES}


def test_bpe_equals_the_library():
    import public_tokenizers
    import tiktoken

    b = bpe.default_bpe()
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(b.tokens)}, special_tokens={})
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdeé ñ\n\t 0129'sS.!?　漢字🙂xX") for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["", "a" * 30_000, " " * 500, "<|endoftext|>"]
    for t in texts:
        ids = b.encode(t)
        assert array.array("I", e.encode_ordinary(t)).tobytes() == ids and b.decode(ids) == t.encode()
    assert all(b.lookup(t) == i for i, t in enumerate(b.tokens)) and b.lookup(b"no such token") == -1
    assert sorted(b.hash.slot(t) for t in b.tokens) == list(range(len(b.tokens)))


def naive_spans(t):
    found = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub(r"[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15):
                found.append((kind, m.start(), m.end()))
    return found


def test_patterns_match_their_regexes():
    rng = random.Random(4)
    for _ in range(20_000):
        t = "".join(rng.choice("0123.1.2@@a-b+ ()é,x4") for _ in range(rng.randint(0, 40)))
        assert naive_spans(t) == pii.base_spans(t), t


def test_tagger_learns_and_gradients_are_right():
    rng = np.random.default_rng(0)
    texts = [f"please call {'+1 (%03d) 555-%04d' % tuple(rng.integers(0, 999, 2))} or mail a{k}@mail{k % 9}.example.com today, room {k}" for k in range(120)]
    x, y = pii.windows_of(texts)
    m = pii.Tagger()

    def loss(t):
        e = t.emissions(x[:2]).transpose(1, 0, 2)
        z = t.marginals(e)[2].sum()
        yb = y[:2].T
        gold = np.take_along_axis(e, yb[:, :, None], 2).sum() + t.p["T"][yb[:-1], yb[1:]].sum() + t.p["S"][yb[0]].sum()
        return (z - gold) / 2

    before = loss(m)
    m.fit(x, y, steps=120)
    assert loss(m) < 0.2 * before
    text = "ring me: (187) 555-8851, thanks"
    assert pii.all_spans(m, [text], [pii.base_spans(text)])[0] == [("phone", 9, 23)]
    clean = "nothing here but 3 words and room 12."
    assert pii.all_spans(m, [clean], [[]])[0] == []


def test_chat_repairs_are_cheapest():
    def brute(roles):
        costs = {0: 0.0}
        for r in roles:
            new = {}
            for (s, t), (c, _, _) in chat.options(r).items():
                if s in costs:
                    new[t] = min(new.get(t, np.inf), costs[s] + c)
            costs = new
        return min(c + chat.FINAL[s] for s, c in costs.items())

    start = np.array([0, np.inf, np.inf, np.inf])
    for n in range(1, 5):
        for roles in itertools.product([*chat.ROLES, None], repeat=n):
            s, cost = 0, 0.0
            for given, (role, action, put) in zip(roles, chat.repair(list(roles), start, None), strict=True):
                t = chat.ROLES.index(role) + 1
                assert chat.options(given)[s, t][1:] == (action, put)
                cost += chat.options(given)[s, t][0]
                s = t
            assert cost + chat.FINAL[s] == brute(roles)


def test_long_conversation_is_cut_over_tasks(spark):
    rng = random.Random(8)
    roles = [rng.choice(["user", "assistant", "system", "tool"]) for _ in range(3000)]
    df = spark.createDataFrame([(1, i, r, str(i)) for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    rows = chat.format_chats(df).orderBy("turn").collect()
    start = np.array([0, np.inf, np.inf, np.inf])

    def cost(acts):
        s = total = 0
        for given, (role, action, put) in zip(roles, acts, strict=True):
            t = chat.ROLES.index(role) + 1
            total += chat.options(chat.known(given))[s, t][0]
            s = t
        return total + chat.FINAL[s]

    best = chat.repair([chat.known(r) for r in roles], start, None)
    assert cost([(r.role, r.action, r.n_inserted) for r in rows]) == cost(best)
    whole = "".join(r.piece for r in rows)
    turns = re.findall(r"<\|(system|user|assistant)\|>\n", whole)
    assert turns[0] in ("system", "user") and turns[-1] == "assistant" and "system" not in turns[1:]
    assert all(a != b for a, b in itertools.pairwise(turns)) and whole.count(chat.END) == len(turns)


def test_automaton_parses_longest_matches():
    rng = random.Random(9)
    train, other = ("".join(rng.choice("abc") for _ in range(n)) for n in (200, 300))
    m = language.Model({"x": [train]}, letters=1000)
    s = m.symbols(other)
    want, i = 0, 0
    while i < len(other):
        n = 1
        while i + n < len(other) and other[i : i + n + 1] in train:
            n += 1
        i, want = i + n, want + 1
    assert m.phrases([s])[0, 0] == want


def test_language_on_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.join(language.op7_language(spark, "/root/testdata/sf0.01"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)


def test_restorer_and_toxicity_on_held_out(spark):
    plain = Counter({w: 50 for w in "stupid idiot moron the and other worthless pathetic house small".split()})
    r = toxicity.Restorer(plain)
    for given, want in [("1d10t", "idiot"), ("stuuupiiid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("$tup1d", "stupid"), ("w0rthle$$", "worthless"), ("house", "house")]:
        assert r.restore(given) == want
    sf = "/root/testdata/sf0.01"
    got = toxicity.op6_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    wrong = sum(x.predicted != x.toxic for x in got)
    assert len(got) > 50 and wrong <= 0.05 * len(got)
