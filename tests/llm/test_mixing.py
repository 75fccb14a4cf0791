"""The mix against plain Python: iterated resharing, one seat at a time, and rings word by word."""

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from veilspark.llm import mixing


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def seats_won(shares, seats):
    """Highest quotients share / (2k + 1), one seat after another; ties to the smaller key."""
    won = dict.fromkeys(shares, 0)
    for _ in range(seats if any(shares.values()) else 0):
        best = min((k for k in shares if shares[k]), key=lambda k: ((2 * won[k] + 1) / shares[k], k))
        won[best] += 1
    return won


def brute(rows, block, most, seed, rows_per_shard):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(z for z, (_, _, s) in zip(size, rows) if s == n) for n in names}
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    target, free, left = {}, set(names), Fraction(sum(size))
    while free:
        level = left / sum(weight[n] for n in free)
        above = {n for n in free if level * weight[n] >= most * total[n]}
        if not above:
            target |= {n: level * weight[n] for n in free}
            break
        for n in above:
            target[n] = Fraction(most * total[n])
            left -= target[n]
        free -= above
    block = max(1, min(block, sum(size) // (32 * max(1, len(names)))))
    blocks = seats_won({k: float(target[n]) for k, n in enumerate(names)}, sum(size) // block)
    out = []
    for k, n in enumerate(names):
        mine = [i for i, r in enumerate(rows) if r[2] == n]
        shards = defaultdict(list)
        for i in mine:
            h = md5(f"{seed}:{'' if rows[i][0] is None else rows[i][0]}:{md5(rows[i][1] or '')}")
            shards[int(h[:8], 16) % math.ceil(len(mine) / rows_per_shard)].append((h, -1 if rows[i][0] is None else rows[i][0], size[i], i))
        quota = seats_won({s: sum(x[2] for x in m) for s, m in shards.items()}, blocks[k])
        for s, m in shards.items():
            ring = [i for _, _, z, i in sorted(m) for _ in range(z)]
            taken = defaultdict(int)
            if ring:
                start = int(md5(f"{seed}:{k + 1}:{s}")[:8], 16) % math.ceil(len(ring) / block) * block
                for w in range(min(quota[s] * block, most * len(ring))):
                    taken[ring[(start + w) % len(ring)]] += 1
            out += [(rows[i][0], size[i], total[n], float(target[n]), taken[i], n) for _, _, _, i in m]
    return out


def same(got, want):
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, r.source) for r in got), key=str) == sorted(((*w[:3], round(w[3], 6), *w[4:]) for w in want), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_many_sources_and_shards(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", None, "", "ß", "tiny", *(f"host{k}" for k in range(12))]
    rows = []
    for i in range(260):
        source = rng.choice(names[:2]) if i % 2 else rng.choice(names)
        words = rng.choice([0, 1, 3, 20, 60, 400 if i == 7 else 30])
        rows.append((rng.choice([i, i, i, None, 5]), rng.choice([" ".join(f"w{rng.randrange(90)}" for _ in range(words)), "one two"]) if i % 9 else None, "tiny" if i == 3 else source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for block, per in ((32, 2048), (4, 8), (7, 1)):
        same(mixing.mix(docs, block=block, rows_per_shard=per).collect(), brute(rows, block, 3, 42, per))


def test_a_tiny_mix_is_within_a_word_of_its_targets(spark):
    rows = [(k, "one two three", "abc"[k % 3]) for k in range(9)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    same(got, brute(rows, 32, 3, 42, 2048))
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    one = mixing.mix(spark.createDataFrame([(1, "word", "s")], "doc_id long, text string, source string")).collect()
    assert [(r.taken, r.target) for r in one] == [(1, 1.0)]


def test_places_over_ranges(spark):
    rows = [(k * 7919 % 1000, k) for k in range(1000)]
    got = mixing.numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a"], "n").collect()
    assert len(got) == 1000 and all(r.n == r.a + 1 for r in got)
