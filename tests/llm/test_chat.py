"""Repairs against all repairs, without the operator's tables, and the order of tied turns."""

import itertools
import random

import numpy as np
import pytest

from veilspark.llm import chat

ROLES = ("system", "user", "assistant")


def legal(turns):
    """An optional system turn, then user and assistant in turn, at least once, ending with assistant."""
    body = turns[1:] if turns[:1] == ["system"] else turns
    return len(body) > 0 and len(body) % 2 == 0 and all(r == ROLES[1 + k % 2] for k, r in enumerate(body))


def repairs(roles):
    """(cost, turns) of every way: each turn kept, relabelled or merged, with empty turns put before it and after the last."""
    empties = [[], ["user"], ["assistant"]]
    for labels in itertools.product(ROLES, repeat=len(roles)):
        for acts in itertools.product(["new", "merge"], repeat=len(roles)):
            for put in itertools.product(empties, repeat=len(roles)):
                for tail in ([], ["assistant"], ["user", "assistant"]):
                    cost, turns, ok = 3.0 * len(tail), [], True
                    for given, role, act, before in zip(roles, labels, acts, put):
                        cost += 0.0 if role == given else 2.0 if given in ROLES else 1.0
                        if act == "merge":
                            ok = ok and not before and bool(turns) and turns[-1] == role
                            cost += 1.0
                        else:
                            cost += 3.0 * len(before)
                            turns += [*before, role]
                    if ok and legal(turns + tail):
                        yield cost


@pytest.mark.parametrize("n", [1, 2, 3])
def test_cheapest_of_all_repairs(n):
    start = np.array([0, np.inf, np.inf, np.inf])
    for roles in itertools.product([*ROLES, "tool"], repeat=n):
        fixed = chat.repair([chat.known(r) for r in roles], start, None)
        turns, cost = [], 0.0
        for given, (role, action, put) in zip(roles, fixed):
            cost += 0.0 if role == given else 2.0 if given in ROLES else 1.0
            if action == "merge":
                assert turns[-1] == role
                cost += 1.0
            else:
                turns += [ROLES[put - 1]] * bool(put) + [role]
                cost += 3.0 * bool(put)
        tail = {"assistant": [], "user": ["assistant"], "system": ["user", "assistant"]}[turns[-1]]
        assert legal(turns + tail)
        assert cost + 3.0 * len(tail) == min(repairs(roles)), roles


def test_pieces_by_place_are_the_rendering(spark):
    rng = random.Random(6)
    rows = [(c, rng.choice([None, 0, 1, 1, 2]), rng.choice([*ROLES, "User ", None]), rng.choice(["a", "bb", None, f"t{k}"])) for c in (1, 2, None) for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [chat.format_chats(df.repartition(n)).collect() for n in (1, 7)]
    wholes = []
    for run in got:
        by = {}
        for r in sorted(run, key=lambda r: r.place):
            by.setdefault(r.conv_id, []).append(r)
        assert all([r.place for r in x] == list(range(1, 701)) for x in by.values())
        assert all([r.turn is not None for r in x] == sorted(r.turn is not None for r in x) for x in by.values())
        wholes.append({c: "".join(r.piece for r in x) for c, x in by.items()})
    assert wholes[0] == wholes[1]
    for whole in wholes[0].values():
        assert legal([t.split("|>")[0] for t in whole.split("<|")[1:] if not t.startswith("end")])
