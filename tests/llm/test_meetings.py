from __future__ import annotations

import random

from rollcall.llm.persons import name_match
from rollcall.llm.variants import name_meetings, name_pairs


def made(rng, n):
    given = ["sebastian", "emil", "eva", "robert", "bob", "li", "wei", "e", "s", "r", "seb.", "emil.", "sebastain", "cristina", "kristina", "maria", "rnaria"]
    family = ["hohlapig", "hohlapg", "eissig", "eis", "sommer", "reber", "wei", "li", "storn", "stom"]
    out = set()
    while len(out) < n:
        t = [rng.choice(given) for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 7]))] + [rng.choice(family)]
        if rng.random() < 0.3:
            rng.shuffle(t)
        out.add(" ".join(t) + "|" + rng.choice(["", "", "", "0001", "0002"]))
    return sorted(out)


def test_all_names_that_can_be_one_meet(spark):
    names = made(random.Random(3), 400)
    got = {(r["x"], r["y"]) for r in name_pairs(spark.createDataFrame([(n,) for n in names], "n string")).collect()}
    want = {(a, b) for a in names for b in names if a == b or name_match(a, b)[0] > 0}
    want |= {(b, a) for a, b in want}
    assert {p for p in got if p[0] != p[1]} == {p for p in want if p[0] != p[1]}


def test_given_names_alone_bring_no_names_together(spark):
    rng = random.Random(4)
    family = sorted({"".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)) for _ in range(600)})
    names = [f"sebastian {middle} {f}|" for f, middle in zip(family, ["e", "emil"] * 300)]
    met = name_meetings(spark.createDataFrame([(n,) for n in names], "n string")).count()
    assert met < 50  # all with all would be 179,700
