from __future__ import annotations

import difflib

from pyspark.sql import functions as F

from rollcall.functions import names as N
from rollcall.functions.text_udfs import name_agrees
from rollcall.plans.picks import _blocks, pick_institutions, settle_institutions

I_SCHEMA, C_SCHEMA = "inst_key long, name string, country string, homepage string", "cand_id long, affiliation string, country string, homepage string"


def test_common_words_still_meet_their_institutions(spark):
    inst = [(i, f"Academy of Robotics {chr(97 + i // 26)}{chr(97 + i % 26)}", ("at", "de", None)[i % 3], f"https://www.a{i}.example" if i % 4 else None) for i in range(120)]
    cands = [(1, "Robotics Academy", "de", None), (2, "ACADEMY OF ROBOTICS CB", "at", ""), (3, "Academy", None, "https://x.a7.example"), (4, "Robotics", "fr", "https://x.a9.example"), (5, "Nowhere", "de", None), (6, None, "de", None), (7, "Robotics Academy", "de", None)]
    i, c = spark.createDataFrame(inst, I_SCHEMA), spark.createDataFrame(cands, C_SCHEMA)
    got = {r["cand_id"]: (r["inst_key"], r["similarity"], r["status"]) for r in pick_institutions(c, i).collect()}
    host = lambda x: x.split("//")[1].removeprefix("www.") if x else None
    want = {}
    for k, a, country, home in cands:
        if a is None:
            continue
        best = None
        for key, name, other, page in inst:
            if {w for w in a.lower().split() if len(w) > 3} & set(name.lower().split()):
                same = None if country is None or other is None else country == other
                d = bool(host(home) and host(page) and host(home).endswith(host(page)))
                s = difflib.SequenceMatcher(None, a.lower(), name.lower()).ratio()
                o = ((-1 if same is None else int(same)), d, s, -key)
                best = o if best is None or o > best else best
        want[k] = (None, None, "no_match") if best is None else (-best[3], round(best[2], 6), "auto" if best[0] == 1 and (best[2] >= 0.75 or best[1]) else "needs_review")
    assert got == want and sum(v[2] == "no_match" for v in got.values()) == 1


def test_blocks_of_any_size_give_the_same(spark, rows):
    words = lambda df: df.withColumn("words", N.distinctive_tokens(F.col("text")))
    left = words(spark.createDataFrame([(i, f"academy {i % 7} robotics", "de", None) for i in range(30)], "id long, text string, country string, host string"))
    right = words(spark.createDataFrame([(i, f"robotics {i % 5} academy", "de", None) for i in range(40)], "key long, text string, country string, host string"))
    assert rows(_blocks(left, right, "country", 4, 3)) == rows(_blocks(left, right, None)) and _blocks(left, right, None).count() == 30


def test_status_of_matches(spark, rows):
    i = spark.createDataFrame(
        [
            (1, "a", "de", "Tubingen", "r1", "de", "Tübingen", 1.0, 0.9, False, None), (2, "b", "de", "Tubingen", "r2", "de", "Munich", 1.0, 0.9, True, ""), (3, "c", "it", "Torino", "r3", "it", "Turin", 1.0, 0.8, False, ""),
            (4, "d", "it", None, "r4", "fr", "Nice", 1.0, 0.9, True, ""), (5, "e", "it", "", None, None, None, None, None, None, "a"), (6, "f", "it", "", "", "", "", None, None, None, ""), (7, "g", "it", "Bari", "r7", "it", "Bari", None, 0.2, False, "nowhere"), (8, "h", "it", "Bari", "r8", "it", "Bari", 2.0, 0.2, True, "a"),
        ],
        "inst_key long, inst_id string, country string, city_expected string, ror_id string, ror_country string, ror_city string, lat double, similarity double, domain_match boolean, coords_from string",
    )
    assert rows(settle_institutions(i)) == [
        (1, "auto", ""), (2, "needs_review", "expected Tubingen, found Munich (unrelated)"), (3, "auto", "expected Torino, found Turin"), (4, "needs_review", ""), (5, "anchored", ""), (6, "no_match", ""), (7, "needs_review", ""), (8, "auto", ""),
    ]
    assert rows(settle_institutions(i.filter("false"))) == []


def test_names_agree_by_words_heads_holding_and_likeness(spark):
    cases = [("technische universitat ortell", "ortell technical college", "ortell", True), ("university of zurich", "ph zurich", "zurich", False), ("university of tubingen", "universitat tubingen", "tubingen", True), ("norvale research lab", "norvale", "", True), ("norvale", "", "", False), (None, None, None, False), ("mit", "massachusetts", None, False)]
    df = spark.createDataFrame(cases, "a string, b string, c string, want boolean")
    got = df.select(name_agrees(F.col("a"), F.col("b"), F.col("c")).alias("x"), "want").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]
