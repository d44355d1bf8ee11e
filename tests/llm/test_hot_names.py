from __future__ import annotations

from rollcall.llm.persons import describe
from rollcall.llm.variants import linked_variants, same_names

SCHEMA = "key string, kind string, spellings array<string>, affiliations array<string>, orcid string, homepage string"


def test_a_hot_name_meets_records_without_a_place(spark):
    recs = [(f"c{i:03}", "c", ["Quillfors, Ada"], [f"Place{i}burgh"], "", "") for i in range(60)] + [("d1", "d", ["Ada Quillfors 0001"], None, "", ""), ("c900", "c", ["A. Quillfors"], None, "", "")]
    got = {tuple(r) for r in linked_variants(spark.createDataFrame(recs, SCHEMA)).collect()}
    assert got >= {(f"c{i:03}", "d1") for i in range(60)} | {("c900", "d1")}


def test_short_forms_meet_under_a_hot_name_at_a_crowded_place(spark):
    recs = [(f"c{i:02}", "c", ["Robert Crowfield"], ["Hollmere Academy"], "", f"https://x.example/~u{chr(97 + i)}") for i in range(20)] + [("k1", "k", ["Bob Crowfield"], ["Hollmere Academy"], "", ""), ("k2", "k", ["Bobby Crowfield"], None, "", ""), ("k3", "k", ["Crowfield"], None, "", ""), ("k4", "k", ["Crowfield"], ["Hollmere"], "", "")]
    got = {(r["a"], r["b"]) for r in same_names(describe(spark.createDataFrame(recs, SCHEMA))).collect()}
    assert got >= {(f"c{i:02}", k) for i in range(20) for k in ("k1", "k2")} | {("k1", "k2"), ("k3", "k4")}


def test_many_persons_of_equal_initials_without_a_place(spark):
    given = ["Ab" + x for x in "ara eli ino odo ulu ana eso iva oma una are ile ofa upo ady eck igh oll umm ynn".split()]
    family = ["Qu" + x for x in "illfors akenby ebarow odlane umstead anthorp elvik istrand orbeck ustrup artley enholm ingrave osswell undmark avering estmoor ildgard okeland urchard".split()]
    recs = [(f"d{i:02}{j:02}", "d", [f"{g} {f}"], None, "", "") for i, g in enumerate(given) for j, f in enumerate(family)] + [(f"c{i:02}{j:02}", "c", [f"{f}, {g}"], None, "", "") for i, g in enumerate(given) for j, f in enumerate(family)]
    got = {tuple(r) for r in linked_variants(spark.createDataFrame(recs, SCHEMA)).collect()}
    assert got == {(f"c{i:02}{j:02}", f"d{i:02}{j:02}") for i in range(20) for j in range(20)}


def test_short_names(spark, rows):
    recs = [("d1", "d", ["Li Wei"], ["Hollmere Academy"], "", ""), ("c1", "c", ["Wei, Li"], ["Hollmere Academy"], "", ""), ("d2", "d", ["Xu Bo"], ["Norvale"], "", ""), ("k2", "k", ["Bo Xu"], None, "", ""), ("d3", "d", ["Di Wu"], None, "", ""), ("c3", "c", ["Wu, Di"], None, "", ""), ("c4", "c", ["Li We"], ["Hollmere Academy"], "", "")]
    assert rows(linked_variants(spark.createDataFrame(recs, SCHEMA))) == [("c1", "d1"), ("c3", "d3"), ("d2", "k2")]
