from __future__ import annotations

from rollcall.operators import identity as I  # noqa: E741
from rollcall.operators import ledger as L

PERSONS = [("p1", "Jan Petrenz 0001", ""), ("p2", "Jan Petrenz 0002", ""), ("p3", "Jakob H. Mackan", "Jacob Mackan"), ("p4", "Ulla Kern", ""), ("p5", "Ute Kern", ""), ("p6", "Verena Wolfram", ""), ("p7", "Hanno Lenz", ""), ("p8", "Hanno P. Lenz", ""), ("p9", None, None)]


def index(spark):
    persons = spark.createDataFrame(PERSONS, "pid string, primary_name string, aliases string")
    keys = I.key_table(I.person_forms(persons))
    return keys, I.index(keys)


def test_precedence_and_refusal(spark):
    _, idx = index(spark)
    names = ["Jan Petrenz 0002", "Jan Petrenz", "Jakob Mackan", "Jacob Mackan", "U. Kern", "V. Wolfram", "Valentin Wolfram", "Prof. Dr. Ulla Kern", "", None, "Nobody Known", "Hanno Lenz"]
    asked = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {r["id"]: (r["target"], r["how"]) for r in I.resolve(asked, "id", "name", idx).collect()}
    assert got[0] == ("Jan Petrenz 0002", "exact")
    assert got[1] == (None, "ambiguous_full")
    assert got[2] == ("Jakob H. Mackan", "first_last")
    assert got[3] == ("Jakob H. Mackan", "full")
    assert got[4] == (None, "ambiguous_initial_last")
    assert got[5] == ("Verena Wolfram", "initial_last")
    assert got[6] == (None, "no_match")  # an initial never contracts a full given name
    assert got[7] == ("Ulla Kern", "full")
    assert got[8] == got[9] == (None, "empty")
    assert got[10] == (None, "no_match")
    assert got[11] == ("Hanno Lenz", "full")


def test_city_settles_only_when_decisive(spark):
    keys, idx = index(spark)
    asked = spark.createDataFrame([(1, "Hanno Lenz", "Essen"), (2, "Ulla Kern", "Essen")], "id int, name string, city string")
    places = spark.createDataFrame([("Hanno P. Lenz", "Hochschule Essen"), ("Hanno Lenz", "Giessen"), ("Ulla Kern", "Giessen")], "target string, affiliation string")
    out = I.settle_by_city(asked, "id", "city", I.resolve(asked, "id", "name", idx), I.candidates(asked, "id", "name", keys), places)
    got = {r["id"]: (r["target"], r["how"]) for r in out.collect()}
    assert got == {1: ("Hanno P. Lenz", "affiliation"), 2: ("Ulla Kern", "full")}


def test_weak_names_never_compete(spark, rows):
    keys, _ = index(spark)
    authors = spark.createDataFrame([("Jacob Mackan",), ("New Name",), ("New Náme",), (None,), ("New Name",)], "author string")
    assert rows(I.weak_names(authors, keys)) == [("new name", "New Name")]


def test_ledger_is_idempotent_and_ordered(spark, rows):
    e = [("c", "p", "A", "", "", "x", None, 1), ("c", "p", "B", "", "", "x", "", 2), ("c", "p", "A", "", "", "x", "", 3), ("c", "q", "A", None, "", "x", "", 4)]
    entries = spark.createDataFrame(e, "city string, person string, decision string, reason_code string, rule string, by string, evidence string, ord int")
    empty = L.with_id(entries).filter("false")
    led = L.append(empty, entries)
    assert [r["ord"] for r in led.orderBy("ord").collect()] == [1, 2, 4]  # null and '' are one, A comes once
    assert L.append(led, entries).count() == 0
    assert rows(L.current(led).select("person", "decision")) == [("p", "B"), ("q", "A")]
    assert rows(L.flips(led).select("person", "path")) == [("p", "A -> B")]
    sup = {r["ord"]: r["supersedes"] for r in L.supersedes(led).collect()}
    assert sup[1] is None and sup[2] is not None and sup[4] is None
    assert L.history(led, "Q").count() == 1
