from __future__ import annotations

from string import ascii_lowercase

from rollcall.plans.sources import shards_back


def test_every_initial_comes_back(spark, rows):
    names = ["Ada", "kim", "Lou", "zoe", "Änne", " Bo", "", None, "9x", "Zed", '"q']
    c = spark.createDataFrame(list(enumerate(names)), "cand_id long, name string")
    want = [("a", 0), ("k", 1), ("l", 2), ("other", 4), ("other", 5), ("other", 6), ("other", 7), ("other", 8), ("other", 10), ("z", 3), ("z", 9)]
    assert rows(shards_back(spark, c, [*ascii_lowercase, "other"])) == sorted(want, key=repr)
    assert rows(shards_back(spark, c, ["a", "b", "k"])) == [("a", 0), ("k", 1)]
    assert rows(shards_back(spark, c.filter("false"), ["a"])) == []


def test_dotted_capital_i_is_an_i(spark, rows):
    c = spark.createDataFrame([(0, "İbrahim"), (1, "Ivo"), (2, "ırmak"), (3, "K")], "cand_id long, name string")
    assert rows(shards_back(spark, c, [*ascii_lowercase, "other"])) == [("i", 0), ("i", 1), ("k", 3), ("other", 2)]
