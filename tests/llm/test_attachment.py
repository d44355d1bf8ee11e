from __future__ import annotations

from rollcall.llm.variants import components, person_edges


def test_a_long_chain_gets_its_person(spark, rows):
    chain = [f"c{i}" for i in range(7)]
    pairs = [("c0", "d1", 3.0)] + [(a, b, 2.0) for a, b in zip(chain, chain[1:])] + [("k1", "k2", 2.0)]
    scored = spark.createDataFrame([(a, b, p, 0.0, 0.0, 1) for a, b, p in pairs], "a string, b string, pts double, same_id double, same_home double, shared int")
    root = dict(rows(components(person_edges(scored))))
    assert {root[c] for c in chain} == {root["d1"]} and root["k1"] == root["k2"] != root["d1"]
