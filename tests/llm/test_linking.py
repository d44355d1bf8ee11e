from __future__ import annotations

import random

import numpy as np

from rollcall.llm.canonical import map_titles_and_places, set_similarity_join
from rollcall.llm.linkage import RULE, admm, confidences, ground, link_candidates
from rollcall.llm.persons import clean_orcid, homepage_key, lcs, name_key, name_match, token_match
from rollcall.llm.variants import components, linked_variants, name_pairs, slips, variant_classes


def test_prefix_filter_join_is_complete(spark):
    rng = random.Random(7)
    words = [chr(97 + i) for i in range(14)]
    make = lambda n: [(rng.choice("xy"), f"r{i}", sorted(set(rng.choices(words, k=rng.randint(0, 9))))) for i in range(n)]
    left, right = make(90), make(60)
    schema = "grp string, id string, tokens array<string>"
    for t in (0.3, 0.5, 0.8, 1.0):
        got = {(r["grp"], r["left_id"], r["right_id"]) for r in set_similarity_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), t).collect()}
        want = {(g, a, b) for g, a, x in left for h, b, y in right if g == h and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= t}
        assert got == want


def test_titles_and_places(spark):
    titles = spark.createDataFrame([(1, "de", "Universitätsprofessor", "x"), (36, "XX", "Professor", "any professor"), (37, "XX", "Associate Professor", "any associate"), (38, "XX", "Assistant Professor", "any assistant")], "title_id long, country string, title_local string, title_en string")
    cities = spark.createDataFrame([(1, "Mühfeld", "de", None), (2, "Saint-Ortell", "fr", ""), (3, "Mühfeld", "at", "Muehfeldau")], "city_id long, city string, country string, alt_names string")
    inst = spark.createDataFrame([(1, "i1", "DE", "Muehfeld", "Mühfeld"), (2, "i2", "fr", "12345 St-Ortell, France", "Zuyderspoor"), (3, "i3", "at", "  Mühfeld ", None), (4, None, None, "Mühfeld", "")], "inst_key long, inst_id string, country string, city_expected string, ror_city string")
    roster = spark.createDataFrame([(1, "i1", "Univ.-Prof. Dr."), (2, "i2", "Assoc. Prof."), (3, "i1", "Hausmeister"), (4, "i1", "Professor"), (5, "i3", None), (6, "i3", "  "), (7, "i2", "Professor, Assocoate"), (8, None, "Asst. Prof."), (9, "i2", "Team Assistant")], "roster_id long, inst_id string, title_verbatim string")
    got = {(r["field_name"], r["row_key"]): r["canon_id"] for r in map_titles_and_places(roster, inst, titles, cities).collect()}
    assert got == {
        ("title_verbatim", 1): 1, ("title_verbatim", 2): 37, ("title_verbatim", 3): 0, ("title_verbatim", 7): 37, ("title_verbatim", 8): 38, ("title_verbatim", 9): 0,
        ("city_expected", 1): 1, ("city_expected", 2): 2, ("ror_city", 2): 0, ("city_expected", 3): 3, ("city_expected", 4): 0,
    }
    assert map_titles_and_places(roster.filter("false"), inst.filter("false"), titles, cities).count() == 0


def test_names():
    for a, b in [("Ada B. Quillfors", "Quillfors, Ada"), ("Ben Crowfield", "Benjamin Crowfield 0001"), ("A. Quillfors", "Ada Quillfors"), ("QUILLFORS Ada", "Ada Quillfors"), ("Søren Åsakstrøm", "Soren Aasakstroem"), ("Qui11fors Ada", "Ada Quillfors"), ("Chri. Maromthwaite", "Christopher Maromthwaite")]:
        assert name_match(name_key(a), name_key(b))[0] > 0, (a, b)
    for a, b in [("Ada Quillfors 0001", "Ada Quillfors 0002"), ("Ada Quillfors", "Ida Quellmors"), ("Jo Kuipevboer", "Jo Kuipulboer"), ("Ada P. Quillfors", "Ada Z. Quillfors"), ("Johan Wijnevar", "Johan W. Kuipboer"), ("", "Ada Quillfors")]:
        assert name_match(name_key(a), name_key(b))[0] == 0, (a, b)
    assert lcs("abcbdab", "bdcaba") == 4 and lcs("", "abc") == 0
    assert token_match("ada", "ada") == (1.0, False) and token_match("a", "ada") == (0.6, False) and token_match("kuipers", "kuypers") == (12 / 14, True) and token_match("kuipers", "kuyperd")[0] == 0
    assert clean_orcid("https://orcid.example/0042-1111-2222-333x") == "004211112222333X" and clean_orcid("0000-0000-0000-0000") == "" and clean_orcid(None) == ""
    assert homepage_key("https://WWW.people.x-1.example/~AQUILL12/index.html") == ("x-1.example", "aquill")


def test_components(spark, rows):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z1", "z2"), ("z2", "z1"), ("z3", "z3")]
    got = dict(rows(components(spark.createDataFrame(edges, "a string, b string"))))
    assert all(got[f"n{i:03}"] == "n000" for i in range(41)) and got["z2"] == "z1" and got["z3"] == "z3"


def test_solver_reaches_the_minimum():
    rng = np.random.default_rng(2)
    # Variables 0..3 are matches of two records (0, 1 and 2, 3), 4 tells that the records are one.
    index = np.array([[0, -1, -1], [0, -1, -1], [1, -1, -1], [2, -1, -1], [3, -1, -1], [4, -1, -1], [4, -1, -1], [4, 0, 2], [4, 1, 3], [4, 2, 0], [4, 3, -1]])
    sign = np.where(index >= 0, [[-1.0, 0, 0], [1, 0, 0], [-1, 0, 0], [-1, 0, 0], [1, 0, 0], [-1, 0, 0], [1, 0, 0], [1, 1, -1], [1, 1, -1], [1, 1, -1], [1, 1, 0]], 0.0)
    offset = np.array([0.9, 0, 0.8, 0.6, 0, 1, 0, -1, -1, -1, -1])
    weight = rng.uniform(0.5, 3, len(index))
    member, part_of = np.array([0, 1, 2, 3]), np.array([0, 0, 1, 1])
    z = admm(np.full(5, 0.5), index, sign, offset, weight, part_of, member, steps=20_000, near=1e-10)
    assert (z >= 0).all() and (z <= 1).all() and z[0] + z[1] <= 1 + 1e-4 and z[2] + z[3] <= 1 + 1e-4

    def cost(x):
        return (weight * np.maximum(0, (sign * np.where(index >= 0, x[index], 0)).sum(axis=1) + offset) ** 2).sum()

    best = cost(z)
    for _ in range(4000):
        x = np.clip(z + rng.normal(0, 0.05, 5), 0, 1)
        for r in (slice(0, 2), slice(2, 4)):
            x[r] /= max(1.0, x[r].sum())
        assert cost(x) > best - 1e-3
    assert admm(np.empty(0), np.empty((0, 3), int), np.empty((0, 3)), np.empty(0), np.empty(0), np.empty(0, int), np.empty(0, int)).size == 0


def planted(spark, n=12):
    """One large group: a chain of records of which the first alone shows its person, and a rival for the rest."""
    up = lambda w: [(w, 1.0)]
    pairs = [("r00", "p", up(6.0), 1.0)] + [(f"r{i:02}", x, up(1.4), 1.15) for i in range(1, n) for x in ("p", "q")]
    same = [(f"r{i:02}", f"r{j:02}", up(8.0), 1.0) for i in range(n) for j in range(i + 1, min(n, i + 4))]
    return spark.createDataFrame(pairs, f"r string, person string, ups {RULE}, down double"), spark.createDataFrame(same, f"a string, b string, ups {RULE}, down double")


def test_transitivity_decides_where_evidence_ties(spark):
    variables, ties = ground(*planted(spark))
    whole = {r["var"]: r["value"] for r in confidences(variables, ties).collect()}
    # By evidence alone p and q are equal for every record but the first: 1.4 / 2.55 each.
    assert all(whole[f"r{i:02}\x1fp"] > whole[f"r{i:02}\x1fq"] + 0.03 for i in range(1, 4))
    assert whole["r01\x1fp"] - whole["r01\x1fq"] > whole["r11\x1fp"] - whole["r11\x1fq"]


def test_blocks_of_a_large_group_agree_with_the_whole(spark):
    variables, ties = ground(*planted(spark, 6))
    whole = {r["var"]: r["value"] for r in confidences(variables, ties).collect()}
    parted = {r["var"]: r["value"] for r in confidences(variables, ties, block_rows=40, rounds=24).collect()}
    assert parted.keys() == whole.keys() and max(abs(parted[k] - whole[k]) for k in whole) < 0.02


PERSONS = [("p1", "Ada Quillfors 0001", "", "0042-1111-2222-3333", "Norvale College Tessburg", None, None, None), ("p2", "Ada Quillfors 0002", "", "0042-1111-2222-4444", "Academy of Hollmere", "", "", ""), ("p3", "Benjamin Crowfield", "Ben Crowfield", None, None, None, None, "https://people.hollmere-2.example/~bcrowfield"), ("p4", None, None, None, None, None, None, None)]
P_SCHEMA = "pid string, primary_name string, aliases string, orcid string, affiliations_current string, affiliations_former string, affiliations_phd string, homepage string"
CANDS = [
    (1, "Quillfors, Ada", "Norvale Coll., Tessburg", "", None, "", ""), (2, "Ada Quilfors", "Hollmere Academy", None, "p1", "name", ""), (3, "Ada Quillfors", None, None, "", "", None),
    (4, "B. Crowfield", None, "", None, None, "http://www.people.hollmere-2.example/~bcrowfield7/"), (5, "Nobody Knownhere", "Norvale College Tessburg", "", None, "", ""), (6, None, None, None, None, "", None), (7, "Ada Quillfors", "Somewhere", "0042-1111-2222-4444", "p2", "orcid", ""), (8, "", "", "0042.1111.2222.3333", "", "", ""),
]
C_SCHEMA = "cand_id long, name string, affiliation string, orcid string, dblp_pid string, matched_by string, homepage string"


def test_soft_logic_links(spark):
    got = {r["cand_id"]: (r["pid"], r["confidence"]) for r in link_candidates(spark.createDataFrame(CANDS, C_SCHEMA), spark.createDataFrame(PERSONS, P_SCHEMA)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "p1", 2: "p2", 4: "p3", 8: "p1"}
    assert all(0.5 <= v[1] <= 1 for v in got.values())
    none = spark.createDataFrame([], C_SCHEMA)
    assert link_candidates(none, spark.createDataFrame(PERSONS, P_SCHEMA)).count() == 0
    assert link_candidates(spark.createDataFrame(CANDS, C_SCHEMA), spark.createDataFrame([], P_SCHEMA)).filter("pid is null").count() == 0


def test_variants_link_and_namesakes_stay_apart(spark, rows):
    recs = [
        ("c1", "c", ["Quillfors, Ada"], ["Norvale College Tessburg"], "", ""), ("d1", "d", ["Ada Quillfors 0001"], ["Norvale College Tessburg"], "", ""), ("d2", "d", ["Ada Quillfors 0002"], ["Hollmere Academy"], "", ""),
        ("k1", "k", ["Ada Quilfors"], ["Hollmere Academy"], "", ""), ("k2", "k", ["Ada Quillfors 0002"], ["Hollmere Academy"], "", ""), ("k3", "k", [""], None, "", ""), ("c2", "c", ["Ben Crowfield", None], None, "", ""), ("d3", "d", ["Benjamin Crowfield", "Ben Crowfield"], None, "", ""),
    ]
    df = spark.createDataFrame(recs, "key string, kind string, spellings array<string>, affiliations array<string>, orcid string, homepage string")
    assert rows(linked_variants(df)) == [("c1", "d1"), ("d2", "k1"), ("k1", "k2")]
    assert rows(linked_variants(df.filter("false"))) == []


def test_slips_are_all_pairs_one_letter_apart(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(150)})
    got = {(r["word"], o) for r in slips(spark.createDataFrame([(w,) for w in words], "word string"), 4).collect() for o in r["others"]}
    assert got == {(a, b) for a in words for b in words if a != b and min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= 1 and len(a) + len(b) - 2 * lcs(a, b) <= 2}


def test_name_pairs_are_complete(spark):
    rng = random.Random(5)
    first, last = ["ada", "johannes", "johan", "hans", "li", "xu", "robert", "bob", "r", "j", "rob.", "anna", "anne"], ["quillfors", "quilfors", "kuipers", "kuypers", "wei", "bo", "born", "bom", "crowfield", "crowfeild"]
    names = sorted({" ".join(rng.sample([rng.choice(first), rng.choice(last), *([rng.choice(first)] if rng.random() < 0.4 else [])], k=2)) + rng.choice(["|", "|", "|0001", "|0002"]) for _ in range(400)} | {"crowfield|", "crowfield|0001"})
    got = {(r["x"], r["y"]): (r["name"], r["slip"]) for r in name_pairs(spark.createDataFrame([(n,) for n in names], "n string")).collect()}
    want = {(a, b): name_match(min(a, b), max(a, b)) for a in names for b in names}
    assert got == {k: v for k, v in want.items() if v[0] > 0}


def test_classes_count_links(spark, rows):
    df = spark.createDataFrame([("c1", "c", ["Quillfors, Ada"], ["Norvale"], "", ""), ("c2", "c", ["Quillfors, Ada"], ["Norvale"], "", ""), ("d1", "d", ["Ada Quillfors"], ["Norvale"], "", ""), ("d2", "d", ["Bo Lind"], None, "", "")], "key string, kind string, spellings array<string>, affiliations array<string>, orcid string, homepage string")
    assert rows(variant_classes(df)) == [("c1", "c1", 1), ("c2", "c1", 1), ("d1", "c1", 2), ("d2", "d2", 0)]


def test_a_hot_name_loses_no_link(spark):
    recs = [(f"c{i:03}", "c", ["Ada Quillfors"], [f"Place{i % 40}burgh"], "", "") for i in range(120)] + [(f"k{i:03}", "k", ["A. Quillfors"], [f"Place{i}burgh"], "", "") for i in range(40)]
    df = spark.createDataFrame(recs, "key string, kind string, spellings array<string>, affiliations array<string>, orcid string, homepage string")
    got = {tuple(r) for r in linked_variants(df).collect()}
    assert got >= {(f"c{i:03}", f"k{i % 40:03}") for i in range(120)}


def test_groups_that_have_settled_are_left_out(monkeypatch):
    import rollcall.llm.linkage as linkage

    rng, n = np.random.default_rng(5), 400
    # Single variables, and a chain of ties that takes longer.
    index, sign = np.full((3 * n - 1, 3), -1), np.zeros((3 * n - 1, 3))
    offset, weight = np.zeros(3 * n - 1), rng.uniform(0.5, 2, 3 * n - 1)
    index[:n, 0], sign[:n, 0], offset[:n] = np.arange(n), -1.0, rng.uniform(0.5, 1, n)
    index[n : 2 * n, 0], sign[n : 2 * n, 0] = np.arange(n), 1.0
    chain = np.arange(40)
    index[2 * n : 2 * n + 39, :2], sign[2 * n : 2 * n + 39, :2] = np.stack([chain[:-1], chain[1:]], axis=1), (1.0, -1.0)
    index, sign, offset, weight = index[: 2 * n + 39], sign[: 2 * n + 39], offset[: 2 * n + 39], weight[: 2 * n + 39]
    weight[2 * n :] = 50.0
    part_of, member = np.repeat(np.arange((n - 40) // 2), 2), np.arange(40, n)
    group = np.concatenate([np.zeros(40, int), 1 + part_of])
    sizes, real = [], linkage._iterated
    monkeypatch.setattr(linkage, "_iterated", lambda start, *rest: sizes.append(len(start)) or real(start, *rest))
    start = rng.uniform(0, 1, n)
    got = admm(start, index, sign, offset, weight, part_of, member, near=1e-6, group=group)
    assert sizes[0] == n and sizes[-1] <= 40 and sum(sizes) < len(sizes) * n / 2
    want = admm(start, index, sign, offset, weight, part_of, member, steps=20_000, near=1e-10)
    assert np.abs(got - want).max() < 1e-3
