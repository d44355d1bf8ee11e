from __future__ import annotations

import random

import numpy as np
import pytest

from rollcall.llm.mixing import fit_mix, mix_documents, mix_report
from rollcall.llm.packing import difference, fill_report, pack, pack_documents
from rollcall.llm.tokens import VOCABULARY, token_ids

os_path = pytest.importorskip("os.path")
pytestmark = pytest.mark.skipif(not os_path.exists(VOCABULARY), reason="no vocabulary here")


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 400, 900)
    sums = np.bincount(difference(sizes, 40), weights=sizes, minlength=40)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 4
    assert list(difference([], 3)) == [] and sorted(difference([5, 5], 4)) == [0, 1]
    # five items in two windows: the textbook case of differencing, 16 against 14
    assert sorted(np.bincount(difference([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_pack_fits_and_fills():
    rng = random.Random(4)
    for cap in (10, 512):
        for _ in range(40):
            sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 200))]
            sums = np.bincount(pack(sizes, cap), weights=sizes)
            assert sums.max() <= cap and sums.sum() == sum(sizes)
    sizes = [rng.randint(1, 200) for _ in range(3000)]
    assert sum(sizes) / (len(set(pack(sizes, 512).tolist())) * 512) > 0.97


def docs(spark, n=60):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 9)) for _ in range(rng.choice([3, 40, 400]))), "ab"[i % 2] if i % 5 else "c") for i in range(n)]
    return spark.createDataFrame(rows + [(900, None, "a"), (901, "", "b"), (902, "x " * 9000, "a")], "doc_id long, text string, source string")


def test_every_token_once_and_cut_only_if_longer(spark):
    df = docs(spark)
    packs = spark.createDataFrame([(1, 64), (2, 512), (3, 0), (4, None)], "pack_id int, capacity_tokens int")
    got = pack_documents(df, packs, windows=4).collect()
    n = {r["doc_id"]: len(token_ids(r["text"], VOCABULARY)) for r in df.collect()}
    for p, cap in ((1, 64), (2, 512)):
        mine = [r for r in got if r["pack_id"] == p]
        load = {}
        for r in mine:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        assert max(load.values()) <= cap
        by = {}
        for r in mine:
            by.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        assert set(by) == {d for d, k in n.items() if k}
        for d, pieces in by.items():
            pieces.sort()
            assert sum(k for _, k in pieces) == n[d] and all(s + k == t for (s, k), (t, _) in zip(pieces, pieces[1:], strict=False))
            assert len(pieces) == -(-n[d] // cap)
    assert {r["pack_id"] for r in fill_report(pack_documents(df, packs), packs).collect()} == {1, 2}
    assert pack_documents(df.filter("false"), packs).count() == 0


def test_shares_are_met_within_the_limits(spark):
    df = docs(spark, 400)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mix_documents(df.filter("doc_id < 900"), targets, sample=50, steps=8)
    most = {"a": 1, "b": 2, "c": 3}
    assert all(1 <= r["repeats"] <= most[r["source"]] and 0 <= r["own_posterior"] <= 1 for r in mixed.collect())
    report = {r["source"]: r for r in mix_report(mixed, targets).collect()}
    for s in "abc":
        assert abs(report[s]["actual_share"] - report[s]["target_share"]) < 0.01
    assert report["none"]["tokens"] == 0
    assert mix_documents(df.filter("false"), targets).count() == 0
    assert mix_documents(df, targets.filter("false")).count() == 0


def test_the_window_count_rises_until_none_is_overfull():
    sizes = np.clip(np.random.default_rng(1).lognormal(5, 1, 4000).astype(int), 1, 1024)
    sums = np.bincount(pack(sizes, 1024), weights=sizes)
    assert sums.max() <= 1024 and len(sums) <= 1.02 * -(-sizes.sum() // 1024) and len(set(pack([600] * 50, 1024))) == 50


def test_the_fitted_rates_decide(spark):
    rng = random.Random(2)
    words = {"a": ["alpha", "beta"], "b": ["gamma", "delta"]}
    # A fifth of each source is written like the other one.
    rows = [(i, " ".join(rng.choice(words["ab"[(i + (i % 10 < 2)) % 2]]) for _ in range(40)), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 2)], "source string, target_share double, max_repeats int")
    fitted, flat = (mix_report(fit_mix(df, targets, sample=100, steps=s), targets).collect() for s in (24, 0))
    off = lambda rows, c: max(abs(r[c] - r["target_share"]) for r in rows)
    assert off(flat, "fitted_share") > 0.05 and all(off(fitted, c) < off(flat, c) / 3 for c in ("fitted_share", "expected_share")) and off(fitted, "actual_share") < 0.02
