from __future__ import annotations

import random

from rollcall.operators.bad_rows import check_records, loaded_values, split_rows
from rollcall.plans.problems import p3_loaded

HEAD = "name,confidence,evidence_url"
FILES = [("a.csv", ",", HEAD), ("t.csv", "\t", "name\tconfidence\tevidence_url")]


def run(spark, records, source="a.csv"):
    raw = spark.createDataFrame([(i, source, r) for i, r in enumerate(records)], "raw_id long, source_file string, raw_record string")
    files = spark.createDataFrame(FILES, "source_file string, delimiter string, header_text string")
    good, bad = split_rows(check_records(raw, files))
    return {r["raw_id"]: r["row"] for r in good.collect()}, sorted((r["raw_id"], r["reason"]) for r in bad.collect())


def test_each_reason_and_values_kept(spark):
    good, bad = run(spark, [
        'A,high,https://x.example/a', '"B, b"," LOW ","HTTP://x.example/""q"""', 'C,,', '"line\nbreak",Medium,',
        'D,high', 'E,high,https://x.example/a,z', '"F,high,', 'G "g",high,', '"H"x,high,', 'I,hgih,', 'J,high,x.example', 'K,sure,ftp://x.example', 'L,high,https:///x.example', 'M,high,https://x example/a', 'N,high,http://host/a.b', '', None,
    ])
    assert good[0]["evidence_url"] == "https://x.example/a" and good[1]["name"] == "B, b" and good[1]["evidence_url"] == 'HTTP://x.example/"q"' and good[3]["name"] == "line\nbreak"
    assert sorted(good) == [0, 1, 2, 3]
    assert bad == [
        (4, "column_count"), (5, "column_count"), (6, "quoting"), (7, "quoting"), (8, "quoting"), (9, "bad_confidence"), (10, "bad_evidence_url"),
        (11, "bad_confidence"), (11, "bad_evidence_url"), (12, "bad_evidence_url"), (13, "bad_evidence_url"), (14, "bad_evidence_url"), (15, "column_count"), (16, "column_count"),
    ]


def parse(s, d):
    out, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            i, buf = i + 1, ""
            while True:
                if i >= len(s):
                    return None
                if s[i] == '"':
                    if s[i + 1 : i + 2] == '"':
                        buf, i = buf + '"', i + 2
                        continue
                    break
                buf, i = buf + s[i], i + 1
            i += 1
            if i < len(s) and s[i] != d:
                return None
            out.append(buf)
        else:
            j = s.find(d, i)
            j = len(s) if j < 0 else j
            if '"' in s[i:j]:
                return None
            out.append(s[i:j])
            i = j
        if i >= len(s):
            return out
        i += 1


def test_shapes_match_a_sign_by_sign_parser(spark):
    rng = random.Random(1)
    records = ["".join(rng.choice('ab,"\n \x01\x02') for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    good, bad = run(spark, records)
    reasons = dict(bad)
    for i, r in enumerate(records):
        f = parse(r, ",")
        if f is None:
            assert reasons[i] == "quoting", r
        elif len(f) != 3:
            assert reasons[i] == "column_count", r
        elif i in good:
            assert good[i] == dict(zip(HEAD.split(","), f, strict=True))


def test_unknown_source_long_text_and_empty_table(spark):
    assert run(spark, ["A,high,"], "nowhere.csv")[1] == [(0, "unknown_source")]
    long = '"' + 'x""y,' * 40_000 + '"\thigh\t'
    good, _ = run(spark, [long], "t.csv")
    assert len(good[0]["name"]) == 160_000
    assert run(spark, []) == ({}, [])


def test_loaded_values_have_every_column_and_the_rules_trim(spark, rows):
    df = spark.createDataFrame([(1, {"name": " Ada ", "confidence": "\t\u00a0High\t", "evidence_url": ""}, "x"), (2, {"name": ""}, "y"), (3, None, None)], "id long, row map<string,string>, name string")
    assert rows(loaded_values(df, ["confidence", "name", "notes"])) == [(1, "High", " Ada ", None), (2, None, "", None), (3, None, None, None)]


def test_columns_of_every_file_are_loaded(spark, rows, tmp_path):
    files = [(f"{i}.csv", ",", "name,confidence,evidence_url") for i in range(1_500)] + [("last.csv", ";", "name;confidence;evidence_url;seen")]
    spark.createDataFrame(files, "source_file string, delimiter string, header_text string").coalesce(1).write.parquet(f"{tmp_path}/rulings_files.parquet")
    spark.createDataFrame([(1, "last.csv", "A;High;;2024"), (2, "7.csv", "B,low,")], "raw_id long, source_file string, raw_record string").write.parquet(f"{tmp_path}/rulings_raw.parquet")
    df = p3_loaded(spark, str(tmp_path))
    assert df.columns == ["raw_id", "confidence", "evidence_url", "name", "seen"]
    assert rows(df) == [(1, "high", "", "A", "2024"), (2, "low", "", "B", None)]
