from __future__ import annotations

import os

import pytest

from rollcall.llm import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {"p1_found": ["cand_id", "pid"], "p4_found": ["field_name", "row_key", "canon_id"], "p5_found": ["key_a", "key_b"], "p8_found": ["doc_id", "start_char", "end_char"]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.count() > 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and df.distinct().count() == df.count()
