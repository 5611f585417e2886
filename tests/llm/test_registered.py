"""Queries of the training-text operators on the smallest driver tables: SQL where there is one, else rows and stable schemas."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect, same  # noqa: E402

from millrace.llm import queries  # noqa: E402

FOLDER = os.environ.get("MILLRACE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
COLUMNS = {
    "p1_found": [("rollout_id", "bigint"), ("defect", "string")], "p2_found": [("manifest_id", "int"), ("family", "string"), ("band", "string")],
    "p3_found": [("record_a", "bigint"), ("record_b", "bigint")], "p5_found": [("record_a", "bigint"), ("record_b", "bigint")],
    "p6_found": [
        ("container_kind", "string"),
        ("doc_id", "bigint"),
    ], "p7_found": [("doc_id", "bigint"), ("item_id", "string")], "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    same(spark, connect(FOLDER), queries.queries()[name], queries.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_schema_and_rows(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
