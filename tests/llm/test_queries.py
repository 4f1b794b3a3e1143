"""Every query of the training-data operators, and those with SQL against it."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from spectrafold.llm import queries
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    df = contract.queries()[name](spark, SMALL)
    assert compare(df, connect(SMALL), contract.oracle_sql()[name]) == ""


def test_numbered():
    numbers = {n.split("_")[0] for n in contract.queries() if n.startswith("op")}
    assert numbers == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in contract.queries()


@pytest.mark.parametrize("name", ["op6_licenses", "op8_token_counts", "op5_mixing"])
def test_one_row_per_document(spark, name):
    from spectrafold.llm.frames import table

    got = contract.queries()[name](spark, SMALL)
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(
        r[0] for r in table(spark, SMALL, "documents").select("doc_id").collect()
    )
