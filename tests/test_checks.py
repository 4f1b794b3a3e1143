"""Every registered query against its SQL.

The smallest tables serve most of them. Models with up to 16 coefficients need more samples
than those hold.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from catalog.registry import ENTRIES
from tests.oracle import compare, connect

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
NEED_SAMPLES = ("C8_", "F7_", "F8_", "F9_", "F11_")


@pytest.fixture(scope="module")
def connections():
    return {folder: connect(folder) for folder in (SMALL, LARGER)}


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_equals_sql(spark, connections, name):
    folder = LARGER if name.startswith(NEED_SAMPLES) else SMALL
    df = contract.queries()[name](spark, folder)
    assert compare(df, connections[folder], contract.oracle_sql()[name]) == ""


def test_every_query_has_a_check():
    assert set(ENTRIES) <= set(contract.queries())
    assert set(ENTRIES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name, keys", [
    ("A10_replicate_spread", ["c_Hg", "sample", "pH"]),
    ("C14_dose_response", ["c_Hg", "sample", "pH"]),
    ("W6_reference_ratio", ["c_Hg", "sample", "pH"]),
    ("X12_quenching_transform", ["c_Hg", "sample", "pH"]),
    ("F15_dose_points", ["c_Hg", "sample", "pH"]),
    ("F16_quenching_points", ["c_Hg", "sample", "pH"]),
])
def test_keys_tell_rows_apart(spark, name, keys):
    rows = contract.queries()[name](spark, LARGER).select(keys).collect()
    assert len(set(rows)) == len(rows) > 0
