"""Every registered query against its SQL on the smallest data folder."""

import pathlib

import pytest
from check_oracles import compare, connect

import __spark_entry__ as contract
from depotflow.plans.catalog import COVERS, ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

# Operators that only exist inside others, and what carries them.
INVENTORY = """
S1 S2 S3 S4 S5 S6 S7 S8 P1 P2 P3 P4 P5 P6 P7 P8 P9 P10 P11 P12 P13 P14
J1 J2 J3 J4 J5 J6 J7 J8 J9 A1 A2 A3 A4 A5 A6 A7 A8 A9 A10 A11 A12 A13
W1 W2 W3 W4 W5 W6 K1 K2 K3 K4 K5 K6 K7 K8 F1 F2 R1 R2 R3 R4 D1 D2 D3""".split()

needs_data = pytest.mark.skipif(
    not pathlib.Path(SF_DIR).exists(), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@needs_data
@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, con, name):
    problem = compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name])
    assert problem is None, problem


@needs_data
def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_operator_is_registered():
    covered = {operator for operators in COVERS.values() for operator in operators}
    assert not set(INVENTORY) - covered
