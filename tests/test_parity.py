"""Every operator against its DuckDB statement: real tables, edge cases, empty and skewed tables."""

from __future__ import annotations

import pytest
from compare import differences
from edge_tables import random_tables
from star import STAR, both_engines

from spanledger.oracle import STATEMENTS, statement
from spanledger.registry import OPERATORS, decimals_as_double, query

NAMES = list(OPERATORS)


def test_every_operator_has_a_statement():
    assert set(OPERATORS) == set(STATEMENTS)


@pytest.mark.parametrize("name", NAMES)
def test_order_tables(spark, star_db, name):
    assert differences(query(name)(spark, STAR), star_db, statement(name)) is None


@pytest.mark.parametrize("name", NAMES)
def test_edge_cases(edge, name):
    inputs, connection = edge
    result = decimals_as_double(OPERATORS[name](inputs))
    assert differences(result, connection, statement(name, from_orders=False)) is None


# On empty tables the statements of these give no row where the operator gives NULLs.
ROWS_WITHOUT_INPUT = {"business_summary": 12, "overview_headline": 1}


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(empty, name):
    inputs, connection = empty
    result = decimals_as_double(OPERATORS[name](inputs))
    if name in ROWS_WITHOUT_INPUT:
        assert result.count() == ROWS_WITHOUT_INPUT[name]
    else:
        assert differences(result, connection, statement(name, from_orders=False)) is None


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    return both_engines(random_tables(spark, seed=1), tmp_path_factory.mktemp("skewed"))


@pytest.mark.parametrize("name", NAMES)
def test_skewed_tables(skewed, name):
    inputs, connection = skewed
    result = decimals_as_double(OPERATORS[name](inputs))
    assert differences(result, connection, statement(name, from_orders=False)) is None
