"""Registered queries against their SQL on the smallest tables. The costly ones have a test of
their own in the pipeline or are left to ``check_queries.py``."""

import inspect
from pathlib import Path

import pytest

import __spark_entry__ as entry
from alertweave.plans.queries import QUERIES
from check_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
SLOW = {"sarif_paths", "context_slices", "context_completeness", "evidence_graph"}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [name for name in entry.queries() if name not in SLOW])
def test_query(spark, connection, name):
    assert compare(spark, connection, FOLDER, name).startswith(("ok", "rows only"))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_takes_a_session_and_a_folder(name):
    assert [p.kind for p in inspect.signature(QUERIES[name]).parameters.values()] == [inspect.Parameter.POSITIONAL_OR_KEYWORD] * 2
