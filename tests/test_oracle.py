"""Every registered query with an oracle matches DuckDB on the driver tables."""

import pytest

from conftest import SF_SMALL
import __spark_entry__ as E  # noqa: E402
from oracle_check import compare

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF_SMALL, NAMES, verbose=False)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(results, name):
    r = results[name]
    assert r["cols_match"], r
    assert r["rows"] == r["oracle_rows"], r
    assert r["match"], r


def test_every_query_has_a_callable():
    q = E.queries()
    assert set(E.oracle_sql()) <= set(q)
    assert all(callable(v) for v in q.values())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "severity" in df.columns
