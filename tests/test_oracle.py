"""Every registered query against its SQL, on the smallest scale."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from oracle import REGISTRY, compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    """All comparisons, several at a time: at this scale most of a query is planning."""

    def run(name):
        return compare(spark, connect(FOLDER), name, FOLDER)

    pool = ThreadPoolExecutor(6)
    yield {name: pool.submit(run, name) for name in REGISTRY}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_agrees_with_sql(results, name):
    problem = results[name].result()
    assert problem is None, problem


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
