"""Every registered query against its SQL on the smallest sample."""

import functools
import importlib.util
from pathlib import Path

import pytest

import __spark_entry__ as entry
from logtide.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("compare", Path(__file__).parents[1] / "tools" / "compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="sample tables not present")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def one_run_of_each_chain():
    """Queries that read different tables of one streamed chain share its run."""
    with pytest.MonkeyPatch.context() as patch:
        for name in ("_ingest", "_reorganised", "_late_fork", "_late_headers", "_deliver"):
            run = getattr(catalog, name)
            kept = functools.lru_cache(maxsize=1)(run)
            patch.setattr(catalog, name, lambda spark, sf, kept=kept, run=run, **options: run(spark, sf, **options) if options else kept(spark, sf))
        yield


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    assert compare.compare(spark, con, name, SF_DIR).startswith("ok")
