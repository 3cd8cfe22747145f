"""Every query that has SQL gives the SQL's rows; the others give rows."""

import pytest
from oracle import duck, same

from cohortlens.plans import catalog, catalog_batches, catalog_cohort, catalog_images, catalog_inference, catalog_sources, catalog_streams  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry_module_lists_queries(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
