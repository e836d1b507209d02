"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
import check
from folioweave.plans import catalog

QUERIES = catalog.all_queries()
SQL = catalog.all_sql()
NO_SQL = {
    "r14_approximate_top_k", "r14_recall_at_10", "r34_embed_texts", "s01_file_manifest", "r35_clause_similarity_approximate",
    "b12_similar_users_approximate", "b10_item_based_cf_approximate",
}


@pytest.fixture
def con(sf_dir, tmp_path):
    """A connection of its own for each query: an error in one leaves the others alone."""
    connection = check.connect(sf_dir)
    connection.execute(f"SET memory_limit = '3GB'; SET threads = 4; SET temp_directory = '{tmp_path}'")
    yield connection
    connection.close()


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    good, note = check.compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir)
    assert good, note


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
