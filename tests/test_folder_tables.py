"""Tables that are folders of files, for the queries that read them as a stream."""

import pytest

from folioweave.plans import catalog


@pytest.mark.parametrize(
    "table, query", [("documents", "x08_incremental_corpus"), ("conversations", "x10_domain_continuity"), ("events", "x07_popularity")]
)
def test_stream_reads_every_part(spark, sf_dir, tmp_path, table, query):
    whole = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    run = catalog.all_queries()[query]
    got = run(spark, str(tmp_path)).collect()
    assert got and sorted(map(repr, got)) == sorted(map(repr, run(spark, sf_dir).collect()))
