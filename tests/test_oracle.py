"""Every registered query against its DuckDB oracle (sf0.001, fast)."""

from conftest import SF_SMALL

from oracle_compare import compare_all


def test_all_queries_match_oracle(spark):
    from shopstream.plans import catalog
    results = compare_all(spark, SF_SMALL, sorted(catalog.queries()))
    bad = [r for r in results if r["status"] not in ("match", "no-oracle")]
    assert not bad, bad


def test_every_query_has_an_oracle():
    from shopstream.plans import catalog, oracle
    missing = set(catalog.queries()) - set(oracle.oracle_sql())
    assert not missing, missing


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert rows[0]["event_counts"]["total"] == 1000
