import duckdb

import __spark_entry__ as entry

TABLES = ("part", "orders", "lineitem", "events", "documents", "pages", "conversations", "customer", "region")
SAMPLE = ("flagship_site_titles", "b2_preferred_url", "g5_duplicate_content", "h3_coverage_report", "a6_sitemap_fail_reasons", "s3_stream_health")


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["site", "pages", "bad_titles", "shared_titles", "title_is_h1", "title_score"] and df.count() > 0


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 120


def test_sample_against_duckdb(spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    q, o = entry.queries(), entry.oracle_sql()
    for name in SAMPLE:
        df = q[name](spark, sf)
        cur = con.execute(o[name])
        names = [c[0] for c in cur.description]
        key = lambda row: tuple(str(x) for x in row)
        want = sorted((tuple(r) for r in cur.fetchall()), key=key)
        got = sorted((tuple(r) for r in df.select(*names).collect()), key=key)
        assert len(got) == len(want) and got == want, name
