"""Queries: streaming runs over the landed tables."""

from pyspark.sql import functions as F

from crawlwright.operators.dedupe import resume_store_latest
from crawlwright.plans import views as V
from crawlwright.plans.registry import query
from crawlwright.sources.tables import read_table
from crawlwright.streaming import jobs as S
from crawlwright.streaming import scans as SC

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
MARKUP = "site string, page_id bigint, url string, html string"
PAGES = "page_id bigint, url string, html string"
CODE = """CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'deleted_home' WHEN event_type <> 'error' THEN 'ok'
    WHEN event_id % 5 = 0 THEN 'http_404' WHEN event_id % 5 = 1 THEN 'http_410' WHEN event_id % 5 = 2 THEN 'http_429'
    WHEN event_id % 5 = 3 THEN 'http_503' ELSE 'conn_failed' END"""
_EV = f"SELECT concat('s', user_id % 5) AS site, concat('page-', event_id % 700) AS key, event_id AS seq, ts, {CODE} AS fetch_code FROM events"


def log_stream(spark, d):
    raw = S.landing_stream(spark, d, EVENTS, "events.parquet")
    return raw.selectExpr("concat('s', user_id % 5) AS site", "concat('page-', event_id % 700) AS key", "event_id AS seq",
                          "CAST(ts AS timestamp) AS ts", f"{CODE} AS fetch_code")


@query("s1_stream_resume_store", f"""SELECT site, key, seq, fetch_code FROM (SELECT *, row_number() OVER (PARTITION BY site, key ORDER BY seq DESC) AS rn
    FROM ({_EV}) WHERE fetch_code IN ('ok', 'http_404', 'http_410') AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) WHERE rn = 1""")
def _(spark, d):
    folder = S.job_folder(spark, "s1")
    log = log_stream(spark, d)
    S.start_resume_store(log, folder).awaitTermination()
    store = S.resume_store(log, folder).read(spark)
    now = read_table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return resume_store_latest(store, now).select("site", "key", "seq", "fetch_code")


@query("s1_stream_first_results")
def _(spark, d):
    folder = S.job_folder(spark, "s1f")
    out = S.first_results(log_stream(spark, d)).select("site", "key", "seq", "fetch_code")
    return S.read_after(S.append_table(out, folder), spark, folder)


@query("s2_stream_reject_alert", f"""SELECT site, window_start, rejects, home_redirects, first_sign FROM (SELECT site, date_trunc('day', ts) AS window_start,
      count(*) FILTER (fetch_code = 'http_429') AS rejects, count(*) FILTER (fetch_code = 'deleted_home') AS home_redirects,
      min(ts) FILTER (fetch_code IN ('http_429', 'deleted_home')) AS first_sign FROM ({_EV}) GROUP BY 1, 2)
    WHERE rejects >= 3 OR home_redirects >= 5""")
def _(spark, d):
    folder = S.job_folder(spark, "s2")
    out = S.reject_alerts(S.late_tolerant(log_stream(spark, d)))
    S.start_versions(out, folder).awaitTermination()
    df = S.newest_versions(spark, folder, ["site", "window_start"])
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "first_sign")})


@query("s2_stream_scan_alerts", f"""SELECT site, min(ts) AS scan_start, count(*) FILTER (fetch_code = 'http_429') AS rejects,
      count(*) FILTER (fetch_code = 'deleted_home') AS home_redirects, min(ts) FILTER (fetch_code IN ('http_429', 'deleted_home')) AS first_sign
    FROM (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY site ORDER BY ts, seq) AS scan FROM (
      SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY site ORDER BY ts, seq) > INTERVAL 2 HOUR, true) AS opens FROM ({_EV})))
    GROUP BY site, scan HAVING count(*) FILTER (fetch_code = 'http_429') >= 3 OR count(*) FILTER (fetch_code = 'deleted_home') >= 5""")
def _(spark, d):
    folder, key = S.job_folder(spark, "s2s"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, SC.STORE)
    try:
        df = S.read_after(S.append_table(SC.scan_alerts(log_stream(spark, d), 7200), folder), spark, folder)
    finally:
        spark.conf.set(key, before)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("scan_start", "first_sign")})


_H = """count(*) AS fetches, count(*) FILTER (fetch_code = 'ok') AS ok, count(*) FILTER (fetch_code IN ('http_404', 'http_410')) AS gone,
    count(*) FILTER (fetch_code = 'http_429') AS rate_limited, count(*) FILTER (fetch_code = 'http_503') AS server_error,
    count(*) FILTER (fetch_code = 'conn_failed') AS connection"""


@query("s3_stream_health", f"""SELECT window_start, site, {_H} FROM (SELECT *, date_trunc('hour', ts) AS window_start FROM ({_EV})) GROUP BY 1, 2""")
def _(spark, d):
    return health_stream(spark, d, "s3")


def health_stream(spark, d, name, *window):
    folder = S.job_folder(spark, name)
    S.start_versions(S.health_counts(S.late_tolerant(log_stream(spark, d)), *window), folder).awaitTermination()
    df = S.newest_versions(spark, folder, ["site", "window_start"])
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).drop("window_end")


@query("s3_health_sliding", f"""SELECT window_start, site, {_H} FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_start
    FROM ({_EV})) GROUP BY 1, 2""")
def _(spark, d):
    return health_stream(spark, d, "s3s", "2 hours", "1 hour")


@query("s4_stream_page_audit", "SELECT page_id, url_key, title, title_len, title_status FROM page_facts")
def _(spark, d):
    folder = S.job_folder(spark, "s4")
    out = S.audit_stream(S.landing_stream(spark, d, PAGES, "pages.parquet"))
    return S.read_after(S.append_table(out, folder), spark, folder).select("page_id", "url_key", "title", "title_len", "title_status")


@query("s4_stream_page_tables", """SELECT p_partkey AS page_id, p_name || ' store' AS title, p_name || ' & ' || lower(p_type) AS meta_desc,
    p_partkey::VARCHAR AS sku, p_partkey % 9 <> 0 AS indexable, 3::BIGINT AS n_images, 1::BIGINT AS n_missing_alts, 4::BIGINT AS n_links,
    'https://cdn.example.com/i/' || p_partkey || '.jpg' AS first_image FROM part""")
def _(spark, d):
    folder = S.job_folder(spark, "s4p")
    V.fx_html(spark, d).withColumn("site", F.concat("site", F.lit(".example.com"))).write.parquet(f"{folder}/in")
    S.start_page_audit(S.landing_stream(spark, f"{folder}/in", MARKUP), folder).awaitTermination()
    images = S.audited(spark, folder, "images").groupBy(F.col("seq").alias("page_id")).agg(
        F.count("*").alias("n_images"), F.count_if(F.col("alt_status") == "alt_missing").alias("n_missing_alts"), F.min_by("image_url", "image_pos").alias("first_image"))
    links = S.audited(spark, folder, "links").groupBy("page_id").agg(F.count("*").alias("n_links"))
    pages = S.audited(spark, folder, "pages").select("page_id", "title", "meta_desc", "sku", "indexable")
    return pages.join(images, "page_id", "left").join(links, "page_id", "left")


@query("s5_stream_link_counts", "SELECT site, dst_key, count(*) AS n_pages FROM page_links GROUP BY 1, 2")
def _(spark, d):
    folder = S.job_folder(spark, "s5")
    counts = S.link_counts(S.landing_stream(spark, d, PAGES, "pages.parquet"))
    store = S.link_count_store(counts, folder)
    store.start(counts, "update").awaitTermination()
    return store.read(spark)
