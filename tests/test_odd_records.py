"""One odd record is one odd row: it is flagged and stops nothing."""

import gzip
import json

import pytest

from crawlwright.operators import extract as X
from crawlwright.sources import sitemaps as SM

GOOD = {"@type": ["Product"], "name": "Lamp", "offers": {"price": 5}}
LISTS = {n: f'{{"@type": "ItemList", "numberOfItems": {n}}}' for n in ("1e400", "Infinity", "NaN", "100000000000000000000", "3000000000", "-4", "true", '"7"', "12")}


def facts(spark, *blocks):
    html = "<html><body>" + "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks) + "</body></html>"
    pages = spark.createDataFrame([(0, "https://s.example.com/a", html), (1, "https://s.example.com/b", f'<script type="application/ld+json">{json.dumps(GOOD)}</script>')],
                                  "page_id long, url string, html string").selectExpr("'s' AS site", "*")
    rows = {r["page_id"]: r for r in X.read_pages_html(pages).select("page_id", "item_count", "declared_name", "ld_error", "offers").collect()}
    assert (rows[1]["declared_name"], rows[1]["ld_error"], rows[1]["offers"]) == ("Lamp", False, True)
    return rows[0]


@pytest.mark.parametrize("block, items, error", [
    *[(LISTS[n], None, False) for n in ("1e400", "Infinity", "NaN", "100000000000000000000", "3000000000", "-4", '"7"')], (LISTS["12"], 12, False),
    ('{"@type": "BreadcrumbList", "itemListElement": 5}', None, False), ('{"@type": "BreadcrumbList", "itemListElement": [5, {"item": 3}, null]}', None, False),
    ("[" * 1500 + "]" * 1500, None, None), ("[" * 200_000, None, True), ('{"@type": "Product", "name": "\\ud800 half", "image": ["\\udfff", 4, {}]}', None, False),
    ('{"@graph": 7, "@type": {"a": 1}}', None, False), ("{not json", None, True), ("9" * 5000, None, True)])
def test_odd_json(spark, block, items, error):
    row = facts(spark, block)
    assert row["item_count"] == items and (error is None or row["ld_error"] == error)


def test_objects_in_order():
    value = {"a": {"n": 1}, "b": [{"n": 2, "c": {"n": 3}}, {"n": 4}]}
    assert [o.get("n") for o in X._objects(value)] == [None, 4, 2, 3, 1]


def land(folder, files):
    (folder / "s").mkdir()
    for name, raw in files.items():
        (folder / "s" / name).write_bytes(raw)


def test_bad_archives_keep_what_they_hold(spark, tmp_path):
    urls = "".join(f"<url><loc>https://s/{i}</loc></url>" for i in range(5000)).encode()
    whole = gzip.compress(urls)
    middle = bytearray(whole)
    middle[len(whole) // 2] ^= 0xFF
    land(tmp_path, {"good.xml.gz": whole, "two.xml.gz": gzip.compress(urls[:500]) + gzip.compress(urls[500:]), "short.xml.gz": whole[: len(whole) // 2],
                    "bad.xml.gz": b"\x1f\x8b garbage", "middle.xml.gz": bytes(middle), "empty.xml": b"", "plain.xml": urls})
    files = SM.read_sitemap_files(spark, str(tmp_path)).cache()
    errors = {r["file_url"]: r["error"] for r in files.where("error is not null").collect()}
    assert errors == {"s/short.xml.gz": "truncated_gzip", "s/bad.xml.gz": "corrupt_gzip", "s/middle.xml.gz": "corrupt_gzip"}
    n = {r["file_url"]: r["count"] for r in SM.sitemap_locs(files).groupBy("file_url").count().collect()}
    assert n["s/good.xml.gz"] == n["s/two.xml.gz"] == n["s/plain.xml"] == 5000 and 0 < n["s/short.xml.gz"] < 5000
    read = files.selectExpr("*", "200 AS status", "false AS challenge")
    assert {(r["reason"], r["files"]) for r in SM.sitemap_fail_reasons(read).collect()} == {("truncated_gzip", 1), ("corrupt_gzip", 2)}


def test_large_archives_come_in_parts():
    """Some 40 MB of text in an archive of a few hundred KB: parts stay small and no address is cut."""
    urls = "".join(f"<url><loc>https://s/é{i:07d}</loc><lastmod>2024-01-01</lastmod></url>\n" for i in range(600_000))
    parts = list(SM.sitemap_parts(gzip.compress(urls.encode(), 1)))
    assert all(e is None for _, e in parts) and "".join(p for p, _ in parts) == urls
    assert len(parts) > 5 and max(len(p) for p, _ in parts) < SM.PART_CHARS + (2 << 20)
    assert all(p.count("<loc>") == p.count("</loc>") for p, _ in parts)
