"""Sitemap files, index traversal, collected URLs, read reports and robots lines."""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.rank import first_per
from crawlwright.functions.text import strip, text
from crawlwright.functions.urls import clean_url, host, is_product_subpage, is_tag_url
from crawlwright.operators.urlsets import preferred_url
from crawlwright.session import cut

LOC = r"(?is)<loc>\s*(.*?)\s*</loc>"
FILE_SCHEMA = "site string, file_url string, pos bigint, text string, error string"
PART_CHARS = 4 << 20


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[tuple[bytes, str | None]]:
    """The bytes of a file, a step at a time, gzip (told by its magic number, several members too) unpacked; last why it broke off, if it did."""
    if data[:2] != b"\x1f\x8b":
        yield from ((data[at:at + step], None) for at in range(0, len(data), step))
        return
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            while not member.eof:
                out = member.decompress(data, step)
                data = member.unconsumed_tail
                if out:
                    yield out, None
                elif not data and not member.eof:
                    yield b"", "truncated_gzip"
                    return
        except zlib.error:
            yield b"", "corrupt_gzip"
            return
        data = member.unused_data


def sitemap_parts(data: bytes, most: int = PART_CHARS) -> Iterator[tuple[str, str | None]]:
    """(text, error) of parts of about ``most`` characters, cut behind a record, so that no address is split."""
    decode, held = codecs.getincrementaldecoder("utf-8")("ignore").decode, ""
    for raw, error in inflated(data):
        held += decode(raw)
        if error:
            yield held, error
            return
        if len(held) >= most:
            ends = [m.end() for m in re.finditer(r"(?i)</loc\s*>", held)] or [m.start() for m in re.finditer("<", held)][-1:] or [len(held)]
            yield held[:ends[-1]], None
            held = held[ends[-1]:]
    yield held, None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for site, file_url, raw in zip(pdf["site"], pdf["file_url"], pdf["content"]):
            for pos, (part, error) in enumerate(sitemap_parts(bytes(raw))):
                yield pd.DataFrame({"site": [site], "file_url": [file_url], "pos": [pos], "text": [part], "error": [error]}).astype({"error": object})


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """A3: landed sitemap files ``<site>/<name>`` (plain or gzip) as ``(site, file_url, pos, text, error)``.

    A large file comes in several parts, unpacked piece by piece.  A gzip file that breaks off or is corrupt keeps what could be
    read; its last part says why (``truncated_gzip``, ``corrupt_gzip``).  Files without a byte give no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("site"),
                         F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file_url"), "content")
    return files.mapInPandas(_read, FILE_SCHEMA)


def is_sitemap_text(c):
    return F.lower(text(c)).rlike("<loc|<sitemapindex|<urlset")


def sitemap_locs(files: DataFrame) -> DataFrame:
    """A3: ``(site, file_url, pos, loc)`` of every file part that is a sitemap."""
    raw = (files.where(is_sitemap_text(F.col("text")))
           .select("site", "file_url", "pos", F.explode(F.regexp_extract_all("text", F.lit(LOC), F.lit(1))).alias("loc")))
    loc = strip(F.regexp_replace(strip(F.col("loc")), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"))
    return raw.withColumn("loc", F.replace(loc, F.lit("&amp;"), F.lit("&"))).where("loc <> ''")


def is_sitemap_loc(c):
    low = F.regexp_replace(F.lower(c), r"(?s)\?.*$", "")
    return low.rlike(r"\.xml(\.gz)?$|/sitemap[^/]*$")


def expand_sitemap_index(files: DataFrame, roots: DataFrame) -> DataFrame:
    """A4: files reachable from the roots, at any depth, each visited once."""
    edges = cut(sitemap_locs(files).where(is_sitemap_loc(F.col("loc"))).select("site", "file_url", "loc").distinct())
    seen = front = cut(roots.select("site", "file_url").distinct().withColumn("depth", F.lit(0).cast("bigint")))
    for depth in count(1):
        step = (front.select("site", "file_url").join(edges, ["site", "file_url"])
                .select("site", F.col("loc").alias("file_url")).distinct()
                .join(seen.select("site", "file_url"), ["site", "file_url"], "left_anti")
                .withColumn("depth", F.lit(depth).cast("bigint")))
        front = cut(step)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def collect_sitemap_urls(locs: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """A5: page URLs of the sitemap, own host only, one per page key by the preference of B2.

    ``locs``: site, seq, loc.
    """
    site_host = host(F.concat(F.lit("https://"), F.col("site")))
    urls = locs.where(~is_sitemap_loc(F.col("loc"))).select("site", "seq", clean_url(F.col("loc")).alias("url"))
    urls = urls.where((F.col("url") != "") & (host(F.col("url")) == site_host) & ~is_tag_url(F.col("url"))
                      & ~is_product_subpage(F.col("url")))
    return preferred_url(urls.select("url", "seq")).select("site", "url_key", "url")


def fail_reason():
    s = F.col("status")
    return (F.when(s.isNull(), "no_reply").when(F.coalesce("challenge", F.lit(False)), "blocked")
            .when(s == 429, "rate_limited").when(s == 403, "forbidden").when(s.isin(404, 410), "not_found")
            .when(s >= 500, "server_error").when(s != 200, "unexpected").otherwise("not_a_sitemap"))


def _judged(fetches: DataFrame) -> DataFrame:
    ok = (F.col("status") == 200) & ~F.coalesce("challenge", F.lit(False)) & is_sitemap_text(F.col("text"))
    error = F.col("error") if "error" in fetches.columns else F.lit(None).cast("string")
    ok = F.coalesce(ok, F.lit(False)) & error.isNull()
    return fetches.withColumns({"ok": ok, "reason": F.when(~ok, F.coalesce(error, fail_reason()))})


def sitemap_read_report(fetches: DataFrame, urls: DataFrame) -> DataFrame:
    """Per site, files read and failed, partial flag and number of collected URLs."""
    files = _judged(fetches).groupBy("site").agg(F.count_if("ok").alias("files_ok"), F.count_if(~F.col("ok")).alias("files_failed"))
    totals = urls.groupBy("site").agg(F.count("*").alias("total_urls"))
    return files.join(totals, "site", "left").select(
        "site", "files_ok", "files_failed", (F.col("files_failed") > 0).alias("partial"),
        F.coalesce("total_urls", F.lit(0)).cast("bigint").alias("total_urls"))


def sitemap_fail_reasons(fetches: DataFrame) -> DataFrame:
    """Failures per site and reason; a file whose reading broke off (``error``) fails for that."""
    return _judged(fetches).where("NOT ok").groupBy("site", "reason").agg(F.count("*").alias("files"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Declared sitemaps per site, distinct, in order of appearance."""
    lines = robots.select("site", "seq", F.posexplode(F.split("robots_text", r"\r\n|\r|\n")).alias("line_no", "line"))
    lines = lines.where(F.lower(F.ltrim("line")).startswith("sitemap:"))
    lines = lines.withColumn("sitemap", F.trim(F.regexp_replace("line", "^[^:]*:", ""))).where("sitemap <> ''")
    return first_per(lines.select("site", "sitemap", "seq", "line_no"), ["site", "sitemap"],
                     [F.col("seq"), F.col("line_no")])


def sitemap_candidates(sites: DataFrame, declared: DataFrame) -> DataFrame:
    """What to fetch per site: declared files, then the known file names of every platform."""
    names = F.explode(F.array(*[F.struct(F.lit(p).alias("platform"), F.lit(n).alias("name"))
                                for p, group in K.KNOWN_SITEMAPS for n in group])).alias("k")
    known = sites.select("site", names).select(
        "site", F.concat(F.lit("https://"), "site", F.lit("/"), "k.name").alias("sitemap"),
        F.concat(F.lit("known:"), "k.platform").alias("origin"))
    return declared.select("site", "sitemap", F.lit("robots").alias("origin")).unionByName(
        known.join(declared.select("site", "sitemap"), ["site", "sitemap"], "left_anti"))
