"""Work lists, labels, phases, numbers and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions.rank import first_per, number_rows, top_k
from crawlwright.functions.text import lookup, strip, text
from crawlwright.functions.urls import percent_decode, raw_path
from crawlwright.operators.images import image_order

DOT = " · "


def priority_rank(df: DataFrame, name: str = "priority") -> DataFrame:
    """Rank 1..n per site by score, unknown scores last, then row order."""
    return number_rows(df, ["site"], [F.col("seo_score")], "seq", name)


# --- issue texts -------------------------------------------------------------------------------------
def _issue(kind: str, label: str, ideal: str, cap: int) -> Column:
    status, n = F.col(f"{kind}_status"), F.col(f"{kind}_len")
    quality, shared = F.col(f"{kind}_quality"), F.col(f"{kind}_shared")
    size = (F.when(status == "missing", f"No {label} found")
            .when(status == "very_short", F.concat(F.lit(f"{label} has too few characters ("), n, F.lit(f" characters, aim for {ideal})")))
            .when(status == "acceptable", F.concat(F.lit(f"{label} could be longer ("), n, F.lit(f" characters, aim for {ideal})")))
            .when(status == "long", F.concat(F.lit(f"{label} has too many characters ("), n, F.lit(f" characters, at most {cap})"))))
    names = K.LABELS_EN["quality"]
    if kind == "title":
        brand = F.when(quality == "q_brand_only", "Title says nothing but the store name")
        dup = (F.when(shared >= 2, F.concat(F.lit("Title shared by "), shared, F.lit(" pages")))
               .when(quality == "q_duplicate", names["q_duplicate"]))
        parts, known = [size, brand, dup], ("q_duplicate", "q_brand_only", "q_promo", "q_ok", "q_na")
    else:
        dup = F.when(quality == "q_duplicate", F.concat(F.lit("Description shared by "), shared, F.lit(" pages")))
        parts, known = [size, dup], ("q_duplicate", "q_ok", "q_na")
    other = F.when(~quality.isin(*known), F.concat(F.lit(f"{label}: "), lookup(quality, names.items())))
    return F.when(quality.isin(*K.QUALITY_FATAL), f"{label} holds no words of its own").otherwise(
        F.concat_ws(DOT, *parts, other))


def titles_list(masked: DataFrame) -> DataFrame:
    """Titles to rewrite, by priority."""
    rows = masked.where("title_fix").select(
        "site", "seq", "page_type", "url", "seo_score", _issue("title", "Title", "50–60", 60).alias("issues"),
        "title", "title_len", "display_name")
    return priority_rank(rows)


def descs_list(masked: DataFrame) -> DataFrame:
    """Descriptions to rewrite, by priority."""
    rows = masked.where("desc_fix").select(
        "site", "seq", "page_type", "url", "seo_score", _issue("desc", "Description", "120–160", 160).alias("issues"),
        "meta_desc", "desc_len", "title", "display_name")
    return priority_rank(rows)


def image_list(unique: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """Pictures in the given states, in work order."""
    rows = unique.where(F.col("alt_status").isin(*states)).select(
        "site", "seq", "page_url", "page_type", "image_url", "alt", "alt_status", "pages")
    return image_order(rows)


def fix_list(masked: DataFrame) -> DataFrame:
    """One row per page with everything wrong with it, by priority."""
    st, q, u = K.LABELS_EN["status"], K.LABELS_EN["quality"], K.LABELS_EN["url_quality"]

    def length(kind: str, label: str) -> Column:
        s = F.col(f"{kind}_status")
        return (F.when(s.isin("missing", "very_short", "long"), F.concat(F.lit(f"{label} ("), lookup(s, st.items()), F.lit(")")))
                .when(s == "acceptable", f"Improve {label.lower()}"))
    tq, uq = F.col("title_quality"), F.col("url_quality")
    missing, weak = F.col("images_missing_alt"), F.col("images_weak_alt")
    issues = F.concat_ws(
        DOT, length("title", "Title"), F.when(~tq.isin("q_ok", "q_na"), lookup(tq, q.items())), length("desc", "Description"),
        F.when(~uq.isin("u_ok", "u_na"), lookup(uq, u.items())),
        F.when(missing > 0, F.concat(missing, F.lit(" images without alt"))),
        F.when(weak > 0, F.concat(weak, F.lit(" images with weak alt"))),
        F.when(F.col("content_status") == "thin", "Thin content"))
    rows = masked.where("available").withColumn("issues", issues).where("issues <> ''").select(
        "site", "seq", "page_type", "url", "seo_score", "issues", "title", "title_len", "meta_desc", "desc_len")
    return priority_rank(rows)


LABELLED = {"page_type": "page_type", "link_type": "page_type", "title_status": "status", "desc_status": "status",
            "content_status": "status", "alt_status": "status", "canonical_status": "status", "h1_match": "status",
            "title_quality": "quality", "desc_quality": "quality", "url_quality": "url_quality"}


def localize(df: DataFrame, lang: str = "en") -> DataFrame:
    """Codes become labels; internal columns go; unknown codes stay as they are."""
    labels = K.LABELS_EN if lang == "en" else K.LABELS_AR
    df = df.drop(*[c for c in df.columns if c.startswith("_")])
    out = {}
    for column, group in LABELLED.items():
        if column in df.columns:
            out[column] = F.coalesce(lookup(F.col(column), labels[group].items()), F.col(column))
    if "alt" in df.columns:
        out["alt"] = F.when(strip(F.col("alt")) == "", labels["status"]["alt_empty"]).otherwise(F.col("alt"))
    return df.withColumns(out) if out else df


# --- volume and prices -----------------------------------------------------------------------------------
def work_units(titles: DataFrame, descs: DataFrame, images: DataFrame, broken: DataFrame) -> DataFrame:
    """Pages that need a title or a description (once), pictures and dead links, per site."""
    pages = titles.select("site", "url").unionByName(descs.select("site", "url")).distinct()
    parts = [t.groupBy("site").agg(F.count("*").alias("n")).withColumn("what", F.lit(w))
             for w, t in (("pages", pages), ("images", images), ("broken", broken))]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2])
    df = long.groupBy("site").agg(*[F.sum(F.when(F.col("what") == w, F.col("n")).otherwise(0)).alias(w)
                                    for w in ("pages", "images", "broken")])
    return df.withColumn("units", F.col("pages") + F.col("images") + F.col("broken"))


def volume_discount(units: Column) -> Column:
    out = None
    for limit, rate in K.VOLUME_TIERS:
        out = F.when(units >= limit, rate) if out is None else out.when(units >= limit, rate)
    return out.otherwise(0.0)


def package_for(units: Column) -> Column:
    """Struct (key, price, articles) of the package for an amount of work."""
    out = None
    for key, limit, price, articles in K.PACKAGES:
        val = F.struct(F.lit(key).alias("key"), F.lit(price).alias("price"), F.lit(articles).alias("articles"))
        out = F.when(units <= limit, val) if out is None else out.when(units <= limit, val)
    key, price, articles = K.PACKAGE_CUSTOM
    return out.otherwise(F.struct(F.lit(key).alias("key"), F.lit(price).cast("double").alias("price"),
                                  F.lit(articles).alias("articles")))


def volume_tiers(df: DataFrame, units: str = "units") -> DataFrame:
    p = package_for(F.col(units))
    return df.withColumns({"discount_rate": volume_discount(F.col(units)), "package": p["key"], "package_price": p["price"]})


def quote_items(summary: DataFrame, services: tuple[str, ...] | None = None, prices: dict[str, float] | None = None) -> DataFrame:
    """``(site, item, qty, unit, total)``."""
    unit = dict(K.UNIT_PRICES) | (prices or {})
    qty = {"meta_title": F.col("fix_titles_urls"), "meta_desc": F.col("fix_descs"),
           "image_alt": F.col("missing_alts") + F.col("weak_alts"), "broken_link_fix": F.col("broken_actionable")}
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("item"), qty[k].cast("bigint").alias("qty"), F.lit(unit[k]).alias("unit"))
                                for k, _ in K.UNIT_PRICES if services is None or k in services])).alias("i")
    return summary.select("site", items).select("site", "i.*").where("qty > 0").withColumn(
        "total", F.round(F.col("qty") * F.col("unit"), 2))


def build_quote(summary: DataFrame, discount: float = 0.0, services: tuple[str, ...] | None = None, package: bool = False,
                prices: dict[str, float] | None = None) -> DataFrame:
    """Totals per site; with ``package`` the fixed price of the work volume replaces the sum."""
    df = quote_items(summary, services, prices).groupBy("site").agg(
        F.sum("qty").alias("units"), F.round(F.sum("total"), 2).alias("reference"))
    rate = max(0.0, min(float(discount), 0.9))
    price = package_for(F.col("units"))["price"] if package else F.lit(None).cast("double")
    df = df.withColumn("subtotal", F.coalesce(price, F.col("reference")))
    df = df.withColumn("discount", F.round(F.col("subtotal") * rate, 2))
    return df.withColumn("total", F.round(F.col("subtotal") - F.col("discount"), 2))


# --- phases ---------------------------------------------------------------------------------------------
def split_phases(rows: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """J12, priority mode: every (site, table) in ``n`` consecutive, nearly equal parts; the first parts take the
    remainder.  ``rows``: site, table_name, seq."""
    placed = number_rows(rows, ["site", "table_name"], order or [], "seq", "pos")
    totals = placed.groupBy("site", "table_name").agg(F.count("*").alias("_total"))
    size, extra = F.floor(F.col("_total") / n), F.col("_total") % n
    head = extra * (size + 1)
    phase = F.when(F.col("pos") <= head, F.ceil(F.col("pos") / (size + 1))).otherwise(
        extra + F.ceil((F.col("pos") - head) / F.greatest(size, F.lit(1))))
    return placed.join(totals, ["site", "table_name"]).withColumn("phase", phase.cast("bigint")).drop("_total")


SERVICES = (("titles", ("titles",)), ("descs", ("descs",)), ("images", ("alt_missing", "alt_weak")), ("broken", ("broken",)))


def split_by_service(rows: DataFrame, n: int) -> DataFrame:
    """J12, type mode: whole services per phase, dead links always in the first.  Adds ``phase``."""
    service = lookup(F.col("table_name"), [(t, s) for s, ts in SERVICES for t in ts])
    present = rows.select("site", service.alias("service")).distinct().groupBy("site").agg(
        F.collect_set("service").alias("s"))      # at most four values
    order = F.filter(F.array(*[F.lit(s) for s, _ in SERVICES if s != "broken"]), lambda x: F.array_contains("s", x))
    main = present.withColumn("main", order).withColumn("k", F.least(F.lit(n), F.greatest(F.size("main"), F.lit(1))))
    size, extra = F.floor(F.size("main") / F.col("k")).cast("int"), F.size("main") % F.col("k")
    # the first k - extra groups hold one more when there is a remainder; what is left joins the last group
    step = F.when(extra > 0, size + 1).otherwise(size)
    early = step * F.when(extra > 0, F.col("k") - extra).otherwise(F.col("k"))
    pos = F.array_position("main", F.col("service")).cast("int")
    phase = F.when(pos <= early, F.ceil(pos / F.greatest(step, F.lit(1)))).otherwise(F.least(
        F.col("k"), F.col("k") - extra + F.ceil((pos - early) / F.greatest(size, F.lit(1)))))
    df = rows.withColumn("service", service).join(main, "site")
    return df.withColumn("phase", F.when(F.col("service") == "broken", 1).otherwise(phase).cast("bigint")).select(*rows.columns, "phase")


def phase_counts(phased: DataFrame) -> DataFrame:
    t = F.col("table_name")
    return phased.groupBy("site", "phase").agg(
        F.count_if(t == "titles").alias("titles"), F.count_if(t == "descs").alias("descs"),
        F.count_if(t.isin("alt_missing", "alt_weak")).alias("images"), F.count_if(t == "broken").alias("broken"))


def phase_references(counts: DataFrame) -> DataFrame:
    """Itemised value of every phase."""
    p = dict(K.UNIT_PRICES)
    return counts.withColumn("reference", F.round(
        F.col("titles") * p["meta_title"] + F.col("descs") * p["meta_desc"] + F.col("images") * p["image_alt"]
        + F.col("broken") * p["broken_link_fix"], 2))


def allocate_package_price(phases: DataFrame) -> DataFrame:
    """Split a fixed price over the phases of a site by value, in whole units; the last phase takes the rest.

    ``phases``: site, phase, reference, price, order_no.  A site has a handful of phases.
    """
    w = Window.partitionBy("site")
    share = F.bround(F.col("price") * F.col("reference") / F.when(F.sum("reference").over(w) == 0, 1.0)
                     .otherwise(F.sum("reference").over(w)), 0)
    df = phases.withColumns({"_share": share, "_last": F.col("phase") == F.max("phase").over(w), "_n": F.count("*").over(w)})
    rest = F.bround(F.col("price") - F.sum(F.when(~F.col("_last"), F.col("_share")).otherwise(0.0)).over(w), 0)
    number = F.when(F.col("_n") > 1, F.concat(F.col("order_no"), F.lit("-P"), F.col("phase"))).otherwise(
        F.col("order_no").cast("string"))
    return df.select("site", "phase", F.when(F.col("_last"), rest).otherwise(F.col("_share")).alias("phase_price"),
                     number.alias("number"))


def order_numbers(known: DataFrame, stores: DataFrame) -> DataFrame:
    """Stable number per store: known ones stay, new ones follow the highest, first seen first.

    ``known``: store, number.  ``stores``: store, seq.
    """
    key = F.regexp_replace(F.lower(F.trim("store")), "/+$", "")
    fresh = (stores.select(key.alias("store"), "seq").join(known.select("store"), "store", "left_anti")
             .groupBy("store").agg(F.min("seq").alias("seq")))
    top = known.agg(F.max("number")).first()[0] or K.FIRST_ORDER_NUMBER - 1
    numbered = number_rows(fresh, [], [], "seq", "_n", ties=["store"])
    return known.select("store", "number").unionByName(
        numbered.select("store", (F.lit(top) + F.col("_n")).cast("bigint").alias("number")))


# --- samples ---------------------------------------------------------------------------------------------
def sample_size(total: Column) -> Column:
    """A quarter, at least 3, at most 10, never more than there is."""
    return F.when(total <= 0, 0).otherwise(F.least(total, F.greatest(F.lit(3), F.least(
        F.lit(10), F.bround(total * 0.25, 0))))).cast("bigint")


def page_sample(pages: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """A reproducible sample of ``k`` pages per site, products when the site has any.

    Rows are ordered by a hash of their key and the seed, so the sample does not depend on partitions.
    """
    live = pages.where("available")
    mark = F.md5(F.concat_ws("#", F.lit(str(seed)), F.col("seq").cast("string")))
    rank = F.when(F.col("page_type") == "product", 0).otherwise(1)
    best = live.groupBy("site").agg(F.min(rank).alias("_r"))
    rows = live.join(best, "site").where(rank == F.col("_r")).drop("_r")
    return top_k(rows.withColumn("_h", mark), ["site"], [F.col("_h"), F.col("seq")], k, "pos").drop("_h")


# --- work items -------------------------------------------------------------------------------------------
def page_name(columns) -> Column:
    """Home page, the declared or shown name, else the last part of the URL."""
    name = text(F.col("display_name"))
    if "declared_name" in columns:
        name = F.when(text(F.col("declared_name")) != "", F.col("declared_name")).otherwise(name)
    path = F.regexp_replace(percent_decode(raw_path(F.col("url"))), "^/+|/+$", "")
    return (F.when((F.col("page_type") == "home") | (path == ""), "Home page")
            .when(name != "", name)
            .otherwise(F.element_at(F.split(path, "/"), -1)))


MATERIAL = ("excerpt", "product_desc", "category", "declared_brand")


def items_from_scan(titles: DataFrame, descs: DataFrame, audit: DataFrame) -> DataFrame:
    """F8: pages that need a text, what they need, and the facts of the page: what the audit knows of ``excerpt``, ``product_desc``,
    ``category`` and ``declared_brand`` comes along as material for the text, empty where a page or the audit has none."""
    need = titles.select("site", "url", F.lit("title").alias("f")).unionByName(
        descs.select("site", "url", F.lit("desc").alias("f")))
    need = need.groupBy("site", "url").agg(F.array_sort(F.collect_set("f")).alias("need"))      # one or two values
    facts = first_per(audit, ["site", "url"], [F.col("seq")])
    df = need.join(facts, ["site", "url"], "left")
    fixed = F.when(F.array_contains("need", "title"), text(F.col("fixed_title"))).otherwise("")
    return df.select("site", "url", "seq", "page_type", page_name(df.columns).alias("name"), text(F.col("title")).alias("title"),
                     text(F.col("meta_desc")).alias("meta_desc"), F.array_join("need", ",").alias("need"), fixed.alias("fixed_title"),
                     *[(text(F.col(c)) if c in df.columns else F.lit("")).alias(c) for c in MATERIAL])


def items_from_images(lists: DataFrame, audit: DataFrame) -> DataFrame:
    """F8: pictures that need an alt, once each, with the name of their page."""
    one = first_per(lists.select("site", "image_url", "page_url", "alt", "seq"), ["site", "image_url"],
                    [F.col("seq"), F.col("page_url")])
    facts = first_per(audit.select("site", "url", "seq", "page_type", "display_name"), ["site", "url"], [F.col("seq")])
    facts = facts.select("site", F.col("url").alias("page_url"), page_name(facts.columns).alias("name"), "page_type")
    return one.join(facts, ["site", "page_url"], "left").select(
        "site", "image_url", "page_url", text(F.col("name")).alias("name"), text(F.col("page_type")).alias("page_type"), "alt", "seq")

