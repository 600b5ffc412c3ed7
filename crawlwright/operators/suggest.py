"""A live page for every dead link, and better slugs for product pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright import constants as K

from crawlwright.functions.text import folded_set, literal_array, strip, text, tokens, word_tokens
from crawlwright.functions.urls import add_url_parts, decisive_from, percent_decode, slug_from, url_key
from crawlwright.operators.redirects import is_broken

VARIANTS = folded_set(K.VARIANT_WORDS)
# Allowed destination types, best first.
ALLOWED = {"product": ("product", "category"), "category": ("category", "product"), "blog": ("blog",),
           "info": ("info",)}
ALLOWED_GENERIC = ("category", "blog", "info", "product")
ALLOWED_OTHER = ("product", "category", "blog", "info")


def _category_id(low):
    """Id of a category anywhere in the path, the first one found for live pages, the last one for dead links."""
    pairs = F.transform(low, lambda s, i: F.struct(
        F.regexp_extract(s, "^c-?([0-9]{3,})$", 1).alias("own"),
        F.when(s.isin("categories", "category"), F.coalesce(F.try_element_at(low, i + 2), F.lit(""))).alias("next")))
    ids = F.transform(pairs, lambda p: F.when(p["own"] != "", p["own"]).when(p["next"].rlike(r"^\p{Nd}+$"), p["next"])
                      .otherwise(""))
    return F.filter(ids, lambda x: x != "")


def _page_tokens(slug, name=None):
    toks = word_tokens(slug) if name is None else F.array_union(word_tokens(slug), word_tokens(name))
    return F.array_except(toks, literal_array(K.PATH_STOP_WORDS))


def _allowed_array(btype, generic):
    out = F.when(generic, literal_array(ALLOWED_GENERIC))
    for t, types in ALLOWED.items():
        out = out.when(btype == t, literal_array(types))
    return out.otherwise(literal_array(ALLOWED_OTHER))


def _candidates(audit: DataFrame) -> DataFrame:
    """``(site, seq, url, ctype, k_low, toks)``: live pages of content types with their words."""
    live = audit.where(F.col("available") & F.col("page_type").isin(*K.CONTENT_TYPES)
                       & (F.trim(text(F.col("final_url"))) == "") & F.coalesce("indexable", F.lit(True)))
    live = add_url_parts(live.select("site", "seq", "url", "page_type", "display_name"), "url", "k_")
    return live.select("site", "seq", "url", F.col("page_type").alias("ctype"), "k_low",
                       F.array_sort(_page_tokens(slug_from(F.col("k_segs")), F.col("display_name"))).alias("toks"))


def _common_words(cands: DataFrame, total: DataFrame) -> DataFrame:
    """``(site, common)``: words of more than a third of the pages; their shares bound the array by 3 x the mean words per page."""
    dfreq = (cands.select("site", F.explode("toks").alias("t")).groupBy("site", "t").agg(F.count("*").alias("df"))
             .join(total, "site").where(F.col("df") > F.greatest(F.lit(3.0), F.col("n_cands") * 0.33)))
    return dfreq.groupBy("site").agg(F.collect_list("t").alias("common"))


def _dead_links(audit: DataFrame, total: DataFrame, common: DataFrame) -> DataFrame:
    """Dead links of sites with live pages: words asked for, category id, phrase, and whether the link is a generic one."""
    none = F.array().cast("array<string>")
    broken = add_url_parts(audit.where(is_broken()).select("site", "seq", "url", "link_type"), "url", "k_")
    slug = slug_from(F.col("k_segs"))
    broken = broken.join(total.select("site"), "site", "left_semi").join(common, "site", "left").withColumns({
        "cid": F.try_element_at(_category_id(F.col("k_low")), F.lit(-1)),
        "want": F.array_sort(F.array_except(_page_tokens(slug), F.coalesce("common", none))),
        "phrase": F.array_sort(word_tokens(slug)), "n_words": F.size(F.filter(tokens(slug), lambda t: ~t.rlike(r"^\p{Nd}+$"))),
        "link_type": F.coalesce("link_type", F.when(decisive_from(F.col("k_low")) == "", "unknown").otherwise(decisive_from(F.col("k_low"))))})
    return broken.withColumn("generic", (decisive_from(F.col("k_low")) == "") & (F.col("link_type") != "product"))


def _questions(broken: DataFrame) -> DataFrame:
    open_ = broken.where(F.size("want") > 0).select(
        "site", "seq", "want", "phrase", "n_words", "generic", _allowed_array(F.col("link_type"), F.col("generic")).alias("allowed"))
    open_ = open_.withColumn("core", F.array_except("want", literal_array(VARIANTS)))
    return open_.withColumn("base", F.when(F.size("core") > 0, F.col("core")).otherwise(F.col("want")))


def suggest_alternatives(audit: DataFrame, spelling: bool = False) -> DataFrame:
    """I4: ``(site, seq, suggested_url, suggestion_conf)`` for dead links that have a live relative.

    The work is an inverted-index join, kept small in three exact ways: tokens of over a third of the pages are
    dropped; pages with the same type and token set are one candidate (the first of them), dead links with the same
    question are asked once; and a match is looked up through rare tokens first.  With ``spelling``, links that share
    no word with any live page are answered by the closest spelling (``operators.spelling``).
    """
    from crawlwright.operators.spelling import closest_spelling
    from crawlwright.session import cut

    # the candidate table is read several times below: parse and cut the URLs once
    cands = cut(_candidates(audit))
    total = cands.groupBy("site").agg(F.count("*").alias("n_cands"))
    common = _common_words(cands, total)
    broken = cut(_dead_links(audit, total, common))

    # a category id survives any rename: the first live category with that id is certain
    by_id = (cands.where("ctype = 'category'").select("site", "seq", "url", F.explode(_category_id(F.col("k_low"))).alias("cid"))
             .groupBy("site", "cid").agg(F.min_by("url", "seq").alias("id_url")))
    broken = broken.join(by_id, ["site", "cid"], "left")
    certain = broken.where(F.col("id_url").isNotNull()).select(
        "site", "seq", F.col("id_url").alias("suggested_url"), F.lit("high").alias("suggestion_conf"))

    open_ = _questions(broken.where(F.col("id_url").isNull()))
    ask = ["site", "want", "generic", "allowed"]
    asked = open_.select(*ask, "base").distinct()
    pairs = _word_matches(asked, cands, common)
    found = open_.join(_best_candidates(pairs), ask).select("site", "seq", "suggested_url", "suggestion_conf")
    if spelling:
        unmet = open_.join(_met(asked, cands, common, pairs), ask, "left_anti").where("n_words >= 2")
        phrased = ["site", "phrase", "allowed"]
        spelt = closest_spelling(unmet.select(*phrased).distinct(), cands.select("site", "ctype", "seq", "url", "toks"))
        found = found.unionByName(unmet.join(spelt, phrased).select("site", "seq", "suggested_url", F.lit("medium").alias("suggestion_conf")))
    return certain.unionByName(found)


def _met(asked: DataFrame, cands: DataFrame, common: DataFrame, pairs: DataFrame) -> DataFrame:
    """Questions that some live page answers by a word, however weakly: those have no fallback."""
    ask = ["site", "want", "generic", "allowed"]
    known = (cands.join(common, "site", "left").select("site", "ctype", F.explode(F.array_except("toks", F.coalesce("common", F.array().cast("array<string>")))).alias("t"))
             .distinct())
    probes = asked.select(*ask, F.explode("base").alias("t"))
    by_word = probes.join(known, ["site", "t"]).where(F.array_contains("allowed", F.col("ctype")) & ~(F.col("generic") & (F.col("ctype") == "product")))
    return by_word.select(*ask).unionByName(pairs.select(*ask)).distinct()


def _word_matches(asked: DataFrame, cands: DataFrame, common: DataFrame) -> DataFrame:
    """Questions with the live pages that may answer them by shared words."""
    none = F.array().cast("array<string>")
    offers = (cands.join(common, "site", "left").select(
        "site", "ctype", "seq", "url", F.array_except("toks", F.coalesce("common", none)).alias("ct"))
        .where(F.size("ct") > 0).groupBy("site", "ctype", "ct").agg(F.min_by("url", "seq").alias("url"),
                                                                    F.min("seq").alias("cseq")))
    index = offers.select("site", F.explode("ct").alias("t"), "ctype", "ct", "url", "cseq")
    freq = index.groupBy("site", "t").agg(F.count("*").alias("df"))
    ranked = (asked.select("site", "want", "generic", "allowed", "base", F.explode("base").alias("t"))
              .join(freq, ["site", "t"], "left").groupBy("site", "want", "generic", "allowed", "base")
              .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("r")))
    ask = ("site", "want", "generic", "allowed", "base")

    def lookups(which) -> DataFrame:
        return ranked.select(*ask, F.explode(which).alias("p")).select(*ask, F.col("p.t").alias("t"))
    # two or more shared words: through the rare words of the question
    several = lookups(_rare_words()).join(index, ["site", "t"])
    # one shared word is enough for generic links and one-word questions.  All one-word matches of a word and type
    # rank alike but for the size of the page's word set, its variant words and its order, so the best of each is
    # enough: no posting list is paired with the questions.
    variants = F.array_sort(F.array_intersect(F.col("ct"), literal_array(VARIANTS)))
    row = F.struct("ct", "url", "cseq")
    reps = index.groupBy("site", "t", "ctype", variants.alias("v")).agg(
        F.min_by(row, F.struct(F.size("ct"), F.col("cseq"))).alias("small"), F.min_by(row, F.col("cseq")).alias("early"))
    reps = reps.select("site", "t", "ctype", F.explode(F.array("small", "early")).alias("c")).select(
        "site", "t", "ctype", "c.ct", "c.url", "c.cseq")
    single = F.when(F.col("generic") | (F.size("want") == 1), F.col("r"))
    probes = several.unionByName(lookups(single).join(reps, ["site", "t"]))
    hit = F.size(F.array_intersect("base", "ct"))
    n_base = F.size("base")
    variant = F.size(F.array_intersect(F.array_intersect(F.col("want"), literal_array(VARIANTS)), F.col("ct")))
    pos = F.array_position("allowed", F.col("ctype"))
    pairs = (probes.where(pos > 0).withColumns({
        "hit": hit, "score": hit / n_base, "variant": variant, "pos": pos}))
    g = F.col("generic")
    return pairs.where(~(g & (F.col("ctype") == "product") & ((F.col("hit") < 3) | (F.col("score") < 0.75))))


def _best_candidates(pairs: DataFrame) -> DataFrame:
    g = F.col("generic")
    prio = (F.when(~g, 0).when((F.col("ctype") == "blog") & (F.col("score") >= 0.99), 3)
            .when(F.col("ctype") == "category", 2).when(F.col("ctype").isin("blog", "info"), 1).otherwise(0))
    order = F.struct((-prio).alias("a"), (-F.col("score")).alias("b"), (-F.col("hit")).alias("c"),
                     F.when(g, -F.col("hit") / F.size("ct")).otherwise(-F.col("variant").cast("double")).alias("d"),
                     F.when(g, -F.col("variant")).otherwise(F.col("pos").cast("int")).alias("e"),
                     F.col("cseq").alias("f"))
    best = pairs.groupBy("site", "want", "generic", "allowed").agg(
        F.min_by(F.struct("url", "hit", "score", "ctype"), order).alias("b"))
    h, s, cat = F.col("b.hit"), F.col("b.score"), F.col("b.ctype") == "category"
    conf = (F.when((h >= 2) & (s >= 0.75), "high")
            .when(((h >= 2) & (s >= 0.5)) | ((F.size("want") == 1) & (h == 1) & cat) | (g & cat), "medium"))
    return best.withColumn("suggestion_conf", conf).where(F.col("suggestion_conf").isNotNull()).select(
        "site", "want", "generic", "allowed", F.col("b.url").alias("suggested_url"), "suggestion_conf")


def _rare_words():
    """The base words that every match of two or more words must hold one of.

    A specific link is answered only by two or more shared words covering half of the base, a generic one also by
    two: with ``h`` needed words of ``n``, one of the ``n - h + 1`` rarest is among them.
    """
    n = F.size("r")
    h = F.when(F.col("generic"), F.lit(2)).otherwise(F.greatest(F.lit(2), F.ceil(n / 2).cast("int")))
    return F.slice("r", F.lit(1), F.greatest(n - h + 1, F.lit(0)))


def annotate_broken(audit: DataFrame, found_on: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Dead links get the place they show, a destination and its confidence."""
    had = [c for c in audit.columns if c not in ("found_on", "suggested_url", "suggestion_conf")]
    dead = audit.where(is_broken()).select("site", "seq", url_key(F.col("req_url")).alias("dst_key"))
    extra = (dead.join(found_on.select("site", "dst_key", "found_on"), ["site", "dst_key"], "left")
             .join(suggestions, ["site", "seq"], "left").drop("dst_key"))
    return audit.select(*had).join(extra, ["site", "seq"], "left").select(
        *had, *[F.coalesce(c, F.lit("")).alias(c) for c in ("found_on", "suggested_url", "suggestion_conf")])


# --- better slugs ------------------------------------------------------------------------------------
def _slug_position(segs):
    """1-based index of the naming segment: before the id where the URL ends with one."""
    n = F.size(segs)
    ends = F.lower(F.coalesce(F.try_element_at(segs, F.lit(-1)), F.lit(""))).rlike(K.KEY_ID_PATTERN)
    return F.when((n >= 2) & ends, n - 1).otherwise(n)


def slug_words(title):
    """Words a slug may use, in the order of the title, untranslated; Latin words in lower case."""
    t = F.regexp_replace(F.split_part(text(title), F.lit(" | "), F.lit(1)),
                         r"[^\p{L}\p{N}_\s\x{0600}-\x{06FF}\-]", " ")
    words = F.filter(F.split(t, r"[\s_\-]+"), lambda w: (w != "") & ~w.rlike("^ـ+$"))
    return F.transform(words, lambda w: F.when(w.rlike("^[A-Za-z]"), F.lower(w)).otherwise(w))


def _first_slug_size(words):
    """How many of the first six words fit into 60 characters."""
    lens = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.when(
        (k <= F.size(words)) & (F.length(F.array_join(F.slice(words, F.lit(1), k), "-")) <= 60), k).otherwise(0))
    return F.array_max(lens)


def url_change_reasons(products: DataFrame) -> DataFrame:
    """I11, first half: products whose slug is a copy, a code, another product's name or has a stray number."""
    df = products.where(F.col("available") & (F.col("page_type") == "product"))
    segs = F.filter(F.split(F.regexp_replace(percent_decode(F.col("url")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), "/"), lambda s: s != "")
    df = df.withColumn("segs", segs).where(F.size("segs") > 0).withColumn("idx", _slug_position(F.col("segs")))
    df = df.withColumns({"seg": F.element_at("segs", F.col("idx")), "name": strip(F.col("display_name"))})
    df = df.withColumns({"own": F.array_sort(word_tokens(F.col("name"))), "st": F.array_sort(word_tokens(F.col("seg")))})
    mine = F.size(F.array_intersect("st", "own"))
    odd = (F.size("own") > 0) & (F.size("st") > 0) & (mine * 2 <= F.size("st"))
    # names are folded to token sets; a name that covers 70 % of a slug holds one of its rarest tokens
    names = (df.where(F.size("own") > 0).groupBy("site", "own").agg(F.min_by("name", "seq").alias("other_name"),
                                                                   F.min("seq").alias("oseq")))
    freq = names.select("site", F.explode("own").alias("t")).groupBy("site", "t").agg(F.count("*").alias("df"))
    asked = df.where(odd).select("site", "st").distinct()
    ranked = (asked.select("site", "st", F.explode("st").alias("t")).join(freq, ["site", "t"], "left")
              .groupBy("site", "st").agg(F.array_sort(F.collect_list(F.struct(
                  F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("r")))
    n = F.size("r")
    probes = ranked.select("site", "st", F.explode(F.slice("r", F.lit(1), n - F.ceil(n * 7 / 10).cast("int") + 1)).alias("p"))
    probes = probes.select("site", "st", F.col("p.t").alias("t"))
    index = names.select("site", F.explode("own").alias("t"), F.col("own").alias("oset"), "other_name", "oseq")
    share = F.size(F.array_intersect("st", "oset"))
    other = (probes.join(index, ["site", "t"]).where(share * 10 >= F.size("st") * 7).groupBy("site", "st")
             .agg(F.min_by("other_name", "oseq").alias("other_name")))
    df = df.join(other, ["site", "st"], "left")
    seg = F.col("seg")
    number = F.regexp_extract(seg, "-([0-9]{1,2})$", 1)
    name_numbers = F.regexp_extract_all(F.col("name"), F.lit("([0-9]+)"), F.lit(1))
    reason = (F.when(seg.rlike("(?i)copy[-_ ]?of") | F.contains(seg, F.lit("نسخة")), "copy_of")
              .when(seg.rlike(r"(?i)^(?:[0-9a-f]{6,}|[0-9a-f\-]{20,})$") | ~seg.rlike(r"[A-Za-z\x{0600}-\x{06FF}]"),
                    "code_like")
              .when(odd & F.col("other_name").isNotNull() & (F.col("other_name") != F.col("name")), "other_product")
              .when((number != "") & ~F.array_contains(name_numbers, number), "extra_number"))
    return df.withColumn("reason", reason)


def url_changes(products: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """Current URL, new URL and reason.

    A new slug must be free.  Claims on it are settled by rounds instead of a walk over the site: every open row
    bids for its next slug, the first bidder by ``seq`` wins, the others move on to the next word of their title.
    A row only competes with the few rows that bid for the same slug.
    """
    from crawlwright.session import cut

    df = url_change_reasons(products)
    taken = df.select("site", F.lower("seg").alias("slug")).distinct()
    todo = df.where(F.col("reason").isNotNull())
    if suggestions is not None:
        todo = todo.join(suggestions.select("site", "url", F.col("title").alias("_new")), ["site", "url"], "left")
    else:
        todo = todo.withColumn("_new", F.lit(None).cast("string"))
    src = F.when(text(F.col("_new")) != "", F.col("_new")).otherwise(F.col("name"))
    todo = todo.withColumn("words", slug_words(src))
    todo = todo.select("site", "seq", "url", "name", "reason", "segs", "idx", "words",
                       _first_slug_size(F.col("words")).alias("k0")).where("k0 > 0")
    # every slug the row may end with: the first k words, k from the normal size up to the whole title
    bids = todo.select("site", "seq", "url", F.posexplode(F.transform(
        F.sequence(F.col("k0"), F.size("words")), lambda k: F.array_join(F.slice("words", F.lit(1), k), "-")))
        .alias("try", "slug"))
    bids = bids.withColumn("low", F.lower("slug"))
    bids = cut(bids.join(taken.withColumnRenamed("slug", "low"), ["site", "low"], "left_anti"))
    won = settle_bids(bids)
    new = todo.join(won, ["site", "seq", "url"])
    parts = F.concat(F.slice("segs", F.lit(1), F.col("idx") - 1), F.array("slug"),
                     F.slice("segs", F.col("idx") + 1, F.size("segs")))
    root = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    quoted = F.array_join(F.transform(parts, lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/")
    return new.select("site", "seq", "name", "url", F.concat_ws("/", root, quoted).alias("new_url"), "reason")


def settle_bids(bids: DataFrame) -> DataFrame:
    """Give every row its first free slug, rows in ``seq`` order, exactly as a sequential walk would.

    Each round: every open row bids its first open slug.  A bid is final when no earlier open row still lists the
    same slug at all; losers drop the slugs taken in the round.  The earliest row of a site always wins, so the
    rounds end; in practice two or three settle everything.
    """
    from crawlwright.session import cut

    open_ = bids
    done = None
    while True:
        now = open_.groupBy("site", "seq", "url").agg(F.min_by("low", "try").alias("low"), F.min("try").alias("try"))
        first = open_.groupBy("site", "low").agg(F.min("seq").alias("first_seq"))
        win = cut(now.join(first, ["site", "low"]).where("seq = first_seq").select("site", "seq", "url", "low", "try"))
        if win.isEmpty():
            break
        slugs = win.join(open_.select("site", "seq", "url", "low", "slug"), ["site", "seq", "url", "low"]).select(
            "site", "seq", "url", "slug")
        done = slugs if done is None else done.unionByName(slugs)
        open_ = cut(open_.join(win.select("site", "seq", "url"), ["site", "seq", "url"], "left_anti")
                    .join(win.select("site", "low"), ["site", "low"], "left_anti"))
        if open_.isEmpty():
            break
    return done if done is not None else bids.select("site", "seq", "url", "slug").limit(0)
