"""Suggested texts as tables: suffixes, checks, batches, edits, parsing, usage and samples."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from crawlwright import constants as K
from crawlwright.functions.rank import first_per, number_rows
from crawlwright.functions.text import edges, strip, text
from crawlwright.operators.worklists import sample_size
from crawlwright.session import cut

SIMILAR = 0.8


@F.pandas_udf(BooleanType())
def too_similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Do two texts share four fifths of their letters in order?  Lengths rule most pairs out at once."""
    def norm(t):
        return re.sub(r"[\W_]+", "", t or "").lower()

    def judge(x, y):
        x, y = norm(x), norm(y)
        if not x or not y:
            return False
        if x == y:
            return True
        return 2 * min(len(x), len(y)) >= SIMILAR * (len(x) + len(y)) and SequenceMatcher(None, x, y).ratio() >= SIMILAR
    return pd.Series([judge(x, y) for x, y in zip(a, b)], dtype=bool)


def norm_text(c: Column) -> Column:
    return F.lower(F.regexp_replace(text(c), r"[^\p{L}\p{N}]+", ""))


def copied(new: Column, old: Column, ratio: bool) -> Column:
    same = (norm_text(new) != "") & (norm_text(new) == norm_text(old))
    return same | too_similar(text(new), text(old)) if ratio else same


def numbers_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text(c), K.EASTERN_DIGITS[:10], K.WESTERN_DIGITS[:10]),
                                                 F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), F.lit(1)))


# --- K1 -------------------------------------------------------------------------------------------------
def detect_title_suffix(titles: DataFrame) -> DataFrame:
    """K1: per site the common end of its titles, how it gets there, and the room it leaves for the rest."""
    t = strip(F.col("title"))
    df = titles.select("site", "seq", t.alias("t")).where("t <> ''")
    last = F.element_at(F.split("t", K.TITLE_SUFFIX_PATTERN), -1)
    df = df.withColumn("last", last)
    sep = F.regexp_extract(F.left("t", F.length("t") - F.length("last")), r"(\s+[|\-–—]\s+)$", 1)
    tail = F.when((sep != "") & F.length("last").between(2, 40), F.concat(sep, "last"))
    tails = df.groupBy("site", tail.alias("tail")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = tails.groupBy("site").agg(F.sum("n").alias("valid"), F.min(
        F.when(F.col("tail").isNotNull(), F.struct((-F.col("n")).alias("neg"), "first", "tail"))).alias("b"))
    share = -F.col("b.neg") / F.col("valid")
    mode = F.when(share >= 0.9, "auto").when(share >= 0.3, "add").otherwise("none")
    df = best.select("site", mode.alias("mode"), F.when(mode == "none", "").otherwise(F.col("b.tail")).alias("suffix"))
    n = F.length("suffix")
    return df.select("site", "suffix", "mode", (F.lit(50) - n).cast("bigint").alias("core_min"),
                     (F.lit(60) - n).cast("bigint").alias("core_max"))


# --- K2, K3 ---------------------------------------------------------------------------------------------
def _repeats(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Boolean: an earlier row (by ``seq``) of the key has the same text.  The first holder of every repeated
    text is aggregated and joined back; rows with an empty text keep to themselves."""
    v = strip(F.col(value))
    work = df.withColumn("_v", F.when(v != "", v).otherwise(F.concat(F.lit(" "), F.col("seq"))))
    first = (work.groupBy(*keys, "_v").agg(F.min("seq").alias("_first"), F.count("*").alias("_c")).where("_c > 1")
             .drop("_c"))
    return work.join(first, [*keys, "_v"], "left").withColumn(
        name, F.coalesce(F.col("seq") > F.col("_first"), F.lit(False))).drop("_v", "_first")


def _length_note(c: Column, low: int, high: int, code: str) -> Column:
    n = F.length(text(c))
    return F.when(~n.between(low, high), F.concat(F.lit(f"{code}_length:"), n))


def _promo(c: Column, offers_page: Column, harmless: Column) -> Column:
    return text(c).rlike(K.SUGGESTION_PROMO_PATTERN) & ~(offers_page & harmless)


def _status(notes: Column) -> Column:
    return F.when(notes, "ok").otherwise("review")


def validate_suggestions(rows: DataFrame, ratio: bool = True) -> DataFrame:
    """K2: notes per title and description, and the status.

    ``rows``: site, seq, id, title, description, current_title, current_desc, source_text, fixed_title, need.  With a column
    ``suffix`` (K1) titles are judged as they will show, the suffix at their end; ``name`` also tells pages about offers.
    """
    df = _repeats(_repeats(rows, ["site"], "title", "_tdup"), ["site"], "description", "_ddup")
    allowed = numbers_in(F.concat_ws(" ", "current_title", "current_desc", "source_text"))
    offers = F.concat_ws(" ", *[c for c in ("name", "current_title", "id") if c in rows.columns]).rlike(K.OFFER_PAGE_PATTERN)
    shown = F.col("title")
    if "suffix" in rows.columns:
        suffix = text(F.col("suffix"))
        shown = F.when(strip(shown).endswith(suffix), strip(shown)).otherwise(F.concat(strip(shown), suffix))
    df = df.withColumns({"_allowed": allowed, "_offers": offers, "_shown": shown})
    t, d = F.col("_shown"), F.col("description")

    def strange(c):
        return F.size(F.array_except(numbers_in(c), F.col("_allowed"))) > 0
    title_notes = F.array_compact(F.array(
        _length_note(t, 50, 60, "title"), F.when(F.col("_tdup"), "duplicate"), F.when(strange(t), "unknown_number"),
        F.when(copied(t, F.col("current_title"), ratio), "copied"),
        F.when(_promo(t, F.col("_offers"), ~text(t).rlike("[0-9]")), "promo")))
    desc_notes = F.array_compact(F.array(
        _length_note(d, 120, 160, "desc"), F.when(F.col("_ddup"), "duplicate"), F.when(strange(d), "unknown_number"),
        F.when(copied(d, F.col("current_desc"), ratio), "copied"),
        F.when(_promo(d, F.col("_offers"), ~text(d).rlike(K.PRICE_IN_TEXT_PATTERN)), "promo")))
    want_t = F.contains("need", F.lit("title")) & (text(F.col("fixed_title")) == "")
    df = df.withColumns({
        "title_notes": F.when(want_t, F.array_join(title_notes, ",")).otherwise(""),
        "desc_notes": F.when(F.contains("need", F.lit("desc")), F.array_join(desc_notes, ",")).otherwise("")})
    return df.withColumn("status", _status((F.col("title_notes") == "") & (F.col("desc_notes") == ""))).drop(
        "_tdup", "_ddup", "_allowed", "_offers", "_shown")


def _own_alt_notes(a: Column) -> tuple[Column, ...]:
    """What an alt text shows on its own."""
    return (_length_note(a, K.ALT_MIN_SUGGESTED, K.ALT_MAX, "alt"), F.when(text(a).rlike(edges(K.ALT_IMAGE_OF_PATTERN)), "says_image"),
            F.when(_promo(a, F.lit(False), F.lit(False)), "promo"))


def validate_alts(rows: DataFrame, ratio: bool = True) -> DataFrame:
    """K3.  ``rows``: site, page_url, seq, image_url, alt, current_alt."""
    df = _repeats(rows, ["site", "page_url"], "alt", "_dup")
    a = F.col("alt")
    notes = F.array_compact(F.array(
        *_own_alt_notes(a), F.when(copied(a, F.col("current_alt"), ratio), "copied"),
        F.when(F.col("_dup"), "duplicate")))
    df = df.withColumn("alt_notes", F.array_join(notes, ",")).drop("_dup")
    return df.withColumn("status", _status(F.col("alt_notes") == ""))


# --- K4, K5 ---------------------------------------------------------------------------------------------
def plan_batches(items: DataFrame, done: DataFrame, size: int = K.TEXT_BATCH) -> tuple[DataFrame, DataFrame]:
    """K4: (pending items with their batch number, rows that need no model because the title is fixed)."""
    todo = items.join(done.select("site", "id"), ["site", "id"], "left_anti")
    direct = (F.col("need") == "title") & (text(F.col("fixed_title")) != "")
    ready = todo.where(direct).select("site", "id", F.col("fixed_title").alias("title"), F.lit("ok").alias("status"))
    batches = number_rows(todo.where(~direct), ["site"], [], "seq", "pos", ties=["id"])
    return batches.withColumn("batch", F.floor((F.col("pos") - 1) / size).cast("bigint")), ready


def apply_edits(saved: DataFrame, edits: DataFrame, kind: str = "title", suffixes: DataFrame | None = None) -> DataFrame:
    """K5: upsert edited texts, check them again on their own and mark them; other rows stay as they are.

    ``saved``: site, id, title, description, title_notes, desc_notes, status, edited.  ``edits``: site, id, seq, text.
    """
    last = first_per(edits.select("site", "id", "seq", strip(F.col("text")).alias("_new")), ["site", "id"], [-F.col("seq")])
    df = saved.join(last.drop("seq"), ["site", "id"], "left")
    column, notes, low, high = (("title", "title_notes", 50, 60) if kind == "title"
                                else ("description", "desc_notes", 120, 160))
    full = F.col("_new")
    if kind == "title" and suffixes is not None:
        df = df.join(suffixes.select("site", "suffix", "mode"), "site", "left")
        full = F.when(F.col("mode") == "auto", F.concat(F.col("_new"), text(F.col("suffix")))).otherwise(F.col("_new"))
    changed = F.col("_new").isNotNull() & (F.col("_new") != text(F.col(column)))
    found = F.array_join(F.array_compact(F.array(
        _length_note(full, low, high, "title" if kind == "title" else "desc"),
        F.when(F.size(numbers_in(full)) > 0, "unknown_number"), F.when(_promo(full, F.lit(False), F.lit(False)), "promo"))), ",")
    df = df.withColumns({
        column: F.when(changed, F.col("_new")).otherwise(F.col(column)),
        notes: F.when(changed, found).otherwise(F.col(notes)), "edited": F.coalesce("edited", F.lit(False)) | changed,
        "_changed": changed})
    ok = (F.col("title_notes") == "") & (F.col("desc_notes") == "")
    return df.withColumn("status", F.when(F.col("_changed"), _status(ok)).otherwise(F.col("status"))).select(*saved.columns)


def apply_alt_edits(saved: DataFrame, edits: DataFrame) -> DataFrame:
    """K5 for pictures: upsert edited alt texts, check each on its own (length, "image of", promotion) and mark it.

    ``saved``: site, id (the picture), alt, alt_notes, status, edited.  ``edits``: site, id, seq, text; the last per picture counts, a null
    text empties the alt, and an edit that changes nothing leaves the row as it is.
    """
    new = first_per(edits.select("site", "id", "seq", strip(text(F.col("text"))).alias("_new")), ["site", "id"], [-F.col("seq")]).drop("seq")
    a = F.col("_new")
    changed = a.isNotNull() & (a != text(F.col("alt")))
    notes = F.array_join(F.array_compact(F.array(*_own_alt_notes(a))), ",")
    df = saved.join(new, ["site", "id"], "left").withColumns({
        "alt": F.when(changed, a).otherwise(F.col("alt")), "alt_notes": F.when(changed, notes).otherwise(F.col("alt_notes")),
        "status": F.when(changed, _status(notes == "")).otherwise(F.col("status")), "edited": F.coalesce("edited", F.lit(False)) | changed})
    return df.select(*saved.columns)


def keep_edited(saved: DataFrame) -> DataFrame:
    """K5: what a regeneration keeps."""
    return saved.where(F.coalesce("edited", F.lit(False)))


# --- K6, K7 ---------------------------------------------------------------------------------------------
ANSWER = "array<struct<id:string,title:string,description:string,alt:string>>"


def parse_model_output(answers: DataFrame) -> DataFrame:
    """K6: rows by id from an answer that is a JSON array, an object around one, or text with an array inside."""
    raw = strip(F.col("answer"))
    whole = F.get_json_object(raw, "$")
    inner = F.coalesce(F.get_json_object(raw, "$.items"), F.get_json_object(raw, "$.pages"),
                       F.concat(F.lit("["), raw, F.lit("]")))
    array = F.when(raw.startswith("{") & whole.isNotNull(), inner).when(raw.startswith("[") & whole.isNotNull(), raw).otherwise(
        F.regexp_extract(raw, r"(?s)\[.*\]", 0))
    df = answers.select("site", "seq", F.posexplode(F.from_json(array, ANSWER)).alias("pos", "r")).where("r.id IS NOT NULL")
    df = df.select("site", "seq", "pos", F.col("r.id").alias("id"), text(F.col("r.title")).alias("title"),
                   text(F.col("r.description")).alias("description"), text(F.col("r.alt")).alias("alt"))
    return first_per(df, ["site", "seq", "id"], [-F.col("pos")]).drop("pos")


def usage_by_day(requests: DataFrame) -> DataFrame:
    """K7: requests per model and Pacific calendar day."""
    ts = F.col("ts").cast("timestamp")
    day = F.date_format(F.from_utc_timestamp(ts, "America/Los_Angeles"), "yyyy-MM-dd")
    return requests.groupBy("model", day.alias("day")).agg(F.count("*").alias("requests"))


# --- F9, K8 ---------------------------------------------------------------------------------------------
def before_after(work: DataFrame, suggestions: DataFrame, field: str = "title", only_found: bool = True) -> DataFrame:
    """the work list with the proposed text, its length, its state and the notes."""
    notes = "title_notes" if field == "title" else "desc_notes"
    s = suggestions.select("site", F.col("id").alias("url"), F.col(field).alias("proposed"), F.col(notes).alias("note"))
    df = work.join(s, ["site", "url"], "inner" if only_found else "left")
    p = text(F.col("proposed"))
    state = F.when(p == "", "not_generated").when(text(F.col("note")) == "", "ok").otherwise("needs_review")
    return df.withColumns({"proposed": p, "proposed_len": F.when(p != "", F.length(p)).cast("bigint"), "proposal_state": state,
                           "note": text(F.col("note"))})


def compact_file(work: DataFrame, suggestions: DataFrame, field: str = "title") -> DataFrame:
    """name, URL, current and new text of every page with a proposal."""
    current = "title" if field == "title" else "meta_desc"
    df = before_after(work, suggestions, field).where("proposed <> ''")
    return df.select("site", "seq", text(F.col("display_name")).alias("name"), "url", text(F.col(current)).alias("current"),
                     "proposed", "note")


def alts_before_after(items: DataFrame, suggestions: DataFrame, only_found: bool = True) -> DataFrame:
    """F9 for pictures: the pictures that need a text (``items_from_images``) with the proposed alt, its length, its state and the note.

    ``suggestions``: site, id (the picture), alt, alt_notes; one row per picture.
    """
    s = suggestions.select("site", F.col("id").alias("image_url"), F.col("alt").alias("_alt"), F.col("alt_notes").alias("_notes"))
    p, note = text(F.col("_alt")), text(F.col("_notes"))
    df = items.join(s, ["site", "image_url"], "inner" if only_found else "left")
    state = F.when(p == "", "not_generated").when(note == "", "ok").otherwise("needs_review")
    return df.withColumns({"proposed": p, "proposed_len": F.when(p != "", F.length(p)).cast("bigint"), "proposal_state": state, "note": note}).drop("_alt", "_notes")


def compact_alt_file(items: DataFrame, suggestions: DataFrame) -> DataFrame:
    """name, page, picture, current and new alt of every picture with a proposal."""
    df = alts_before_after(items, suggestions).where("proposed <> ''")
    return df.select("site", "seq", "name", F.col("page_url").alias("url"), "image_url", text(F.col("alt")).alias("current"), "proposed", "note")


def client_sample(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """K8: a few accepted texts per site, by priority, no name twice and no two alike.

    ``rows``: site, seq, name, proposed, status.  ``needed``: site, total.  One text per site and round is chosen,
    then everything like it leaves; ten rounds at most, whatever the number of rows.
    """
    quota = needed.select("site", sample_size(F.col("total")).alias("quota")).where("quota > 0")
    left = cut(rows.where("status = 'ok'").join(quota, "site").select("site", "quota", "seq", "name", "proposed"))
    chosen = None
    for n in range(1, 11):
        pick = cut(left.where(F.col("quota") >= n).groupBy("site").agg(
            F.min(F.struct("seq", "name", "proposed")).alias("p")).select(
            "site", F.col("p.seq").alias("seq"), F.col("p.name").alias("name"), F.col("p.proposed").alias("proposed"),
            F.lit(n).cast("bigint").alias("pos")))
        if pick.isEmpty():
            break
        chosen = pick if chosen is None else chosen.unionByName(pick)
        taken = pick.select("site", F.col("name").alias("_n"), F.col("proposed").alias("_t"))
        left = cut(left.join(taken, "site").where("name <> _n").where(~too_similar("proposed", "_t"))
                   .select("site", "quota", "seq", "name", "proposed"))
    return chosen if chosen is not None else left.select("site", "seq", "name", "proposed", F.lit(0).cast("bigint").alias("pos"))
