"""The text helpers against their rules spelled out piece by piece: one pass over a text gives what a pass per token gave."""

import random
import re

import pytest
from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.functions import text as T
from crawlwright.operators import grading as G

PIECES = ["", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "　", "​", "a", "Zz", "bolt", "7", "42",
          "-", "_", "/", "|", ".", "..", ",", "،", "؛", "…", ":", "!", "?", "(", ")", "[", "]", "'", "é", "ß", "İ", "中", "😀", "image", "photo",
          "صورة", "الكتاب", "والأحذية،", "٣", "ـ", "بِّ", "أَحمر", "إلى(", "{{x}}", "{%", "%}", "%s", "<%", "%>", "null", "test", "TBD", "page", "Title 12", "lorem ipsum", "xxx",
          "undefined", "none", "nan", "todo", "[ ]", "[...]", "²", "Ⅷ"]


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(5)
    texts = {"".join(pick.choice(PIECES) for _ in range(pick.randint(0, 9))) for _ in range(4000)} | set(PIECES) | {
        f"a{chr(c)}" for c in range(1, 0x3100)} | {f"{chr(c)}b {chr(c)}" for c in range(1, 0x3100)}
    return spark.createDataFrame([(t,) for t in sorted(texts)] + [(None,)], "t string")


def unlike(rows, new, old):
    return rows.where(~new.eqNullSafe(old)).select("t", new.alias("new"), old.alias("old")).take(3)


def test_white_space(rows):
    c = T.text(F.col("t"))
    assert unlike(rows, T.strip(F.col("t")), F.regexp_replace(c, f"^{T.SPACE}+|{T.SPACE}+$", "")) == []
    assert unlike(rows, T.squeeze(F.col("t")), F.trim(F.regexp_replace(c, T.SPACE + "+", " "))) == []


def test_tokens(rows):
    def fold(t):
        plain = F.regexp_replace(F.regexp_replace(t, r"^[.,،؛:!?()\[\]]+|[.,،؛:!?()\[\]]+$", ""), T.ARABIC_MARKS, "")
        plain = F.regexp_replace(F.translate(plain, "أإآىة", "ااايه"), "^(?:" + "|".join(K.ARABIC_PREFIXES) + ")(..)", "$1")
        return F.when(t.rlike(T.ARABIC), plain).otherwise(t)
    # a word has no line break
    words = rows.select(F.translate(T.text(F.col("t")), "\n\r\x85\u2028\u2029", "").alias("t"))
    assert unlike(words, T.fold(F.col("t")), fold(F.col("t"))) == []
    cut = F.transform(F.split(F.lower(T.text(F.col("t"))), T.TOKEN_SPLIT), lambda w: F.regexp_replace(w, T.TOKEN_DROP, ""))
    assert unlike(rows, T.tokens(F.col("t")), F.transform(F.filter(cut, lambda w: F.length(w) >= 2), fold)) == []


    assert unlike(rows, T.has_tokens(F.col("t")), F.size(T.tokens(F.col("t"))) > 0) == []


def test_heads_split_alike(rows):
    from crawlwright.plans.views import text_heads

    part = [F.split_part(F.col("text"), F.lit(sep), F.lit(n)).alias(f"p{i}") for i, (sep, n) in enumerate(((".", 1), (" ", 1), (" ", 2)))]
    texts = rows.select(F.monotonically_increasing_id().alias("id"), F.col("t").alias("text"))
    assert text_heads(texts).select("id", *part).exceptAll(texts.select("id", *part)).count() == 0


def test_letters(rows):
    c = F.col("t")
    assert unlike(rows, T.has_letters_or_digits(c), T.letters_and_digits(c) != "") == []
    assert unlike(rows, G.few_letters(c), F.length(F.regexp_replace(T.text(c), r"[^\p{L}\p{Nl}\p{No}]+", "")) < 3) == []


def test_placeholders(rows):
    plain = F.lower(T.strip(F.col("t"))).rlike(T.any_pattern(K.PLACEHOLDER_PATTERNS))
    assert unlike(rows, G.is_placeholder(F.col("t")), plain) == []
    assert rows.where(plain).count() > 50


def test_alt_words(rows):
    """Words are what blanks part, without the marks at their edges."""
    def status(t):
        low = t.lower()
        words = [w for w in (re.sub(r"^[.,،؛:!?|\-()\[\]]+|[.,،؛:!?|\-()\[\]]+$", "", w) for w in low.split(" ")) if w]
        return all(w in G.GENERIC_ALT for w in words)
    latin = rows.where(~T.text(F.col("t")).rlike(T.ARABIC) & T.text(F.col("t")).rlike("[a-z]") & ~T.text(F.col("t")).rlike("İ"))
    got = latin.select(T.squeeze(F.col("t")).alias("s"), G.alt_status(F.col("t")).alias("a")).collect()
    assert len(got) > 500
    for r in got:
        assert (r.a == "alt_generic") == status(r.s), r


def test_no_pattern_runs_per_token(spark):
    """A title may hold thousands of tokens: one pass over the text finds them."""
    plan = spark.range(1).select(T.tokens(F.concat(F.lit("a b "), F.col("id")))[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and not re.search(r"lambdafunction\(regexp_replace", plan)


def test_numbered_slugs_are_found_in_every_spelling(spark):
    """Only URLs that may end in a number are parsed: encoded dashes, queries, parameters and final slashes are among them."""
    urls = ["x-12", "x", "y-3/", "y", "z-4?q=1", "z", "w%2D5", "w", "v-123", "v", "u-7;a", "u", "t-\n8", "t", "x-12/c100"]
    rows = [("s", i, True, "t", "d", f"https://a.com/p/{u}") for i, u in enumerate(urls)] + [("s", 98, True, "t", "d", None), ("s", 99, True, "t", "d", "")]
    df = spark.createDataFrame(rows, "site string, seq bigint, available boolean, title string, meta_desc string, url string")
    assert sorted(r.seq for r in G.page_flags(df).where("_has_parent").collect()) == [0, 2, 4, 10]
