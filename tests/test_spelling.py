"""The spelling fallback against trying every live page."""

import random

from crawlwright.operators import spelling as SP
from crawlwright.operators import suggest as S
from test_links import A, live_and_dead


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcد ") for _ in range(rng.randint(0, 40))) for _ in range(2))
        assert SP.indel_similarity(a, b) == 2 * slow_lcs(a, b)


def test_known_scores():
    assert SP.set_ratio(["abaya", "black"], ["abaya", "black", "long"]) == 100
    assert SP.set_ratio([], ["a"]) == 0
    assert SP.set_ratio(["flared"], ["flarex"]) == 100 - 100 * 2 / 12
    assert SP.set_ratio(["abaya", "x"], ["abaya", "yy"]) == max(100 - 100 * 3 / 15, 100 - 100 * 2 / 12, 100 - 100 * 3 / 13)


def misspelt(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice("aeiou") + word[i:], word[:i] + rng.choice("xyz") + word[i + 1:], word, word + " " + word[:2]])


def test_join_equals_every_pair(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghiknorstu") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["shop", "best", "a", "عباية", "كلوش"]
    pages = []
    for i in range(250):
        toks = sorted({*rng.sample(words, rng.randint(1, 6)), *(["shop"] if i % 2 else [])})
        pages.append(("s" if i % 9 else "t", rng.choice(["product", "category", "blog"]), i, f"u{i}", toks))
    asked = {("s", tuple(sorted({t for w in rng.choice(pages)[4] for t in misspelt(rng, w).split()} - {""})), ("category", "product")) for _ in range(160)}
    asked |= {("t", ("best", "shop"), ("blog",)), ("s", ("a", "shop"), ("product",)), ("s", (), ("product",)), ("none", ("shop",), ("product",))}
    got = SP.closest_spelling(spark.createDataFrame([(s, list(p), list(a)) for s, p, a in asked], "site string, phrase array<string>, allowed array<string>"),
                              spark.createDataFrame(pages, "site string, ctype string, seq long, url string, toks array<string>"))
    want = {}
    for site, phrase, allowed in asked:
        scored = [(-SP.set_ratio(list(phrase), toks), seq, url) for s, ctype, seq, url, toks in pages if s == site and ctype in allowed]
        if scored and -min(scored)[0] >= SP.LEAST:
            want[site, phrase, allowed] = min(scored)[2]
    assert {(r.site, tuple(r.phrase), tuple(r.allowed)): r.suggested_url for r in got.collect()} == want
    assert 20 < len(want) < len(asked)


def test_close_pairs_are_few_and_hold_every_close_one():
    """Words of few syllables share letter triples with most others: only close pairs may leave a block."""
    rng = random.Random(5)
    syllables = ["an", "the", "on", "re", "tion", "en", "er", "ing"]
    words = sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) for _ in range(900)})
    pages = [sorted(rng.sample(words, 3)) for _ in range(700)] + [sorted(rng.sample(words, 7))]
    asked = [sorted(w[:-1] for w in p) for p in pages[:150]] + [sorted(w + "x" for w in pages[-1])]
    i, j = SP.close_pairs(asked, pages)
    got = set(zip(i.tolist(), j.tolist()))
    every = [(x, y) for x, a in enumerate(asked) for y, b in enumerate(pages)]
    both = lambda x, y: len(" ".join(asked[x])) + len(" ".join(pages[y]))
    close = {(x, y) for x, y in every if not set(asked[x]) & set(pages[y])
             and both(x, y) - 2 * slow_lcs(" ".join(asked[x]), " ".join(pages[y])) <= SP.DIFFER * both(x, y) + 1e-9}
    assert len(close) >= 150 and close <= got
    assert all(set(asked[x]) & set(pages[y]) or len(" ".join(asked[x])) > 64 for x, y in got - close)


def test_fallback_only_where_no_word_is_shared(spark):
    df = live_and_dead(spark, [("/products/flared-abayas-cotton", "product", ""), ("/categories/winter-jackets", "category", ""), ("/blog/flared-abayos-kotton", "blog", "")],
                       [("/products/flaredd-abayaz-coton", "product"), ("/products/kotton", "product"), ("/products/flared-nothing", "product"), ("/categories/wintr-jacket", "category")])
    plain = {r["seq"]: r["suggested_url"] for r in S.suggest_alternatives(df).collect()}
    got = {r["seq"]: (r["suggested_url"], r["suggestion_conf"]) for r in S.suggest_alternatives(df, spelling=True).collect()}
    assert plain == {}
    assert got == {1000: (A + "/products/flared-abayas-cotton", "medium"), 1003: (A + "/categories/winter-jackets", "medium")}


def test_percent_signs_in_slugs(spark):
    """A URL with a stray percent sign names itself and stops nothing."""
    df = spark.createDataFrame([("s", 1, A + "/products/50%-off", "product", True, "Half price lamp"), ("s", 2, A + "/products/%zz/copy-of-lamp", "product", True, "Desk lamp %"),
                                ("s", 3, A + "/products/%D9", "product", True, "Lamp")], "site string, seq long, url string, page_type string, available boolean, display_name string")
    assert {r["seq"]: r["reason"] for r in S.url_changes(df).collect()}[2] == "copy_of"
