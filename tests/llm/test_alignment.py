import collections
import hashlib

import pytest

from crawlwright.llm import alignment, pieces

ODD = [None, "", " ", "a", "a é😀ᚠb <s> <|endoftext|> x\n y\t z  w \n\n  q", " lead", "trail  ", "▁ marker", "日本語テキスト 長い",
       "a  b 　c", "x\x1c y", "don't  we'll\n\n\nsee 123 4567 é", "same text", "same text", "ᚠᚢᚦ" * 400, "é" * 3000]


@pytest.fixture(scope="module")
def both():
    with open(alignment.default_vocabulary(), encoding="utf-8") as f:
        return alignment.Aligner(f.read(), pieces.read_model(None))


def walked(both, text):
    """Ids of A and B with their byte ranges, from whole texts and decoded bytes alone."""
    text = text or ""
    raw = (" " + text).encode()
    out = []
    for ids, table in ((both.a.encode(" " + text, add_special_tokens=False).ids, both.a_bytes), (both.b.encode(text), both.b_bytes)):
        at, tokens = 0, []
        for i in ids:
            tokens.append((i, at, at := at + len(table[i])))
        if not text or b"".join(table[i] for i in ids) != raw:
            return [], []
        out.append(tokens)
    return out


def slow(both, rows):
    parsed = [(d, *walked(both, t)) for d, t in rows]
    links = []
    for _, a, b in parsed:
        own, j = [], 0
        for x, start, end in a:
            while j and b[j - 1][2] > start:
                j -= 1
            while j < len(b) and b[j][1] < end:
                if b[j][2] > start:
                    own.append((x, b[j][0]))
                j += 1
        links.append(own)
    count = collections.Counter(p for own in links for p in own)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (doc, a, b), own in zip(parsed, links):
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if start <= s < end) for side in (a, b)))
            start = end
        out.append((doc, len(a), len(b), len(ends), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return out, count, best


def check(spark, both, rows, **options):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, n_a int, block string")
    texts, pairs = alignment.align_texts(df, **options)
    want, count, best = slow(both, rows)
    assert sorted(map(tuple, texts.collect()), key=str) == sorted(want, key=str)
    assert {(r.a_id, r.b_id): (r.total, r.best) for r in pairs.collect()} == {p: (n, n == best[p[1]]) for p, n in count.items()}


def test_odd_texts(spark, both):
    check(spark, both, [(i % 9 or None, t) for i, t in enumerate(ODD)])
    check(spark, both, [(1, None), (2, "")])
    check(spark, both, [])


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert [tuple(r) for r in alignment.align_texts(df)[0].collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_whole_table_in_small_blocks(spark, both, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").where("length(text) < 6000").collect()]
    check(spark, both, rows, block_bytes=20_000)


def test_hot_text(spark, both):
    """A third of the rows is one text; its pairs are counted for each of them."""
    check(spark, both, [(i, "the same words again" if i % 3 == 0 else f"row {i} of many") for i in range(600)], block_bytes=500)


def test_chunks_or_whole_texts(both):
    text = " ".join(t for t in ODD if t)
    for keys in (both.keys(text), [text]):
        assert [k for key in keys for k in both.b.encode(key)] == both.b.encode(text)
        assert [i for key in keys for i in both.a.encode(" " + key, add_special_tokens=False).ids] == both.a.encode(" " + text, add_special_tokens=False).ids
