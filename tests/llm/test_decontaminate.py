import re

from crawlwright.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i:i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), tuple(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, docs, items, **options):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, n int, gram string")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, items int")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["contaminated"])
                  for r in decontaminate.contamination(df, bench, **options).collect()), key=str)
    assert got == slow(docs, items)
    kept = sorted(map(str, (tuple(r) for r in decontaminate.drop_contaminated(df, bench, **options).collect())))
    assert kept == sorted(str((d, t, 1, "x")) for (d, t) in docs if not slow([(d, t)], items)[0][5])


ITEMS = [(10, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."), (2, "short item"), (3, "Ünïcode É stays"), (4, None),
         (5, "..."), (6, "Short, item"), (10, "another text with the same id that has more than thirteen words in all, yes it has")]
LONG = "filler word " * 9000
DOCS = [(1, ITEMS[0][1].upper()), (2, "x " * 300 + ITEMS[0][1]), (3, "a short-item b " * 3), (4, None), (5, ""), (5, ""), (6, "ünïcode É stays ünïcode é stays"),
        (7, LONG + ITEMS[0][1]), (8, "one two three four five six seven eight nine ten eleven twelve"), (None, "short item"), (9, "short item"), (9, "no such words"), (9, "short item")]


def test_edges(spark):
    check(spark, DOCS, ITEMS)
    check(spark, DOCS, [])
    check(spark, [], ITEMS)


def test_without_broadcast(spark):
    check(spark, DOCS, ITEMS, broadcast_bytes=-1)


def test_whole_table(spark, documents, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs, items = [tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()]
    got = decontaminate.contamination(documents, bench).collect()
    want = slow(docs, items)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["contaminated"]) for r in got), key=str) == want
    assert sum(w[5] for w in want) > 0
