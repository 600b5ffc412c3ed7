import hashlib
import random
import re

from crawlwright.llm import substrings


def slow(rows, window=50):
    """Every window of every document in a dictionary of first documents."""
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, words in split:
        for i in range(len(words) - window + 1):
            k = tuple(words[i:i + window])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, key string")
    got = sorted(map(tuple, substrings.removed_words(df, **options).collect()), key=str)
    assert got == slow(rows)
    return df, got


def test_whole_table(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    _, got = run(spark, rows, block_bytes=1 << 16)
    assert sum(r[2] for r in got) > 1000


def made(seed, docs, alphabet):
    rng = random.Random(seed)
    word = lambda: rng.choice(alphabet)
    passages = [[word() for _ in range(rng.choice((49, 50, 51, 60, 75, 130)))] for _ in range(6)]
    rows = []
    for d in range(docs):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [word() for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            cut = rng.randint(0, 8)
            words += p[cut:] if rng.random() < .5 else p[:len(p) - cut]
        rows.append((d, rng.choice((" ", "\n", "  ")).join(words)))
    rng.shuffle(rows)
    return rows


def test_passages(spark):
    run(spark, made(1, 120, [f"w{i}" for i in range(500)]), block_bytes=4096)


def test_few_words_and_runs(spark):
    """Two words only and long runs: many boundaries depend on more than a window."""
    run(spark, made(2, 60, ["a", "b"]) + [(100 + i, "x " * (45 + 7 * i) + "tail") for i in range(12)]
        + [(200 + i, "p q " * 40 + ("z" if i % 2 else "")) for i in range(6)], block_bytes=2048)


def test_edges(spark):
    long = " ".join(f"v{i % 4999}" for i in range(60_000))
    p = " ".join(f"k{i}" for i in range(55))
    rows = [(None, p), (None, p), (3, None), (4, ""), (5, p), (5, p), (5, p + " end"), (6, p), (9, long), (8, long + " more"), (7, "Ünï \x0b " + p)]
    df, _ = run(spark, rows)
    out = {(r["doc_id"], r["key"]): r["text"] for r in substrings.dedup_substrings(df).collect()}
    assert out[(7, "x")] == "Ünï" and out[(6, "x")] == "" and out[(3, "x")] is None and out[(None, "x")] == p and out[(4, "x")] == ""
    assert substrings.removed_words(df.limit(0)).count() == 0


def test_interior_symbols_agree():
    """A window picks the same boundary wherever it stands, and sees one in any case."""
    import numpy as np
    rng = random.Random(5)
    core = [f"c{rng.randint(0, 40)}".encode() for _ in range(70)]
    seen = {}
    for trial in range(30):
        words = [f"o{trial}-{i % 3}".encode() for i in range(rng.randint(0, 40))]
        text = b" ".join(words + core + [f"q{trial}".encode()] * rng.randint(0, 5))
        begin, end, key, _, _ = substrings.Parsed([text], np.array([1])).cells()
        for b, e, k in zip(begin, end, key):
            for s in range(b, e):
                if len(words) <= s <= len(words) + 20:
                    assert seen.setdefault(s - len(words), k) == k
    assert sorted(seen) == list(range(21))
