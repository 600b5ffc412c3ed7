import random
import re

import numpy as np
import pytest

from crawlwright.llm import oddsketch


def slow_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset([tuple(words)] if words else [])


def slow(rows):
    """By trying every pair of whole sets."""
    sets = [slow_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and find(i) != find(j) and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))]
    return [(d, len(s), c, d is not None and d == c) for (d, _), s, c in zip(rows, sets, least)]


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, node int, keys string")
    got = oddsketch.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(slow(rows), key=str)


def test_whole_table(spark, documents):
    check(spark, [tuple(r) for r in documents.select("doc_id", "text").collect()])


def test_edges(spark):
    long = " ".join(f"w{i * i % 7919}" for i in range(70_000))
    five = "a b c d e f"  # five shingles; four of them are at the limit exactly
    check(spark, [(5, None), (4, ""), (4, " \n "), (9, "One  two"), (8, "one two"), (None, "one two"), (None, "lonely text of five words"),
                  (3, long), (2, long + " tail"), (1, "É é"), (0, "é é"), (20, five), (21, "b c d e f"), (22, "word"), (23, "Word"), (24, "word word"),
                  (25, "word word word"), (26, "c d e f"), (26, "c d e f")])
    check(spark, [])
    check(spark, [(1, None), (2, None)])


@pytest.mark.parametrize("changed", [2, 9, 14])
def test_dense_groups(spark, changed):
    """Many copies of one text, each with words of its own: all link, few link, or only over a centre; and a chain of small steps."""
    rng = random.Random(changed)
    base = [f"b{i}" for i in range(120)]
    rows = [(7, " ".join(base))]
    for i in range(150):
        words = list(base)
        for p in rng.sample(range(120), rng.randint(1, changed)):
            words[p] = f"x{rng.randrange(9999)}"
        rows.append((100 + i, " ".join(words)))
    chain = [f"c{i}" for i in range(60)]
    for i in range(0, 60, 3):
        chain[i] = f"n{i}"
        rows.append((1000 - i, " ".join(chain)))
    check(spark, rows)


def test_hot_row(spark):
    check(spark, [(i, "a text that a third of the rows has" if i % 3 else f"another text {i} for row {i}") for i in range(900)])


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Without stars everything is found by the last step alone, across blocks."""
    monkeypatch.setattr(oddsketch, "STAR_ROUNDS", 0)
    monkeypatch.setattr(oddsketch, "BUCKET_BLOCK", 7)
    test_dense_groups(spark, 9)


def test_sketch_estimates():
    """Pairs at the limit pass, dissimilar ones don't, and bands meet what they promise."""
    rng, most = np.random.default_rng(3), oddsketch.most_flips()
    met = 0
    for _ in range(200):
        both = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        a, b = np.sort(both[:900]), np.sort(both[100:])  # 800 of 1000
        (ka, sa), (kb, sb) = oddsketch.signature(a), oddsketch.signature(b)
        assert bin(int.from_bytes((sa ^ sb).tobytes(), "little")).count("1") <= most
        met += bool((ka == kb).any())
        far = oddsketch.signature(np.sort(both[:500]))[1] ^ oddsketch.signature(np.sort(both[500:]))[1]
        assert bin(int.from_bytes(far.tobytes(), "little")).count("1") > most
    assert met == 200
