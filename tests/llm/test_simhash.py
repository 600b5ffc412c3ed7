import random

import pytest

from crawlwright.llm import simhash


def slow_fingerprint(text):
    import re
    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """(key, doc_id, fingerprint) -> key -> smallest doc_id, by trying every pair."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            if bin(a[2] ^ rows[j][2]).count("1") <= 2:
                parent[find(i)] = find(j)
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(find(i), []).append(r[1])
    return [min((d for d in out[find(i)] if d is not None), default=None) for i in range(len(rows))]


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, fp string, component_id int")
    got = sorted(map(tuple, simhash.near_duplicates(df).drop("text_key").collect()), key=str)
    fps = [(i, d, slow_fingerprint(t)) for i, (d, t) in enumerate(rows)]
    want = sorted(((d, f"{f:016x}", c) for (_, d, f), c in zip(fps, slow_components(fps))), key=str)
    assert got == want


def test_whole_table(spark, documents):
    check(spark, [tuple(r) for r in documents.select("doc_id", "text").collect()])


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    check(spark, [(5, None), (4, ""), (4, ""), (9, "One  two"), (8, "one two"), (None, "one two"), (None, "lonely text of five words"),
                  (3, long), (2, long + " tail"), (1, "É é"), (0, "é é")])
    check(spark, [])


@pytest.mark.parametrize("spread", [1, 3])
def test_dense_fingerprints(spark, spread):
    """Many fingerprints around one centre, and a chain of two-bit steps: full cells, no lost link."""
    rng = random.Random(spread)
    centre, fps = rng.getrandbits(64), set()
    for _ in range(400):
        x = centre
        for b in rng.sample(range(64), rng.randint(0, spread)):
            x ^= 1 << b
        fps.add(x)
    x = rng.getrandbits(64)
    for i in range(0, 60, 2):
        fps.add(x := x ^ (3 << i))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp bigint")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    comp = slow_components([(i, i, f) for i, f in enumerate(fps)])
    groups = {}
    for f, c in zip(fps, comp):
        groups.setdefault(c, []).append(simhash.signed(f))
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}
