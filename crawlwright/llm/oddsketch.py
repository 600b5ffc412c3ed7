"""MinHash near-duplicates by odd sketches: banded candidates, parity bitmaps, links confirmed on whole sets, components.

* A document's set: its distinct word shingles as 64-bit hashes.  Equal sets (128-bit name) are one node, whatever their number.
* Signature: the least value of the set under 265 permutations.  Bands of five values are keys; documents that share a key meet.
  A pair at the limit of 0.8 shares no key with a probability of (1 - 0.8^5)^53 < 1e-9, more similar pairs with less.
* Odd sketch: every (permutation, value) flips one bit of a bitmap.  The population count of two bitmaps' XOR grows with the
  share of differing samples; a pair is dropped above the count that a pair at the limit passes with a probability of 1e-9
  (``most_flips`` computes it from the chain of bit flips).
* A second odd sketch has all members of the set.  Its XOR has at most as many bits as the sets have differing members, and the
  sizes bound how many a link may have: up to some 2,000 members this drops nearly all pairs below the limit, and never a link.
* Links: what remains is decided by the intersection of the whole sets.
* No group is expanded into pairs.  Rounds of stars: every document meets the most central member (it shares most keys with
  others) that any of its buckets has; whoever met a bucket's centre leaves the bucket for the next round.  Then the members outside a
  bucket's main component meet all others of the bucket by their bitmaps, in blocks, so that no link between two components
  is lost; a bucket that one component holds costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright.llm.common import slices, stash, utf8
from crawlwright.llm.simhash import components

SHINGLE_WORDS = 2
LEAST_PERCENT = 80
ROWS, BANDS = 5, 53
BITS, BITS_OF_ALL = 512, 2048
MISS = 1e-9
STAR_ROUNDS = 4
BUCKET_BLOCK = 512
CHUNK = 1 << 12
WORDS_AT_ONCE = 1 << 16
_U = np.uint64
OF_SAMPLES, OF_ALL = [f"s{i}" for i in range(BITS // 64)], [f"x{i}" for i in range(BITS_OF_ALL // 64)]
SKETCHES = OF_SAMPLES + OF_ALL


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_SEEDS = mixed(np.arange(1, 2 * ROWS * BANDS + 1, dtype=_U))
TIMES, PLUS = _SEEDS[: ROWS * BANDS] | _U(1), _SEEDS[ROWS * BANDS:]


def most_flips(limit: float = LEAST_PERCENT / 100, samples: int = ROWS * BANDS, bits: int = BITS, miss: float = MISS) -> int:
    """The largest XOR population count to let pass: a pair of similarity ``limit`` has more with a probability below ``miss``."""
    differ = np.ones(1)  # differing samples: binomial
    for _ in range(samples):
        differ = np.convolve(differ, [limit, 1 - limit])
    state, total = np.zeros(bits + 1), np.zeros(bits + 1)
    state[0] = 1
    odd = np.arange(bits + 1) / bits
    for share in differ:  # each differing sample flips two bits, one per side
        total += share * state
        for _ in range(2):
            state = np.concatenate(([0], (state * (1 - odd))[:-1])) + np.concatenate(((state * odd)[1:], [0]))
    beyond = np.cumsum(total[::-1])[::-1]
    return int(np.flatnonzero(beyond >= miss)[-1])


def shingle_hashes(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words make one, none an empty set."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return np.zeros(0, _U)
    k, digest, parts = min(words_per_shingle, len(words)), xxhash.xxh64_intdigest, []
    for at in range(0, len(words) - k + 1, WORDS_AT_ONCE):
        some = words[at:at + WORDS_AT_ONCE + k - 1]
        parts.append(np.unique(np.fromiter(map(digest, set(map(b" ".join, zip(*[some[i:] for i in range(k)])))), _U)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def parities(values: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap in which every value has flipped one bit."""
    odd = (np.bincount((mixed(values) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch of the samples) of a set that is not empty."""
    least = np.full(ROWS * BANDS, _U(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[at:at + CHUNK, None] * TIMES + PLUS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=_U)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * _U(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64), parities(least + np.arange(ROWS * BANDS, dtype=_U) * _U(0x9E3779B97F4A7C15), BITS)


MARKED = ", ".join(["doc_id long, t1 long, t2 long, high long, low long, n long, keys array<long>", *(f"{s} long" for s in SKETCHES)])


def signatures(batches: Iterator[pa.RecordBatch], words_per_shingle: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, t1, t2, text) -> the rows of ``MARKED``, a few texts at a time."""
    names = [c.split()[0] for c in MARKED.split(", ")]
    for b in slices(batches, 3):
        rows = []
        for text in b.column(3).to_pylist():
            hashes = shingle_hashes(text, words_per_shingle)
            name = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist()
            keys, sketch = signature(hashes) if len(hashes) else (None, np.zeros(len(OF_SAMPLES), np.int64))
            rows.append((*name, len(hashes), keys, *sketch.tolist(), *parities(hashes, BITS_OF_ALL).tolist()))
        high, low, n, keys, *sketch = zip(*rows)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(x, pa.int64()) for x in (high, low, n)), pa.array(keys, pa.list_(pa.int64())),
                                          *(pa.array(x, pa.int64()) for x in sketch)], names=names)


def set_rows(batches: Iterator[pa.RecordBatch], words_per_shingle: int) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, members)."""
    for b in slices(batches, 1):
        members = [shingle_hashes(t, words_per_shingle).view(np.int64) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(members, pa.list_(pa.int64()))], names=["node", "members"])


def flips(words: list[str], a: str, b: str) -> Column:
    """Differing bits of two odd sketches."""
    return sum((F.bit_count(F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))) for w in words), F.lit(0))


def may_link(percent: int, most: int, a: str = "a_", b: str = "b_") -> Column:
    """Can the sizes and the sketches belong to a link?  A link has at most (100 - p) / (100 + p) of both sizes as differing members."""
    least, largest = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    differing = (100 + percent) * flips(OF_ALL, a, b) <= (100 - percent) * (least + largest)
    return (100 * least >= percent * largest) & (flips(OF_SAMPLES, a, b) <= most) & differing


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


class Linker:
    """Links between nodes ``(node, n, s0..)`` from buckets ``(key, node)``."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int):
        self.narrow = nodes.select("node", "n", *SKETCHES)
        self.sets, self.percent, self.most = sets, percent, most_flips(percent / 100)

    def sifted(self, pairs: DataFrame) -> DataFrame:
        """Distinct ``(a, b)`` that sizes and sketches allow."""
        a, b = prefixed(self.narrow, "a_"), prefixed(self.narrow, "b_")
        both = pairs.distinct().join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
        return both.where(may_link(self.percent, self.most)).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The ``(a, b)`` that link by their whole sets."""
        a, b = prefixed(self.sets, "a_"), prefixed(self.sets, "b_")
        both = pairs.join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
        common = F.size(F.array_intersect("a_members", "b_members"))
        all_of = F.size("a_members") + F.size("b_members")
        return both.where(100 * common >= self.percent * (all_of - common)).select("a", "b")


def rooted(met: DataFrame, stars: DataFrame) -> DataFrame:
    """``met`` with the component of every node."""
    return met.drop("root").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))


def star_round(left: DataFrame, linker: Linker) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, buckets with their centre, whom each node met): each node meets the most central of its buckets' centres that is in
    another component."""
    rank = F.struct("score", "node")
    centre = left.groupBy("key").agg(F.max_by("node", rank).alias("centre"), F.max("score").alias("centre_score"), F.max_by("root", rank).alias("centre_root"),
                                     F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").drop("r0", "r1")
    centre = stash(centre, "odd-centres")
    nearest = left.join(centre, "key").where("root <> centre_root").groupBy("node").agg(F.max_by("centre", F.struct("centre_score", "centre")).alias("centre"))
    nearest = stash(nearest, "odd-nearest")
    pairs = nearest.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return stash(linker.confirmed(linker.sifted(pairs)), "odd-links"), centre, nearest


def rest_links(met: DataFrame, linker: Linker) -> DataFrame:
    """Links between what different components still hold of a bucket: the members outside its main component meet the others.

    Large buckets are cut into blocks of about ``BUCKET_BLOCK`` members; a pair of blocks is one join key.  Two members that share
    several buckets are compared for links in the first of those that are looked at here.
    """
    main = met.groupBy("key").agg(F.max_by("root", F.struct("score", "node")).alias("main"), F.min("root").alias("r0"), F.max("root").alias("r1"),
                                  F.count("*").alias("m")).where("r0 <> r1").select("key", "main", F.ceil(F.col("m") / BUCKET_BLOCK).cast("int").alias("blocks"))
    rows = stash(met.select("key", "node", "root").join(main, "key"), "odd-mixed")
    keys = rows.groupBy("node").agg(F.collect_list("key").alias("keys"))  # a key per band at most
    rows = rows.join(keys, "node").join(linker.narrow, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = stash(rows, "odd-rest")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    few = prefixed(rows.where("root <> main").withColumns({"i": F.col("own")}).select("*", every.alias("j")), "a_")
    all_of = prefixed(rows.withColumns({"j": F.col("own")}).select("*", every.alias("i")), "b_")
    met_once = (F.col("b_root") == F.col("b_main")) | (F.col("a_node") < F.col("b_node"))
    on = ((F.col("a_key") == F.col("b_key")) & (F.col("a_i") == F.col("b_i")) & (F.col("a_j") == F.col("b_j")) & (F.col("a_root") != F.col("b_root"))
          & met_once & may_link(linker.percent, linker.most) & (F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("a_key")))
    pairs = few.join(all_of, on).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    return linker.confirmed(pairs)


def cluster(nodes: DataFrame, texts: DataFrame, percent: int, words_per_shingle: int) -> DataFrame:
    """``(node, root)`` for every node that links and is not its component's smallest node."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = stash(keyed.join(shared, "key"), "odd-met")
    scores = met.groupBy("node").agg(F.sum(F.col("m") - 1).alias("score"))
    met = met.select("key", "node").join(scores, "node")
    wanted = nodes.join(scores.select("node"), "node", "left_semi").select("node", "doc_id", "t1", "t2")
    same = (texts["t1"] == wanted["t1"]) & (texts["t2"] == wanted["t2"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"])
    once = texts.join(wanted, same).select(wanted["node"], texts["text"]).dropDuplicates(["node"])
    sets = stash(once.mapInArrow(lambda batches: set_rows(batches, words_per_shingle), "node long, members array<long>"), "odd-sets")
    linker = Linker(nodes, sets, percent)
    links, stars = None, nodes.sparkSession.createDataFrame([], "node long, root long")
    left = met = stash(rooted(met, stars), "odd-buckets")
    for _ in range(STAR_ROUNDS):
        found, centre, nearest = star_round(left, linker)
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        stars = components(links)
        of_centre = rooted(centre.select("key", F.col("centre").alias("node")), stars).select("key", F.col("node").alias("centre"), F.col("root").alias("of_centre"))
        peeled = rooted(left, stars).join(nearest.withColumnRenamed("centre", "tried"), "node", "left").join(of_centre, "key")
        left = stash(peeled.where("root <> of_centre AND NOT centre <=> tried").drop("centre", "of_centre", "tried"), "odd-left")
    found = stash(rest_links(rooted(met, stars), linker), "odd-rest-links")
    if not found.isEmpty():
        stars = components(found if links is None else links.unionByName(found))
    return stars


def near_duplicates(docs: DataFrame, percent: int = LEAST_PERCENT, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs`` (``doc_id``, ``text``).

    Documents link if ``100 * intersection >= percent * union`` of their sets; ``component_id`` is the smallest doc_id that links
    reach, the row's own included.  Null texts and texts without words have an empty set, link with nothing and are their own
    component.  Repeated rows stay.  A row without a doc_id links but names no component (a component of such rows alone has a
    null id) and is never kept.  Whole texts count; an empty table gives an empty result; other columns are not read.
    """
    text = utf8("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    marked = stash(rows.mapInArrow(lambda batches: signatures(batches, words_per_shingle), MARKED), "odd-signatures")
    folded = marked.where("n > 0").groupBy("high", "low").agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "t1", "t2")).alias("of"), F.first(F.struct("n", "keys", *SKETCHES)).alias("x"))
    nodes = stash(folded.select(F.monotonically_increasing_id().alias("node"), "high", "low", "first", "of.*", "x.*"), "odd-nodes")
    stars = cluster(nodes, rows, percent, words_per_shingle)
    placed = nodes.select("node", "high", "low", "first").join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select(F.col("high").alias("of_high"), F.col("low").alias("of_low"), "component_id")
    out = marked.select("doc_id", "n", "high", "low").join(named, (F.col("high") == F.col("of_high")) & (F.col("low") == F.col("of_low")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
