"""SimHash near-duplicates: fingerprints, a segment-popcount grid, exact verification, connected components.

* Fingerprint: 64 bits over word shingles; the only step in Python (Arrow batches, one text at a time).
* Embedding: the fingerprint's 32 two-bit segments become their bit counts.  The Manhattan distance of two count vectors is a
  lower bound of the Hamming distance, so fingerprints that link (2 bits or fewer) are at most 2 apart.
* Grid range join with cells of side 1: every fingerprint enters its own cell and the cells one step away (about 49).  Two
  vectors at distance 2 or less have a grid point within one step of both, so linked fingerprints meet in a cell.
* Verification: a cell with two fingerprints is decided by their exact distance.  Fingerprints of fuller cells meet once more
  at one-bit segments (64 of them), where one step is one flipped bit: those that share a point are within two bits for
  certain, and a point has at most 65 fingerprints.  So no cell is ever expanded into pairs, and no link is lost.
* Components: alternating large and small stars over the links, each round written to the shared folder.

Equal fingerprints are folded first, so copies of a text cost one row however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlwright.llm.common import slices, stash, utf8

SHINGLE_WORDS = 3
SEED = 42
CHUNK = 1 << 14
TASK_ROWS = 20_000


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words give 0."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(words_per_shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans[at:at + CHUNK]], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(batches: Iterator[pa.RecordBatch], words_per_shingle: int = SHINGLE_WORDS) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) -> (doc_id, text_key, fp), a few texts at a time."""
    for b in slices(batches, 2):
        fps = np.array([fingerprint(t, words_per_shingle) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "text_key", "fp"])


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def segment_counts(fp):
    """32 two-bit fields, each the number of ones in its segment: the low bit for exactly one, the high bit for both."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def cells(counts):
    """The vector's own cell and those one step away: 0 <-> 1 flips a field's low bit, 1 <-> 2 both."""
    out = [counts]
    for j in range(32):
        one, two = F.lit(signed(1 << 2 * j)), F.lit(signed(2 << 2 * j))
        out.append(F.when(counts.bitwiseAND(two) == 0, counts.bitwiseXOR(one)))
        out.append(F.when(counts.bitwiseAND(one.bitwiseOR(two)) != 0, counts.bitwiseXOR(one.bitwiseOR(two))))
    return F.array(*out)


def links(fps: DataFrame) -> DataFrame:
    """``(fp)`` distinct -> ``(a, b)``, a < b: links that connect whatever is within two bits of each other."""
    # a fingerprint is a few bytes here and about 49 rows below, so tasks go by fingerprints and not by bytes
    fps = fps.repartition(max(1, -(-fps.count() // TASK_ROWS)), "fp")
    placed = fps.select("fp", F.explode(cells(segment_counts(F.col("fp")))).alias("cell")).where("cell is not null")
    full = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    full = stash(full, "simhash-cells")
    two = full.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    dense = placed.join(full.where("n > 2").select("cell"), "cell").select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    point = Window.partitionBy("point")
    stars = (dense.select("fp", F.explode(flips).alias("point")).withColumn("a", F.min("fp").over(point))
             .where("a < fp").select("a", F.col("fp").alias("b")))
    return two.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` -> ``(node, root)`` for every node that has a link and is not its own root."""
    edges = stash(edges, "simhash-links")
    seen = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # (node, smaller)
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("b"),
                                            F.col("m").alias("a")).where("a <> b")
        edges = stash(small.select("a", "b").distinct(), "simhash-stars")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint, component_id, text_key)`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, the row's own included.  Null and empty texts have fingerprint
    zero and link like any other.  Repeated rows stay; a row without a doc_id links but names no component, so a component of
    such rows alone has a null id.  ``text_key`` is a hash of the text that tells rows with one doc_id apart.  An empty table
    gives an empty result.  Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), utf8("text").alias("text"))
    marked = stash(rows.mapInArrow(lambda batches: fingerprints(batches, words_per_shingle), "doc_id bigint, text_key bigint, fp bigint"), "simhash-fingerprints")
    fps = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    stars = components(links(fps.select("fp")))
    rooted = fps.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_key")


def drop_near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component holds a smaller doc_id: one document of each group stays.

    A row without a doc_id goes if its component has a numbered document and stays otherwise.  Equal rows with one doc_id are
    one document and stay together.
    """
    gone = (near_duplicates(docs, words_per_shingle).where("component_id is not null and (doc_id is null or component_id < doc_id)")
            .select(F.col("doc_id").alias("_gone_doc"), F.col("text_key").alias("_gone_text")).distinct())
    own = F.xxhash64(docs["text"])
    return docs.join(gone, (own == F.col("_gone_text")) & docs["doc_id"].eqNullSafe(F.col("_gone_doc")), "left_anti")
