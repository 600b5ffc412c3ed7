"""Exact top-k inner-product search with a bit-sliced index.

Index: vectors lie in blocks of ``BLOCK_ROWS``.  In a block every dimension is an attribute whose leading bits are kept as
bit slices (a bitmap over the rows per bit), together with the exact integers and two norms that bound what the slices leave out.

Query: the query's components, rounded to few bits, weight the attributes.  All weighted slices are added with bitmap
arithmetic (carry-save adders, negative weights through complemented slices), which gives the sum as slices again.  The k-th
largest sum is found from the most significant slice downward.  By Cauchy-Schwarz no true score differs from its sum by more
than ``slack``, so rows within twice the slack of the k-th sum hold the block's top k for certain; those boundary rows get
their exact integer score.

Queries and blocks meet in pairs of (query chunk, block) through an equi-join on the chunk; a task keeps k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlwright.llm.common import stash

SCALE = 1024
BLOCK_ROWS = 1 << 14
CHUNK_ROWS = 1 << 8
ROW_BITS = 6  # leading bits of an attribute that become slices
QUERY_BITS = 6  # bits of a query's weights


class Index:
    """The bit slices of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n, dims = rows.shape
        self.floor = rows.min(axis=0)
        above = rows - self.floor
        top = int(above.max()) if above.size else 0
        self.shift = max(0, top.bit_length() - ROW_BITS)
        lead = above >> self.shift
        self.bits = max(1, top.bit_length() - self.shift)
        self.full = (1 << self.bits) - 1
        self.middle = ((1 << self.shift) - 1) / 2
        rest = above - (lead << self.shift) - self.middle
        self.rest_norm = float(np.sqrt((rest ** 2).sum(axis=1).max())) if dims else 0.0
        self.norm = float(np.sqrt((rows.astype(float) ** 2).sum(axis=1).max())) if dims else 0.0
        words = -(-n // 64)
        padded = np.zeros((dims, self.bits, words * 64), np.uint8)
        for j in range(self.bits):
            padded[:, j, :n] = ((lead >> j) & 1).T
        self.slices = np.packbits(padded, axis=2, bitorder="little").view(np.uint64)
        real = np.zeros(words * 64, np.uint8)
        real[:n] = 1
        self.real = np.packbits(real, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], float]:
        """(slices of the weighted sum, lowest first; by how much a unit of the sum and the slack move the score)."""
        size = np.abs(query)
        self.cut = max(0, int(size.max(initial=0)).bit_length() - QUERY_BITS)
        weight = (size + ((1 << self.cut) >> 1)) >> self.cut
        rounded = np.where(query < 0, -(weight << self.cut), weight << self.cut)
        slack = float(np.linalg.norm(rounded)) * self.rest_norm + float(np.linalg.norm(query - rounded)) * self.norm
        columns: dict[int, list[np.ndarray]] = {}
        negative = query < 0
        for b in range(int(weight.max(initial=0)).bit_length()):
            dims = np.flatnonzero((weight >> b) & 1)
            if not len(dims):
                continue
            flip = np.where(negative[dims], ~np.uint64(0), np.uint64(0))[:, None]
            for j in range(self.bits):
                columns.setdefault(j + b, []).append(self.slices[dims, j] ^ flip)
        out, at = [], 0
        while columns:
            parts = columns.pop(at, None)
            if parts is None:
                out.append(np.zeros_like(self.real))
            else:
                stack = np.concatenate(parts)
                while len(stack) > 1:
                    n = len(stack) // 3
                    if n:
                        a, b, c = stack[:n], stack[n:2 * n], stack[2 * n:3 * n]
                        odd = a ^ b
                        total, carry = odd ^ c, (a & b) | (odd & c)
                        stack = np.concatenate((total, stack[3 * n:]))
                    else:
                        carry, stack = (stack[:1] & stack[1:2]), stack[:1] ^ stack[1:2]
                    columns.setdefault(at + 1, []).append(carry)
                out.append(stack[0])
            at += 1
        return out, slack

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows that have another id; equal scores by id."""
        sums, slack = self.sums(query)
        valid = self.real
        own = np.flatnonzero(self.ids == query_id)
        if len(own):
            valid = valid.copy()
            for i in own:
                valid[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        if int(np.bitwise_count(valid).sum()) > k:
            equal, need, value = valid, k, 0
            for i in reversed(range(len(sums))):
                ones = equal & sums[i]
                n = int(np.bitwise_count(ones).sum())
                if n >= need:
                    equal, value = ones, value | 1 << i
                else:
                    equal, need = equal & ~sums[i], need - n
            least = value - int(np.ceil(2 * (slack * (1 + 1e-9) + 1e-6) / (1 << (self.shift + self.cut))))
            if least > 0:
                more, equal = np.zeros_like(valid), valid
                for i in reversed(range(len(sums))):
                    if least >> i & 1:
                        equal = equal & sums[i]
                    else:
                        more, equal = more | (equal & sums[i]), equal & ~sums[i]
                valid = more | equal
        rows = np.flatnonzero(np.unpackbits(valid.view(np.uint8), bitorder="little"))
        scores = self.rows[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def quantised(vector: Column) -> Column:
    """floor(1024 * x) per component; null for a vector that takes no part."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), whole)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = np.array(pdf["q"].tolist(), dtype="<i8").reshape(len(pdf), int(pdf["dims"].iloc[0]))
    return pd.DataFrame({"dims": [pdf["dims"].iloc[0]], "part": [pdf["part"].iloc[0]], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()],
                         "data": [rows.astype("<i4").tobytes() if np.abs(rows).max(initial=0) < 1 << 31 else rows.tobytes()]})


def _unpack(ids: bytes, data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, "<i8")
    wide = len(data) == 8 * len(names) * dims
    return names, np.frombuffer(data, "<i8" if wide else "<i4").reshape(len(names), dims).astype(np.int64)


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows for every row whose vec_id is divisible by ``every``.

    Score: integer inner product of floor(1024 * x); equal scores by the smaller vec_id.  Rows without a vec_id, and vectors
    that are null or hold a null or non-finite component, take no part.  Vectors meet others of their own length only.  Rows
    that share the query's vec_id are its own; other repeated rows are candidates each, and a query that is repeated with the
    same vector is asked once.  Fewer candidates than k are all returned; none gives no rows.  Scores must fit in 64 bits.
    """
    rows = vectors.select("vec_id", quantised(F.col("embedding")).alias("q")).where("vec_id is not null and q is not null")
    rows = stash(rows.withColumn("dims", F.size("q")), "topk-vectors")
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    n_rows, n_asked = rows.count(), asked.count()
    blocks, chunks = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_asked // CHUNK_ROWS))
    packed = "dims int, part int, ids binary, data binary"
    # a hot vec_id or vector spreads as well: the part is a hash of both
    part = lambda n: F.pmod(F.xxhash64("vec_id", "q"), F.lit(n)).cast("int")
    index = rows.withColumn("part", part(blocks)).groupBy("dims", "part").applyInPandas(_pack, packed)
    asks = asked.withColumn("part", part(chunks)).groupBy("dims", "part").applyInPandas(_pack, packed)
    pairs = (index.select("dims", F.col("ids").alias("row_ids"), F.col("data").alias("row_data"), F.col("part").alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("part"))
             .join(asks, ["dims", "part"]).repartition(blocks * chunks, "dims", "block", "part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples(index=False):
                block = Index(*_unpack(pair.row_ids, pair.row_data, pair.dims))
                for name, query in zip(*_unpack(pair.ids, pair.data, pair.dims)):
                    ids, scores = block.top(int(name), query, k)
                    yield pd.DataFrame({"query_id": int(name), "query": xxhash.xxh64_intdigest(query.tobytes()) >> 1, "vec_id": ids, "score": scores})

    found = pairs.mapInPandas(run, "query_id bigint, query bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
