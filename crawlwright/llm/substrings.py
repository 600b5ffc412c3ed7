"""Substring dedup by recompression: remove long word runs that an earlier document holds as well.

Words become 64-bit symbols.  Rounds of recompression then name maximal runs of one symbol and pairs of neighbouring symbols
(left half and right half of the alphabet by a bit of the symbol's hash).  A name depends on its content only, so it is global
without a dictionary: equal substrings get equal interior symbols in every document.  Each boundary between two symbols carries
the word interval that it depends on; a window sees the boundary if it holds that interval.  What a window sees depends on
its own words only, so every occurrence of a window picks the same boundary: of those that it sees at the highest level, the
one whose interval has the least name.

Pass 1 cuts a document's windows into cells (neighbouring windows that pick the same boundary) and gives every cell a key (the
name of the boundary's interval) and a context (the name of all words of its windows).  Documents are processed in blocks of a
few MB; a block sends a key and context once, with its smallest and largest document.  Spark brings equal keys together:

* one context: the cell is one long repeat, and all its windows are removed from every document but the first;
* several contexts (the ends of repeats): pass 2 sends the windows of these cells one by one and compares those.

Pass 3 removes.  A hot passage costs one row per block, not one per document; nothing is compared pair by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from crawlwright.llm.common import blocks_for

WINDOW = 50
LEVELS = 4
LEAST_INTERVAL = 12  # words; windows whose boundary depends on fewer are keyed by all their words instead
BLOCK_BYTES = 2 << 20
NO_ID = -(1 << 63)
BLOCK, DOC = "_repeats_block", "_repeats_doc"
_U = np.uint64
_ODD = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_INVERSE = tuple(_U(pow(int(x), -1, 1 << 64)) for x in _ODD)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Names:
    """Names of word intervals: prefix sums of hashed words under two bases."""

    def __init__(self, words: np.ndarray):
        n, self.sums, self.back = len(words), [], []
        for side in range(2):
            power, back = np.ones(n + 1, _U), np.ones(n + 1, _U)
            power[1:], back[1:] = np.cumprod(np.full(n, _ODD[side])), np.cumprod(np.full(n, _INVERSE[side]))
            sums = np.zeros(n + 1, _U)
            sums[1:] = np.cumsum(mix(words + _U(side)) * power[:-1])
            self.sums.append(sums)
            self.back.append(back)

    def of(self, start: np.ndarray, end: np.ndarray, side: int) -> np.ndarray:
        return mix((self.sums[side][end] - self.sums[side][start]) * self.back[side][start] + (end - start).astype(_U))


def recompress(words: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per level (first word, end of the words) that each boundary depends on, boundaries in order; coarser levels later.

    ``words`` holds the documents of a block one after the other, ``edges`` where they begin and the end of the last.  A
    document's edge is never joined, and no window sees it beyond the first step, as other words may stand there elsewhere.
    """
    at = np.arange(len(words) + 1)
    low, high, name = at.copy(), at.copy(), mix(words)
    edge = np.zeros(len(words) + 1, bool)
    edge[edges] = True
    for level in range(LEVELS):
        for pairs in (False, True):
            if pairs:
                right = (mix(name + _U(2 * level + 1)) & _U(1)).astype(bool)
                joined = ~right[:-1] & right[1:]
            else:
                joined = name[:-1] == name[1:]
            joined &= ~edge[1:-1]
            # a boundary's fate depends on the whole symbols at both of its sides
            low, high = np.concatenate((low[:1], low[:-1])), np.concatenate((high[1:], high[-1:]))
            low[edge], high[edge] = at[edge] - 1, at[edge] + 1
            keep = np.concatenate(([True], ~joined, [True]))
            first = np.flatnonzero(keep[:-1])
            count = np.diff(np.append(first, len(name)))
            if pairs:
                second = name[np.minimum(first + 1, len(name) - 1)]
                name = np.where(count == 2, mix(name[first] * _ODD[0] + mix(second) + _U(level)), name[first])
            else:
                name = np.where(count > 1, mix(name[first] + count.astype(_U) * _ODD[1]), name[first])
            at, low, high, edge = at[keep], low[keep], high[keep], edge[keep]
        yield low, high


class Parsed:
    """The words of some documents, one after the other, with names for any interval."""

    def __init__(self, texts: list[bytes | None], docs: np.ndarray):
        self.words: list[bytes] = []
        edges = [0]
        for text in texts:
            self.words.extend((text or b"").split())  # bytes: exactly the ASCII white space
            edges.append(len(self.words))
        self.edges, self.docs = np.array(edges), docs
        self.hashed = pd.util.hash_array(np.array(self.words, dtype=object), categorize=False) if self.words else np.zeros(0, _U)
        self.names = Names(self.hashed)

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, end, key, context, document) of every cell; together they hold every window once."""
        n = np.maximum(np.diff(self.edges) - WINDOW + 1, 0)
        starts = _ranges(self.edges[:-1], n)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(_U), none.astype(_U), none
        pick_low, pick_high = np.full(len(starts), -1), np.full(len(starts), -1)
        for low, high in recompress(self.hashed, self.edges):
            i, end = np.searchsorted(low, starts), np.searchsorted(high, starts + WINDOW, side="right")
            seen = np.flatnonzero(i < end)  # the boundaries i to end depend on nothing outside the window
            best = _least(self.names.of(np.maximum(low, 0), np.minimum(high, len(self.words)), 0), i[seen], end[seen])
            pick_low[seen], pick_high[seen] = low[best], high[best]
        single = pick_high - pick_low < LEAST_INTERVAL
        new = np.ones(len(starts), bool)
        new[1:] = (single[1:] | single[:-1] | (starts[1:] != starts[:-1] + 1) | (pick_low[1:] != pick_low[:-1])
                   | (pick_high[1:] != pick_high[:-1]))
        at = np.flatnonzero(new)
        begin, end = starts[at], starts[np.append(at[1:], len(starts)) - 1] + 1
        alone = single[at]
        low, high = np.where(alone, begin, pick_low[at]), np.where(alone, begin + WINDOW, pick_high[at])
        key = self.names.of(low, high, 0)
        context = mix(self.names.of(begin, end + WINDOW - 1, 1) + (low - begin).astype(_U) * _ODD[0])
        return begin, end, key, context, self.docs[np.searchsorted(self.edges, begin, side="right") - 1]

    def windows(self, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, name, second name, document) of the windows of some cells."""
        at = _ranges(begin, end - begin)
        return at, self.names.of(at, at + WINDOW, 0), self.names.of(at, at + WINDOW, 1), np.repeat(doc, end - begin)


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the least value of each non-empty range is (the first of equals), by minima over powers of two."""
    if not len(begin):
        return begin
    depth = np.frexp((end - begin).astype(float))[1] - 1
    out, best = np.zeros(len(begin), np.int64), np.arange(len(values))
    for k in range(int(depth.max()) + 1):
        if k:
            half = 1 << (k - 1)
            left, right = best[:-half], best[half:]
            best = np.where(values[left] <= values[right], left, right)
        at = np.flatnonzero(depth == k)
        left, right = best[begin[at]], best[end[at] - (1 << k)]
        out[at] = np.where(values[left] <= values[right], left, right)
    return out


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = int(size.sum())
    return np.repeat(begin - np.concatenate((np.zeros(1, np.int64), np.cumsum(size)[:-1])), size) + np.arange(total) if total else np.zeros(0, np.int64)


FOUND = pa.schema([(BLOCK, pa.int32()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
                   ("first", pa.int64())])
CELLS = pa.schema([(BLOCK, pa.int32()), ("key", pa.int64()), ("context", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _once(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every pair of names once, with its smallest and largest document."""
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    return a[first].view(np.int64), b[first].view(np.int64), doc[first], doc[np.append(first[1:], len(doc)) - 1] if len(doc) else doc


def _columns(docs: pa.Table) -> tuple[list[bytes], np.ndarray]:
    return docs["text"].cast(pa.binary()).to_pylist(), docs[DOC].to_numpy()


def _pass1(docs: pa.Table) -> pa.Table:
    texts, ids = _columns(docs)
    *_, key, context, doc = Parsed(texts, ids).cells()
    own = doc != NO_ID
    found = _once(key[own], context[own], doc[own])
    return pa.Table.from_arrays([pa.array(np.full(len(found[0]), docs[BLOCK][0].as_py(), np.int32)), *map(pa.array, found)], schema=CELLS)


def _touched(ids: np.ndarray, hits: pa.Table) -> np.ndarray:
    """Which documents of the block may hold one of the hits: a row with one document names it, else all in its range may."""
    low, high = hits["low"].to_numpy(), hits["high"].to_numpy()
    out = np.isin(ids, low) | np.isin(ids, high)
    wide = low < high
    if wide.any():
        order = np.argsort(low[wide])
        lows, highs = low[wide][order], np.maximum.accumulate(high[wide][order])
        i = np.searchsorted(lows, ids, side="right") - 1
        out |= (i >= 0) & (highs[np.maximum(i, 0)] >= ids)
    return out & (ids != NO_ID)


def _pick(texts: list[bytes], ids: np.ndarray, chosen: np.ndarray) -> Parsed:
    return Parsed([texts[i] for i in np.flatnonzero(chosen)], ids[chosen])


def _pass2(docs: pa.Table, hits: pa.Table) -> pa.Table:
    """Whole cells as they came (kind 0 and 1), and the windows of the cells that have several contexts (kind 2)."""
    if not hits.num_rows:
        return FOUND.empty_table()
    block, split = hits[BLOCK][0].as_py(), hits["split"].to_numpy(zero_copy_only=False)
    key, zero = hits["key"].to_numpy(), np.zeros(hits.num_rows, np.int64)
    rows = [(split.astype(np.int32), key, zero, hits["low"].to_numpy(), hits["high"].to_numpy(), hits["first"].to_numpy())]
    if split.any() and docs.num_rows:
        texts, ids = _columns(docs)
        part = _pick(texts, ids, _touched(ids, hits.filter(hits["split"])))
        begin, end, keys, _, doc = part.cells()
        wanted = np.isin(keys, key[split].view(_U))
        _, one, two, doc = part.windows(begin[wanted], end[wanted], doc[wanted])
        found = _once(one, two, doc)
        rows.append((np.full(len(found[0]), 2, np.int32), *found, np.zeros(len(found[0]), np.int64)))
    columns = [np.concatenate(c) for c in zip(*rows)]
    return pa.Table.from_arrays([pa.array(np.full(len(columns[0]), block, np.int32)), *map(pa.array, columns)], schema=FOUND)


def _member(names: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it known, where) for sorted ``known``."""
    if not len(known):
        return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
    i = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return known[i] == names, i


def _stays(docs: pa.Table, hits: pa.Table) -> tuple[list[bytes], dict[int, tuple[list[bytes], np.ndarray]]]:
    """(texts, row -> (words, which of them stay)) for the rows of a block that may lose words."""
    texts, ids = _columns(docs)
    if not hits.num_rows:
        return texts, {}
    kind = hits["kind"].to_numpy()
    chosen = _touched(ids, hits.filter(pa.array(kind != 1)))
    part = _pick(texts, ids, chosen)
    begin, end, key, _, doc = part.cells()
    a, b, first = hits["a"].to_numpy().view(_U), hits["b"].to_numpy().view(_U), hits["first"].to_numpy()
    change = np.zeros(len(part.words) + 1, np.int64)

    def remove(at, to):
        np.add.at(change, at, 1)
        np.add.at(change, to, -1)

    whole = np.flatnonzero(kind == 0)
    whole = whole[np.argsort(a[whole])]
    known, i = _member(key, a[whole])
    gone = known & (first[whole][i] < doc) if len(whole) else known
    remove(begin[gone], end[gone] + WINDOW - 1)
    parted, _ = _member(key, np.sort(a[kind == 1]))
    at, one, two, doc = part.windows(begin[parted], end[parted], doc[parted])
    single = np.flatnonzero(kind == 2)
    earliest = dict(zip(zip(a[single].tolist(), b[single].tolist()), first[single].tolist()))
    gone = np.array([earliest.get(pair, d) < d for pair, d in zip(zip(one.tolist(), two.tolist()), doc.tolist())], bool)
    remove(at[gone], at[gone] + WINDOW)
    stay = np.cumsum(change[:-1]) == 0
    return texts, {row: (part.words[x:y], stay[x:y]) for row, x, y in zip(np.flatnonzero(chosen).tolist(), part.edges[:-1], part.edges[1:])}


def _digests(docs: pa.Table, hits: pa.Table) -> pa.Table:
    texts, some = _stays(docs, hits)
    n_words, n_removed, kept = [], [], []
    for row, text in enumerate(texts):
        words, stay = some.get(row) or ((text or b"").split(), None)
        left = words if stay is None else [w for w, s in zip(words, stay) if s]
        n_words.append(len(words))
        n_removed.append(len(words) - len(left))
        kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
    return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                     "kept_sha256": pa.array(kept, pa.string())})


def cut(text: bytes, words: list[bytes], stay: np.ndarray) -> bytes:
    """The text with the words that stay, each with the white space before it."""
    out, end = [], 0
    for word, keep in zip(words, stay):
        at = text.index(word, end)
        if keep:
            out += [text[end:at] if out else b"", word]
        end = at + len(word)
    return b"".join(out)


def _texts(docs: pa.Table, hits: pa.Table) -> pa.Table:
    texts, some = _stays(docs, hits)
    for row, (words, stay) in some.items():
        if not stay.all():
            texts[row] = cut(texts[row], words, stay)
    text = pa.array(texts, pa.binary()).cast(pa.string())
    return docs.set_column(docs.schema.get_field_index("text"), "text", text).drop_columns([BLOCK, DOC])


def _removed(docs: DataFrame, finish: Callable, schema: T.StructType | str, block_bytes: int) -> DataFrame:
    """One plan: the blocks are shuffled once, and all three passes read that exchange."""
    count = blocks_for(docs, F.octet_length("text") + 64, block_bytes)
    blocks = docs.withColumns({DOC: F.coalesce("doc_id", F.lit(NO_ID)), BLOCK: F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")})
    own = blocks.select(*docs.columns, DOC, BLOCK)
    cells = own.groupBy(BLOCK).applyInArrow(_pass1, f"{BLOCK} int, key bigint, context bigint, low bigint, high bigint")
    by = Window.partitionBy("key")
    shared = (cells.withColumns({"first": F.min("low").over(by), "last": F.max("high").over(by),
                                 "split": F.min("context").over(by) < F.max("context").over(by)})
              .where("first < last and (split or first < high)").select(BLOCK, "key", "low", "high", "first", "split"))
    found = own.groupBy(BLOCK).cogroup(shared.groupBy(BLOCK)).applyInArrow(
        _pass2, f"{BLOCK} int, kind int, a bigint, b bigint, low bigint, high bigint, first bigint")
    least = F.min("low").over(Window.partitionBy("kind", "a", "b"))
    found = found.withColumn("first", F.when(F.col("kind") == 2, least).otherwise(F.col("first"))).where("kind < 2 or first < high")
    return own.groupBy(BLOCK).cogroup(found.groupBy(BLOCK)).applyInArrow(finish, schema)


def removed_words(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs``; rules as in ``dedup_substrings``."""
    return _removed(docs.select("doc_id", "text"), _digests, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
                    block_bytes)


def dedup_substrings(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with every word removed that a window of 50 words covers whose words also start in an earlier document.

    Earlier means a smaller doc_id; windows are judged on the input.  Words that stay keep the white space before them, and
    texts that lose nothing are unchanged.  A null text has no words and stays null.  A row without a doc_id is earlier than
    none and later than none: it neither removes nor loses words.  Rows that share a doc_id do not remove from each other.
    All columns are kept, whatever their names (``_repeats_block`` and ``_repeats_doc`` are reserved).
    """
    return _removed(docs, _texts, docs.schema, block_bytes)
