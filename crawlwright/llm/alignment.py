"""Cross-tokenizer alignment: byte-level BPE tokens against SentencePiece pieces, and how often two ids overlap corpus-wide.

* Spans: the tokenizers library gives character offsets, sentencepiece a proto with a span per piece.  They are the coarse cuts.
  A token whose span is as long as its decoded bytes ends where the span does.  Where it is not (several tokens in one
  character, byte-fallback pieces, whose spans are empty or whole characters) the decoded bytes place the ends in between.
* Chunks: a text is cut before spaces that follow something else than white space.  No token of either side crosses such a
  place, so a text's tokens are those of its chunks (checked for the two vocabularies; else the whole text is the chunk), and a
  worker aligns each distinct chunk once.  All groups and links lie inside a chunk.
* Counts: texts are taken in blocks of some MB.  A block sends every id pair once, with its number of links; Spark adds them
  up, finds each piece's highest count and sends the totals back to the blocks, where they are summed over the links of every
  text.  What is shuffled is distinct pairs per block, never a row per link.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlwright.llm.common import slices, stash, utf8
from crawlwright.llm.pieces import read_model

BLOCK_BYTES = 8 << 20
MEMO_BYTES = 24 << 20  # of chunks that a worker remembers from block to block
AT_ONCE = 4096
CUT = re.compile(r"(?<=\S)(?= +[^ ])")
ODD_SPACE = re.compile(r"\s | $")
MARK = "▁"
BYTE_PIECE = 6


def default_vocabulary() -> str:
    """The public byte-level vocabulary on this machine; callers may name any other."""
    return os.environ.get("BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Byte-level characters: visible Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of some lists one after the other, and how many each has."""
    return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def refined(span_start: np.ndarray, span_end: np.ndarray, width: np.ndarray, counts: np.ndarray, chunk_start: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the span's where it is as long as the decoded bytes; other tokens follow the last such end by their bytes."""
    at = np.arange(len(width))
    sure = span_end - span_start == width
    first = np.repeat(starts_of(counts), counts)
    last = np.maximum.accumulate(np.where(sure, at, -1)) if len(at) else at
    total = np.cumsum(width)
    inside = last >= first
    last = np.maximum(last, 0)
    begun = np.repeat(chunk_start, counts) + total - (total[first] - width[first] if len(first) else 0)
    return np.where(inside, span_end[last] + total - total[last], begun)


class Aligner:
    """Both tokenizers, the bytes of their entries, and what is known about the chunks seen so far."""

    def __init__(self, vocabulary: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabulary)
        self.a.encode_special_tokens = True
        letters = byte_alphabet()
        spelled = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = np.array([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
                                 for t in (spelled.get(i, "") for i in range(max(spelled) + 1))] + [b""], dtype=object)[:-1]
        proto = pb.ModelProto()
        proto.ParseFromString(pieces)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.b_bytes = np.array([bytes([int(p.piece[3:5], 16)]) if p.type == BYTE_PIECE else p.piece.replace(MARK, " ").encode()
                                 for p in proto.pieces] + [b""], dtype=object)[:-1]
        self.a_width = np.fromiter(map(len, self.a_bytes), np.int64, len(self.a_bytes))
        self.b_width = np.fromiter(map(len, self.b_bytes), np.int64, len(self.b_bytes))
        self.a_said = np.array([f"{i}{end}".encode() for i in range(len(self.a_bytes)) for end in ",|"], dtype=object)
        self.b_said = np.array([f"{i}{end}".encode() for i in range(len(self.b_bytes)) for end in ",;"], dtype=object)
        rules = json.loads(vocabulary)
        split = (rules.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and rules.get("normalizer") is None
        norm = proto.normalizer_spec
        self.cut = (split and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
                    and not norm.precompiled_charsmap and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.counts: list[np.ndarray] = [np.zeros((4, 0), np.int64)]  # of a, b, groups, links; -1 links where the bytes differ
        self.links: list[np.ndarray] = [np.zeros(0, np.int64)]  # id pairs, chunk after chunk
        self.said: list[bytes] = []
        self.held = 0

    def whole(self, parts: list[np.ndarray]) -> np.ndarray:
        """What was kept batch by batch, as one array."""
        if len(parts) > 1:
            parts[:] = [np.concatenate(parts, axis=-1)]
        return parts[0]

    def keys(self, text: str) -> list[str]:
        """The chunks of space + text, each without its leading space."""
        if not self.cut:
            return [text]
        if ODD_SPACE.search(" " + text):
            return [c[1:] for c in CUT.split(" " + text)]
        return text.split(" ")

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        """Chunk numbers of each text; new chunks are aligned on the way."""
        known, fresh, out = self.known, [], []
        for text in texts:
            keys = self.keys(text)
            numbers = np.fromiter(map(known.get, keys, repeat(-1)), np.int64, len(keys))
            for i in np.flatnonzero(numbers < 0).tolist():
                key = keys[i]
                number = known.get(key)
                if number is None:
                    number = known[key] = len(known)
                    fresh.append(key)
                    self.held += len(key) + 64
                numbers[i] = number
            out.append(numbers)
        size, begin = 0, 0
        for i, key in enumerate(fresh):
            size += len(key)
            if size > 1 << 20 or i + 1 - begin == AT_ONCE or i + 1 == len(fresh):
                self.learn(fresh[begin:i + 1])
                size, begin = 0, i + 1
        return out

    def learn(self, keys: list[str]) -> None:
        """Align some chunks and keep what was found."""
        chunks = [" " + k for k in keys]
        raw = [c.encode() for c in chunks]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        start = starts_of(size)
        found = self.a.encode_batch(chunks, add_special_tokens=False)
        a_ids, a_n = flat([e.ids for e in found])
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64).reshape(-1, 2)
        protos = [p.pieces for p in self.b.encode(keys, return_type="proto", num_threads=1)]
        b_n = np.fromiter(map(len, protos), np.int64, len(protos))
        b_ids, b_to = np.array([x for pieces in protos for p in pieces for x in (p.id, p.end)], np.int64).reshape(-1, 2).T
        b_to = b_to + 1  # the mark before a chunk is its leading space
        b_from = np.concatenate(([0], b_to))[:len(b_to)]  # a span begins where the one before ends
        b_from[starts_of(b_n)[b_n > 0]] = 0
        # characters to bytes
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        place = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))))
        first_char = np.repeat(starts_of(np.fromiter(map(len, chunks), np.int64, len(chunks))), a_n)
        a_end = refined(place[first_char + spans[:, 0]], place[first_char + spans[:, 1]], self.a_width[a_ids], a_n, start)
        shift = np.repeat(start, b_n)
        b_end = refined(shift + b_from, shift + b_to, self.b_width[b_ids], b_n, start)
        good = self.same(self.a_bytes, a_ids, a_n, raw) & self.same(self.b_bytes, b_ids, b_n, raw)
        if not good.all():
            a_keep, b_keep = np.repeat(good, a_n), np.repeat(good, b_n)
            a_ids, a_end, b_ids, b_end = a_ids[a_keep], a_end[a_keep], b_ids[b_keep], b_end[b_keep]
            a_n, b_n = np.where(good, a_n, 0), np.where(good, b_n, 0)
        cuts = np.union1d(a_end, b_end)
        of_a, of_b = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
        pairs = a_ids[of_a] * len(self.b_bytes) + b_ids[of_b]
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        ends = start + size
        n_links = np.searchsorted(cuts, ends, "right") - np.searchsorted(cuts, start, "right")
        n_groups = np.searchsorted(shared, ends, "right") - np.searchsorted(shared, start, "right")
        self.counts.append(np.stack((a_n, b_n, n_groups, np.where(good, n_links, -1))))
        self.links.append(pairs)
        self.said.extend(self.spell(a_ids, a_end, a_n, b_ids, b_end, b_n, shared))

    @staticmethod
    def same(table: np.ndarray, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Per chunk: do the tokens' bytes, joined, give its bytes?"""
        made = table[ids].tolist()
        first = starts_of(counts).tolist()
        return np.fromiter((b"".join(made[f:f + n]) == r for f, n, r in zip(first, counts.tolist(), raw)), bool, len(raw))

    def spell(self, a_ids, a_end, a_n, b_ids, b_end, b_n, shared) -> list[bytes]:
        """Per chunk the groups as ``a1,a2|b1;`` in order."""
        group_a, group_b = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        a_before = np.searchsorted(group_a, np.arange(len(shared)), "right")  # of this group and those before
        b_before = np.searchsorted(group_b, np.arange(len(shared)), "left")  # of those before
        words = np.empty(len(a_ids) + len(b_ids), dtype=object)
        words[np.arange(len(a_ids)) + b_before[group_a]] = self.a_said[2 * a_ids + (a_end == shared[group_a])]
        words[np.arange(len(b_ids)) + a_before[group_b]] = self.b_said[2 * b_ids + (b_end == shared[group_b])]
        words, first = words.tolist(), starts_of(a_n + b_n).tolist()
        return [b"".join(words[f:f + n]) for f, n in zip(first, (a_n + b_n).tolist())]


@lru_cache(maxsize=1)
def _loaded(vocabulary: str, pieces: bytes) -> Aligner:
    return Aligner(vocabulary, pieces)


def piece_count(pieces: bytes) -> int:
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    proto.ParseFromString(pieces)
    return len(proto.pieces)


FOUND = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks binary, "
         "pairs array<long>, counts array<long>, of_chunks binary, firsts binary")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]


class Block:
    """Texts of some MB, as numbers of chunks."""

    def __init__(self, number: int):
        self.number, self.bytes, self.ids, self.rows, self.chunks, self.digests = number, 0, [], [], [], []

    def add(self, aligner: Aligner, ids: pa.Array, raw: list[bytes]) -> None:
        texts, whole = [], []
        for r in raw:
            try:
                texts.append(r.decode())
                whole.append(len(r) > 0)
            except UnicodeDecodeError:  # no tokenizer gives these bytes back
                texts.append("")
                whole.append(False)
        numbers = aligner.numbered(texts)
        counts = aligner.whole(aligner.counts)
        for good, own in zip(whole, numbers):
            sums = counts[:, own].sum(axis=1) if good and (counts[3, own] >= 0).all() else None
            self.rows.append(np.zeros(4, np.int64) if sums is None else sums)
            self.chunks.append(own[:0] if sums is None else own)
            said = b"" if sums is None else b"".join(map(aligner.said.__getitem__, own.tolist()))[:-1]
            self.digests.append("" if sums is None else hashlib.sha256(said).hexdigest())
        self.ids.extend(ids.to_pylist())
        self.bytes += sum(map(len, raw))

    def batches(self, aligner: Aligner) -> Iterator[pa.RecordBatch]:
        """A row per text with its chunks, then a row with the id pairs of the block and those of each chunk."""
        lengths = np.fromiter(map(len, self.chunks), np.int64, len(self.chunks))
        numbers = np.concatenate([np.zeros(0, np.int64), *self.chunks])
        times = np.bincount(numbers)
        used = np.flatnonzero(times)
        times, codes = times[used], (np.cumsum(times > 0) - 1)[numbers]
        held = np.maximum(aligner.whole(aligner.counts)[3], 0)
        sizes = held[used]
        at = np.repeat(starts_of(held)[used] - starts_of(sizes), sizes) + np.arange(sizes.sum())
        pairs, of_chunks = np.unique(aligner.whole(aligner.links)[at], return_inverse=True)
        counts = np.bincount(of_chunks, weights=np.repeat(times, sizes), minlength=len(pairs)).astype(np.int64)
        firsts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        n = len(self.ids)
        packed = [c.astype("<i4").tobytes() for c in np.split(codes, np.cumsum(lengths)[:-1])]
        rows = np.array(self.rows)
        none = [pa.nulls(n, t) for t in (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())]
        names = [c.split()[0] for c in FOUND.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([self.number] * n, pa.int64()), pa.array(self.ids, pa.int64()), *(pa.array(rows[:, i]) for i in range(4)),
                                          pa.array(self.digests, pa.string()), pa.array(packed, pa.binary()), *none], names=names)
        ends = pa.array([0, len(pairs)], pa.int32())
        one = [pa.ListArray.from_arrays(ends, pa.array(pairs)), pa.ListArray.from_arrays(ends, pa.array(counts)),
               pa.array([of_chunks.astype("<i4").tobytes()], pa.binary()), pa.array([firsts.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string()),
                                          pa.nulls(1, pa.binary()), *one], names=names)


def align_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, pieces: bytes, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> the rows of ``FOUND``; a block ends after ``block_bytes`` of text, or after one text that is longer."""
    aligner, number = _loaded(vocabulary, pieces), TaskContext.get().partitionId() << 32
    block = Block(number)
    for batch in slices(batches, 1, 1 << 20):
        block.add(aligner, batch.column(0), batch.column(1).to_pylist())
        if block.bytes >= block_bytes:
            yield from block.batches(aligner)
            number += 1
            block = Block(number)
            if aligner.held > MEMO_BYTES:
                aligner.forget()
    if block.ids:
        yield from block.batches(aligner)


def sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's texts and the corpus-wide figures of its id pairs -> a row per text."""
    is_doc = left.column("chunks").is_valid()
    docs, own = left.filter(is_doc), left.filter(left.column("of_chunks").is_valid())
    of_chunks = np.frombuffer(own.column("of_chunks")[0].as_py(), "<i4")
    firsts = np.frombuffer(own.column("firsts")[0].as_py(), "<i8")
    at = right.column("at").to_numpy()
    total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    total[at], best[at] = right.column("total").to_numpy(), right.column("best").to_numpy()
    running = [np.concatenate(([0], np.cumsum(x[of_chunks]))) for x in (total, best)]
    per_chunk = [x[firsts[1:]] - x[firsts[:-1]] for x in running]
    out: list[list[int]] = [[], []]
    for chunks in docs.column("chunks").to_pylist():
        codes = np.frombuffer(chunks, "<i4")
        for x, to in zip(per_chunk, out):
            to.append(int(x[codes].sum()))
    return pa.table({"doc_id": docs.column("doc_id"), **{c: docs.column(c) for c in COLUMNS}, "n_best": pa.array(out[1], pa.int64()),
                     "count_sum": pa.array(out[0], pa.int64()), "groups_sha256": docs.column("groups_sha256")})


def align_texts(docs: DataFrame, vocabulary_path: str | None = None, model_path: str | None = None, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs).

    ``texts``: ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row of ``docs`` (``doc_id``, ``text``).
    ``pairs``: ``(a_id, b_id, total, best)``: how many links hold an id pair, and whether no other pair of ``b_id`` has more.

    Texts that are null, empty, not UTF-8, or that one side does not give back byte by byte, have no tokens: zeros and ''.
    Repeated rows stay and count each; a row without a doc_id keeps its null.  An empty table gives empty results.  Other
    columns are not read.  ``total`` needs a row per id pair, which the two vocabularies bound.
    """
    with open(vocabulary_path or default_vocabulary(), encoding="utf-8") as f:
        vocabulary = f.read()
    pieces = read_model(model_path)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), utf8("text").alias("text"))
    found = stash(rows.mapInArrow(lambda batches: align_batches(batches, vocabulary, pieces, block_bytes), FOUND), "aligned")
    b_size = piece_count(pieces)
    own = found.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "x")).select("block", "at", "x.pairs", "x.counts")
    totals = own.groupBy("pairs").agg(F.sum("counts").alias("total")).withColumn("b_id", F.col("pairs") % b_size)
    totals = stash(totals, "aligned-pairs")
    highest = totals.groupBy("b_id").agg(F.max("total").alias("highest"))
    judged = totals.join(highest, "b_id").select("pairs", "total", (F.col("total") == F.col("highest")).cast("bigint").alias("best"))
    told = own.select(F.col("block").alias("of_block"), "at", "pairs").join(judged, "pairs").select("of_block", "at", "total", "best")
    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    texts = found.select("block", "doc_id", *COLUMNS, "groups_sha256", "chunks", "of_chunks", "firsts").groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(sums, shape)
    return texts, judged.select(F.floor(F.col("pairs") / b_size).alias("a_id"), (F.col("pairs") % b_size).alias("b_id"), "total", (F.col("best") == 1).alias("best"))
