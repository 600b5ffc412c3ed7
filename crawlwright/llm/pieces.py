"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed on the driver and its bytes go to the tasks, so executors need no file.  Each worker rebuilds the
model once: normaliser (character map, extra white space, dummy prefix, the ▁ marker), unigram scores or BPE merges in score
order, byte fallback, and the decoder that undoes them.  Texts are encoded in batches of a bounded number of bytes, many
threads at a time, and every text's ids are compared with those of the sentencepiece library itself.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlwright.llm.common import slices, utf8

BATCH_BYTES = 1 << 20
REMEMBERED = 1 << 17
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER = 1, 2, 4


def default_model() -> str:
    """The public model on this machine; callers may name any other."""
    return os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def rebuild(model: bytes, own_ids: bool = False):
    """A ``tokenizers.Tokenizer`` with the behaviour of a serialised SentencePiece model.

    With ``own_ids`` it decodes what it has encoded and replaces markers once a text, not once a piece: no encoding spells a
    marker in byte pieces, so the order makes no difference.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    train, norm, pieces = proto.trainer_spec, proto.normalizer_spec, proto.pieces
    if train.model_type not in (UNIGRAM, BPE) or train.treat_whitespace_as_suffix:
        raise ValueError("only unigram and BPE models with a leading ▁ can be rebuilt")
    unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
    if train.model_type == UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in pieces], unk_id=unknown, byte_fallback=train.byte_fallback)
    else:
        ids = {p.piece: i for i, p in enumerate(pieces)}
        usable = {p.piece for p in pieces if p.type in (NORMAL, USER)}
        merges = [(-p.score, i, p.piece[:k], p.piece[k:]) for i, p in enumerate(pieces) if p.type == NORMAL
                  for k in range(1, len(p.piece)) if p.piece[:k] in usable and p.piece[k:] in usable]
        merges.sort(key=lambda m: (m[0], m[1], ids[m[2]], ids[m[3]]))
        core = models.BPE(ids, [(a, b) for *_, a, b in merges], unk_token=pieces[unknown].piece, fuse_unk=True,
                          byte_fallback=train.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(norm.precompiled_charsmap)] if norm.precompiled_charsmap else []
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend("▁")] if norm.add_dummy_prefix else []
    steps += [normalizers.Replace(" ", "▁")] if norm.escape_whitespaces else []
    out.normalizer = normalizers.Sequence(steps)
    out.add_tokens([AddedToken(p.piece, normalized=False) for p in pieces if p.type == USER])
    marks, joined = decoders.Replace("▁", " "), [decoders.ByteFallback(), decoders.Fuse()]
    undo = [*joined, marks] if own_ids and any(p.piece == "▁" for p in pieces) else [marks, *joined]
    out.decoder = decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if norm.add_dummy_prefix else []))
    return out


def read_model(path: str | None) -> bytes:
    with open(path or default_model(), "rb") as f:
        return f.read()


def round_trips(tokenizer, ids: list[list[int]], raw: list[bytes]) -> list[bool]:
    """Does decoding the ids give the bytes of the text?"""
    return [back.encode() == text for back, text in zip(tokenizer.decode_batch(ids, skip_special_tokens=False), raw)]


@lru_cache(maxsize=2)
def _loaded(model: bytes, own_ids: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    import sentencepiece
    return rebuild(model, own_ids), sentencepiece.SentencePieceProcessor(model_proto=model)


@lru_cache(maxsize=2)
def _known(model: bytes) -> dict[bytes, tuple[int, str, bool, bool]]:
    """What a worker remembers of texts, by 128-bit names: copies are encoded, compared and decoded once.  At most ``REMEMBERED``."""
    return {}


PIECES = T.StructType([T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                       T.StructField("parity", T.BooleanType()), T.StructField("round_trip", T.BooleanType()),
                       T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode_texts(docs: DataFrame, model_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """``docs`` with a column ``pieces``: struct of n_pieces, ids_sha256, parity, round_trip and ids.

    ``ids_sha256`` is over the ids as little-endian 32-bit numbers; ``parity`` tells whether sentencepiece gives the same ids
    and ``round_trip`` whether decoding the ids gives the text.  Should parity fail for a text, its ids are sentencepiece's.
    A null text is like an empty one: no pieces, no ids.  Bytes that are not UTF-8 are read as U+FFFD and fail the round trip.
    Whole texts are encoded; copies of a text are worked on once where a worker still knows them (by a 128-bit name).  All columns are kept (``pieces`` is replaced); ``ids`` is null without ``keep_ids``.
    """
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, reference = _loaded(model, own_ids=True)
        known = {} if keep_ids else _known(model)
        for batch in slices(batches, 0, BATCH_BYTES):
            if keep_ids or len(known) > REMEMBERED:
                known.clear()
            texts_of = batch.column(0).cast(pa.binary()).to_pylist()
            names = [xxhash.xxh3_128_digest(t or b"") for t in texts_of]
            fresh = {name: t or b"" for name, t in zip(names, texts_of) if name not in known}
            raw = list(fresh.values())
            texts = [t.decode("utf-8", "replace") for t in raw]
            ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            truth = reference.encode(texts, num_threads=1)
            same = [a == b for a, b in zip(ids, truth)]
            ids = truth if not all(same) else ids
            packed = [array("i", i) for i in ids]
            back = round_trips(tokenizer, ids, raw)
            known.update((name, (len(i), hashlib.sha256(i.tobytes()).hexdigest(), s, b)) for name, i, s, b in zip(fresh, packed, same, back))
            count, digest, parity, trip = ([*x] for x in zip(*map(known.__getitem__, names)))
            lists = pa.nulls(len(names), pa.list_(pa.int32()))
            if keep_ids:
                own = dict(zip(fresh, packed))
                flat = np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(own[name], np.int32) for name in names]])
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(count))).astype(np.int32), flat)
            pieces = pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(parity, pa.bool_()), pa.array(trip, pa.bool_()), lists],
                                                names=["n_pieces", "ids_sha256", "parity", "round_trip", "ids"])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pieces], names=[*batch.schema.names[1:], "pieces"])

    kept = [c for c in docs.columns if c != "pieces"]
    source = docs.select(utf8("text").alias("_pieces_of"), *kept)
    return source.mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], T.StructField("pieces", PIECES)]))


def decode_ids(docs: DataFrame, ids: str = "ids", model_path: str | None = None) -> DataFrame:
    """``docs`` with a column ``decoded``: the text of an array of ids; a null array gives null, an empty one ''."""
    model = read_model(model_path)

    @F.pandas_udf(T.StringType())
    def decode(column):
        import pandas as pd
        tokenizer, _ = _loaded(model)
        known = [i is not None for i in column]
        back = iter(tokenizer.decode_batch([[int(x) for x in i] for i in column if i is not None], skip_special_tokens=False))
        return pd.Series([next(back) if k else None for k in known])

    return docs.withColumn("decoded", decode(ids))
