import hashlib

import numpy as np
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from crawlwright.llm import pieces

ODD = [None, "", " ", "a  b", "   lead", "trail   ", "x\n\n\ty", "é日本\U0001F600\x00", "<s> </s><unk> <0x0A>", "a" * 5000 + " " * 33 + "b",
       "Ünï " * 20_000, "aé" * 40]


def test_like_the_library(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()] + list(enumerate(ODD, 10_000))
    df = spark.createDataFrame([(d, t, "old", 1) for d, t in rows], "doc_id bigint, text string, pieces string, ids int")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    out = {r["doc_id"]: r for r in pieces.encode_texts(df).collect()}
    for d, t in rows:
        want, got = sp.encode(t or ""), out[d]["pieces"]
        assert got["ids"] == want and got["n_pieces"] == len(want) and got["parity"] and got["round_trip"], (d, t)
        assert got["ids_sha256"] == hashlib.sha256(np.array(want, "<i4").tobytes()).hexdigest()
        assert out[d]["text"] == t and out[d]["ids"] == 1
    back = pieces.decode_ids(pieces.encode_texts(df.select("doc_id", "text")).select("doc_id", "text", "pieces.ids"))
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())


def test_marker_in_text_and_empty(spark):
    df = spark.createDataFrame([(1, "▁ x")], "doc_id bigint, text string")
    row = pieces.encode_texts(df, keep_ids=False).first()["pieces"]
    assert row["parity"] and not row["round_trip"] and row["ids"] is None
    assert pieces.encode_texts(df.limit(0)).count() == 0


def test_unigram_model():
    """A model written by hand: scores, byte fallback and white-space rules of the unigram kind."""
    proto = pb.ModelProto()
    proto.trainer_spec.model_type = pieces.UNIGRAM
    proto.trainer_spec.byte_fallback = True
    proto.trainer_spec.vocab_size = 0
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{b:02X}>", 0, 6) for b in range(256)], ("▁", -2, 1),
                               ("▁a", -2.5, 1), ("a", -3, 1), ("b", -3.25, 1), ("ab", -4.1, 1), ("▁ab", -3.3, 1), ("ba", -4.7, 1), ("abab", -9, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.normalizer_spec.name = "identity"
    for squeeze in (False, True):
        proto.normalizer_spec.remove_extra_whitespaces = squeeze
        model = proto.SerializeToString()
        sp, ours = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.rebuild(model)
        for text in ("abab", "a b", "ba  ab", "aé b", " ab", "bbabab abba"):
            assert ours.encode(text).ids == sp.encode(text), (squeeze, text)
