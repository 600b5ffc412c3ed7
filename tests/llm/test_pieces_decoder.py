from tokenizers import decoders

from crawlwright.llm import pieces


def test_round_trip_stands_on_the_decoder():
    """With a wrong decoder no text comes back; a check that skips the tokenizer's decoder would not see it."""
    tokenizer = pieces.rebuild(pieces.read_model(None))
    raw = [t.encode() for t in ("a  b", " lead", "é日本\U0001F600", "")]
    ids = [e.ids for e in tokenizer.encode_batch_fast([t.decode() for t in raw], add_special_tokens=False)]
    assert pieces.round_trips(tokenizer, ids, raw) == [True] * 4
    tokenizer.decoder = decoders.Replace("▁", "?")
    assert pieces.round_trips(tokenizer, ids, raw) == [False, False, False, True]


def test_markers_once_a_text():
    """Both orders of the decoder give the same text for whatever was encoded; only ids made by hand can spell a marker in bytes."""
    model = pieces.read_model(None)
    plain, quick = pieces.rebuild(model), pieces.rebuild(model, own_ids=True)
    texts = ["▁", "a▁b ▁▁c", "x ᚠᚢ é日本\U0001F600", " lead", "  two  ", "\u2580\u2582 \u2581\u2583", "<0xE2><0x96><0x81>", "", "end ", "ᚠ" * 3000]
    for ids in (e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)):
        assert plain.decode(ids, skip_special_tokens=False) == quick.decode(ids, skip_special_tokens=False)
    spelled = [plain.token_to_id(f"<0x{b:02X}>") for b in "a▁".encode()]
    assert plain.decode(spelled, skip_special_tokens=False) == "a▁"


def test_repeated_rows(spark):
    """Copies get equal rows, whether remembered or not, and with ids of their own."""
    rows = [(i % 7, ["one text", "another é", None, "", "▁"][i % 5]) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for keep in (False, True):
        got = pieces.encode_texts(df, keep_ids=keep).select("text", "pieces.*").collect()
        assert len(got) == 500 and len({str(r) for r in got}) == 5
        want = {t: pieces.encode_texts(df.where(df.text.eqNullSafe(t)).limit(1), keep_ids=keep).select("pieces.*").first() for t in (r[1] for r in rows[:5])}
        assert all(tuple(r)[1:] == tuple(want[r.text]) for r in got)
