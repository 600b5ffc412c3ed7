from crawlwright.llm import simhash


def test_shingle_length_is_a_parameter(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    for k in (3, 5):
        got = simhash.near_duplicates(df, words_per_shingle=k).first()["fingerprint"]
        assert got == f"{simhash.fingerprint(text.encode(), k):016x}"
    assert simhash.fingerprint(text.encode(), 3) != simhash.fingerprint(text.encode(), 5)
