import sentencepiece
import test_decontaminate
import test_simhash
import test_substrings

import corpus_pipeline
from crawlwright.llm import pieces, quality


def test_every_stage_like_brute_force(spark, sf):
    """Each stage on all that its predecessor kept, against a plain walk of its rule."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.select("doc_id", quality.grade_of(labels).alias("grade")))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        after = {r["doc_id"]: r for r in out.collect()}
        if i < 4:
            assert out.columns == columns
        rows = [(d, r["text"]) for d, r in before.items()]
        if i == 0:
            found = {d: quality.features(t or "") for d, t in rows}
            tails = {d: float(model.tails((model.weights[at] @ x).reshape(1))[0, 0]) for d, (at, x) in found.items()}
            assert set(after) == {d for d, p in tails.items() if p >= 0.5} and 0 < len(after) < len(before)
            bad = {r["doc_id"] for r in labels.where("quality = 0").collect()} & set(before)
            good = {r["doc_id"] for r in labels.where("quality = 1").collect()} & set(before)
            assert len(bad & set(after)) <= 0.1 * len(bad) and len(good - set(after)) <= 0.02 * len(good)
        elif i == 1:
            fps = [(d, d, test_simhash.slow_fingerprint(t)) for d, t in rows]
            assert set(after) == {d for (d, _, _), c in zip(fps, test_simhash.slow_components(fps)) if d == c}
        elif i == 2:
            want = {d: (n, gone) for d, n, gone, _ in test_substrings.slow(rows)}
            assert set(after) == set(before)
            for d, r in after.items():
                n, gone = want[d]
                assert len(r["text"].encode().split()) == n - gone and r["n_chars"] == len(r["text"])
                assert gone or r["text"] == before[d]["text"]
        elif i == 3:
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {r[0] for r in test_decontaminate.slow(rows, items) if not r[5]}
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
            assert set(after) == set(before)
            assert all(r["ids"] == sp.encode(before[d]["text"]) and r["round_trip"] and r["parity"] for d, r in after.items())
        docs = spark.createDataFrame(list(after.values()), out.schema)


def test_run_and_empty(spark, sf, tmp_path):
    import shutil
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "ids" in out.columns
    for t in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{t}.parquet", tmp_path)
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
