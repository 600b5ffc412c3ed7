"""A training corpus from ``documents``: quality, near copies, repeated passages, benchmark leaks, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlwright.llm import decontaminate, pieces, quality, simhash, substrings
from crawlwright.llm.common import stash, table


def good_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is fair or better with a probability of one half or more (op 8)."""
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.select("doc_id", quality.grade_of(labels).alias("grade")))
    return quality.score(docs, model).where("quality_score.kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (op 10)."""
    return simhash.drop_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds (op 7); a document that loses all words keeps its row."""
    out = substrings.dedup_substrings(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark (op 6)."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids (op 4)."""
    out = pieces.encode_texts(docs)
    return out.select(*[c for c in docs.columns if c != "pieces"], "pieces.n_pieces", "pieces.ids_sha256", "pieces.parity", "pieces.round_trip",
                      "pieces.ids")


STAGES = [("quality classifier", good_enough), ("SimHash near-dedup", one_of_each), ("substring dedup", without_repeats),
          ("benchmark decontamination", without_benchmarks), ("SentencePiece encoding and decoding", as_pieces)]

ORACLE_SQL = None  # a fitted classifier, XXH64 fingerprints and a tokenizer are beyond SQL; tests/llm/test_pipeline.py walks the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, name.lower().replace(" ", "-"))
    return docs
