"""Benchmark decontamination: find the word windows of a benchmark inside training documents.

The benchmark's normalised windows (13 words, or all words of a shorter item) form the hash set.  Documents are scanned once:
every position gives the words that a window starting there would have, as one string, and the join on that string is both
the lookup and the exact verification.  The set is broadcast if its measured size allows it and shuffled otherwise; the rows
that the join sends are the same.  Only column expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlwright.llm.common import lower_ascii

WINDOW = 13
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Runs of 0-9, a-z and characters beyond ASCII, after A-Z have been lower-cased; null has none."""
    low = lower_ascii(F.coalesce(text, F.lit("")))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(gram, n, items)``: every distinct window, its word count and the items that hold it."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(window))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    return (words.select("item", size.alias("n"), F.explode(F.array_distinct(grams)).alias("gram"))
            .groupBy("gram", "n").agg(F.collect_set("item").alias("items")))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, _text, at, n, items)``: the word positions of ``docs`` at which a benchmark window starts.

    ``_text`` tells rows with one doc_id but different texts apart.
    """
    grams = windows_of(benchmark, window)
    facts = grams.agg(F.sum(F.octet_length("gram") + 64 + 40 * F.size("items")).alias("bytes"), F.collect_set("n").alias("sizes")).first()
    sizes = sorted(facts["sizes"] or [window])  # window lengths: at most ``window`` of them
    words = docs.select("doc_id", F.xxhash64("text").alias("_text"), words_of(F.col("text")).alias("w"))

    def starting(n: int) -> Column:
        grams_at = lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("gram"))
        last = F.size("w") - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), grams_at)).otherwise(F.array())

    found = words.select("doc_id", "_text", F.inline(F.concat(*[starting(n) for n in sizes]) if len(sizes) > 1 else starting(sizes[0])))
    if (facts["bytes"] or 0) <= broadcast_bytes:
        grams = F.broadcast(grams)
    return found.join(grams, ["gram", "n"]).select("doc_id", "_text", "at", "n", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, contaminated)`` for every row of ``docs``.

    A document word inside any occurrence of a window is hit; ``items`` are the sorted ids of the items with an occurring
    window; ``contaminated`` holds if a word is hit and the hits are a twentieth of the words or more.  Null and empty texts
    have no words; items without words have no windows, and without any item nothing is contaminated.  Repeated rows and rows
    without a doc_id are judged each by its own text.  Items without an id count for hits but are not listed.
    """
    per_doc = (hits(docs, benchmark, window, broadcast_bytes).select("doc_id", "_text", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("p"),
                                                   "items")
               .groupBy("doc_id", "_text", "p").agg(F.flatten(F.collect_set("items")).alias("items"))
               .groupBy("doc_id", "_text").agg(F.count("*").alias("n_hit"), F.collect_set("items").alias("items"))
               .select(F.xxhash64("doc_id", "_text").alias("_key"), F.col("doc_id").alias("_doc"), "_text", "n_hit",
                       F.sort_array(F.array_distinct(F.flatten("items"))).alias("items")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_own"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    rows = rows.withColumn("_key", F.xxhash64("doc_id", "_own"))
    same = [F.col("l._key") == F.col("r._key"), F.col("l.doc_id").eqNullSafe(F.col("r._doc")), F.col("_own") == F.col("_text")]
    out = rows.alias("l").join(per_doc.alias("r"), same[0] & same[1] & same[2], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    marked = hits(docs, benchmark, window, broadcast_bytes)
    per_doc = (marked.select("doc_id", "_text", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("p"))
               .distinct().groupBy("doc_id", "_text").agg(F.count("*").alias("n_hit")).select(
                   F.xxhash64("doc_id", "_text").alias("_bad_key"), F.col("doc_id").alias("_bad_doc"), F.col("_text").alias("_bad_text"),
                   F.col("n_hit").alias("_bad_hits")))
    same = ((F.xxhash64(docs["doc_id"], F.xxhash64(docs["text"])) == F.col("_bad_key")) & docs["doc_id"].eqNullSafe(F.col("_bad_doc"))
            & (F.xxhash64(docs["text"]) == F.col("_bad_text")) & (20 * F.col("_bad_hits") >= F.size(words_of(docs["text"]))))
    return docs.join(per_doc, same, "left_anti")
