"""the closest spelling of a phrase among live pages, as a set-similarity join.

The score of two word sets is 100 if one holds the other, else the best of three normalised indel similarities: of both joined
strings with the shared words first, and of the shared words with either side.  Only scores of ``LEAST`` or more count, which
bounds what two sets must share, so no phrase is compared with all pages:

* close strings: at most 12 % of both lengths differ, and an edit changes at most six letter triples of the two bags, so close
  phrases share many triples.  Blocks of phrases meet blocks of pages of similar length, one product of two matrices counts the
  shared triples of all pairs of a block, and what is left of them is compared letter by letter inside the task: rows leave a
  block for close pairs only;
* shared words that make up almost all of one side: one of that side's rarest words is among them.

The exact score is computed for the survivors of an upper bound alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LEAST = 88
DIFFER = 1 - LEAST / 100
RATIO = (1 + DIFFER) / (1 - DIFFER)  # of the lengths of two close strings
# a side whose shared words score LEAST alone: 1 + rest <= DIFFER * (2 * shared + 1 + rest)
REST = 2 * DIFFER / (1 + DIFFER)
BLOCK = 8192        # phrases or pages of a block
STRIP = 1024        # phrases compared at once: the counts of a strip take 32 MB
TRIPLES = 512       # columns of the triple matrices; triples that share one only raise a count
BETWEEN = "\x1f"    # words of one text on its way to a task


def indel_similarity(a: str, b: str) -> int:
    """Twice the length of the longest common subsequence, by bits of one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & where.get(c, 0)
        row = ((row + met) | (row - met)) & full
    return 2 * (len(a) - row.bit_count())


def set_ratio(a: list[str], b: list[str]) -> float:
    """0 to 100 for two sorted lists of distinct words."""
    mine, theirs = set(a), set(b)
    if not mine or not theirs:
        return 0.0
    shared, only_a, only_b = mine & theirs, " ".join(sorted(mine - theirs)), " ".join(sorted(theirs - mine))
    if shared and (not only_a or not only_b):
        return 100.0
    sect = len(" ".join(shared))
    gap = 1 if sect else 0
    both = 2 * (sect + gap) + len(only_a) + len(only_b)
    differ = len(only_a) + len(only_b) - indel_similarity(only_a, only_b)
    scores = [100 - 100 * differ / both]
    if sect:
        scores += [100 - 100 * (gap + len(o)) / (2 * sect + gap + len(o)) for o in (only_a, only_b)]
    return max(scores)


@F.pandas_udf(DoubleType())
def set_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([set_ratio(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")


def joined_length(words: Column) -> Column:
    return F.char_length(F.array_join(words, " "))


def length_class(length: Column) -> Column:
    return F.floor(F.log(F.greatest(length, F.lit(1))) / math.log(RATIO)).cast("int")


def ranked(sets: DataFrame, keys: list[str], values: Column, freq: DataFrame) -> DataFrame:
    """``keys`` with ``r``: the values of every set, rarest among the pages first, equal ones by name."""
    every = sets.select(*keys, F.explode(values).alias("v")).join(freq, ["site", "v"], "left")
    return every.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "v"))).alias("r"))


def frequencies(pages: DataFrame, values: Column) -> DataFrame:
    return pages.select("site", F.explode(values).alias("v")).groupBy("site", "v").agg(F.count("*").alias("df"))


def _triple_counts(texts: list[list[str]], names: dict[str, int]) -> np.ndarray:
    """Letter triples of every padded word, counted; two columns more hold what a close pair must share."""
    out = np.zeros((len(texts), TRIPLES + 2), np.float32)
    for row, words in zip(out, texts):
        for w in words:
            padded = f"##{w}##"
            for i in range(len(w) + 2):
                row[names.setdefault(padded[i:i + 3], len(names)) % TRIPLES] += 1
        # shared >= (all of both - 6 * edits) / 2, edits <= DIFFER * both lengths: a sum of one term a side
        row[TRIPLES] = 3 * DIFFER * len(" ".join(words)) - sum(len(w) + 2 for w in words) / 2
        row[TRIPLES + 1] = 1
    return out


def _letters(texts: list[str], names: dict[str, int]) -> np.ndarray:
    """Letter numbers by position; 0 is no letter."""
    out = np.zeros((len(texts), max(map(len, texts))), np.int32)
    for row, t in zip(out, texts):
        row[:len(t)] = [names.setdefault(c, len(names) + 1) for c in t]
    return out


def _word_numbers(texts: list[list[str]], names: dict[str, int], none: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), none, np.int32)
    for row, words in zip(out, texts):
        row[:len(words)] = [names.setdefault(w, len(names)) for w in words]
    return out


def close_pairs(a: list[list[str]], b: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of sorted word lists whose joined strings may be close: every pair that is, and with shared words or
    long strings some that are not."""
    triples: dict[str, int] = {}
    ta, tb = _triple_counts(a, triples), _triple_counts(b, triples)
    tb = tb[:, [*range(TRIPLES), TRIPLES + 1, TRIPLES]].T.copy()
    words: dict[str, int] = {}
    wa, wb = _word_numbers(a, words, -1), _word_numbers(b, words, -2)
    ja, jb = [" ".join(w) for w in a], [" ".join(w) for w in b]
    na, nb = np.array([len(t) for t in ja]), np.array([len(t) for t in jb])
    names: dict[str, int] = {}
    la, lb = _letters(ja, names), _letters(jb, names)
    short = na <= 64
    where = np.zeros((len(a), len(names) + 1), np.uint64)
    for p in range(min(64, la.shape[1])):
        has = la[:, p] > 0
        where[has, la[has, p]] |= np.uint64(1 << p)
    full = np.where(short, (np.uint64(1) << np.minimum(na, 63).astype(np.uint64)) - np.uint64(1), 0).astype(np.uint64)
    full[na >= 64] = np.uint64(2 ** 64 - 1)
    found = []
    for at in range(0, len(a), STRIP):
        i, j = np.nonzero(ta[at:at + STRIP] @ tb > -1e-2)
        i += at
        allowed = DIFFER * (na[i] + nb[j]) + 1e-9
        keep = np.abs(na[i] - nb[j]) <= allowed
        i, j, allowed = i[keep], j[keep], allowed[keep]
        free = short[i]
        for k in range(wa.shape[1]):
            for m in range(wb.shape[1]):
                free &= wa[i, k] != wb[j, m]
        # longest common subsequence by bits, a step per letter of the page's string, all pairs at once
        x, y = i[free], j[free]
        row = full[x]
        for p in range(lb.shape[1]):
            met = row & where[x, lb[y, p]]
            row = ((row + met) | (row - met)) & full[x]
        common = na[x] - np.bitwise_count(row).astype(np.int64)
        good = na[x] + nb[y] - 2 * common <= allowed[free]
        found.append((np.concatenate([i[~free], x[good]]), np.concatenate([j[~free], y[good]])))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _close_of_blocks(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
    if not len(mine) or not len(theirs):
        return pd.DataFrame({"site": [], "phrase": [], "toks": []}, dtype=str)
    i, j = close_pairs(*[[sorted(t.split(BETWEEN)) for t in texts] for texts in (mine["a"], theirs["b"])])
    return pd.DataFrame({"site": mine["site_a"].iloc[0], "phrase": mine["a"].to_numpy()[i], "toks": theirs["b"].to_numpy()[j]}, dtype=str)


def _blocks(sets: DataFrame, words: str, name: str) -> DataFrame:
    """``(site, size, name, text)``: the word sets of a site and length class, dealt into blocks by their hash."""
    sized = sets.select("site", length_class(joined_length(F.col(words))).alias("size"), F.array_join(words, BETWEEN).alias("text"))
    many = sized.groupBy("site", "size").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    return sized.join(many, ["site", "size"]).select("site", "size", F.pmod(F.xxhash64("text"), F.col("n")).alias(name), "text")


def close_strings(phrases: DataFrame, sets: DataFrame) -> DataFrame:
    """``(site, phrase, toks)`` for the pairs that ``close_pairs`` leaves, of neighbouring length classes."""
    from crawlwright.session import spread

    a, b = _blocks(phrases, "phrase", "mine"), _blocks(sets, "toks", "theirs")
    a = a.withColumn("near", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: s + F.col("size"))))
    meet = (a.select("site", "size", "mine", "near").distinct()
            .join(b.select("site", F.col("size").alias("near"), "theirs").distinct(), ["site", "near"]))
    pair = F.concat_ws(" ", "size", "mine", "near", "theirs")
    left = a.join(meet, ["site", "size", "mine", "near"]).select(F.col("site").alias("site_a"), pair.alias("pair_a"), F.col("text").alias("a"))
    right = (b.withColumnRenamed("size", "near").join(meet, ["site", "near", "theirs"])
             .select(F.col("site").alias("site_b"), pair.alias("pair_b"), F.col("text").alias("b")))
    # few bytes but much work: the blocks are dealt out by number, not by size
    left, right = spread(left, "site_a", "pair_a"), spread(right, "site_b", "pair_b")
    pairs = left.groupBy("site_a", "pair_a").cogroup(right.groupBy("site_b", "pair_b")).applyInPandas(
        _close_of_blocks, "site string, phrase string, toks string")
    return pairs.select("site", F.split("phrase", BETWEEN).alias("phrase"), F.split("toks", BETWEEN).alias("toks"))


def _rarest_words(words: str) -> Column:
    """The first words, by rarity, of which the shared words cannot lack all."""
    most = REST * joined_length(F.col(words))
    before = F.transform("r", lambda x, i: F.aggregate(F.slice("r", F.lit(1), i), F.lit(0), lambda n, y: n + F.char_length(y["v"])))
    kept = F.filter(F.arrays_zip(F.col("r").alias("r"), before.alias("n")), lambda x: x["n"] <= most + 1e-9)
    return F.transform(kept, lambda x: x["r"])


def closest_spelling(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """``asked`` (site, phrase, allowed: sorted words, page types) -> those with a page (site, ctype, seq, url, toks) at ``LEAST`` or
    more: ``suggested_url`` of the highest score, the first page of several.  Empty word sets match nothing."""
    from crawlwright.session import cut

    offers = pages.where(F.size("toks") > 0).groupBy("site", "ctype", "toks").agg(F.min_by("url", "seq").alias("url"), F.min("seq").alias("seq"))
    # both are read several times below
    sets, phrases = cut(offers.select("site", "toks").distinct()), cut(asked.where(F.size("phrase") > 0).select("site", "phrase").distinct())
    mine, theirs = ["site", "phrase"], ["site", "toks"]

    close = close_strings(phrases, sets)

    w_freq = frequencies(sets, F.col("toks"))
    a_words, b_words = phrases.select(*mine, F.explode("phrase").alias("v")), sets.select(*theirs, F.explode("toks").alias("v"))
    a_rare = ranked(phrases, mine, F.col("phrase"), w_freq).select(*mine, F.explode(_rarest_words("phrase")).alias("p")).select(*mine, F.col("p.v").alias("v"))
    b_rare = ranked(sets, theirs, F.col("toks"), w_freq).select(*theirs, F.explode(_rarest_words("toks")).alias("p")).select(*theirs, F.col("p.v").alias("v"))
    held = a_rare.join(b_words, ["site", "v"]).unionByName(a_words.join(b_rare, ["site", "v"])).select(*mine, "toks")

    pairs = close.unionByName(held).distinct()
    la, lb = joined_length(F.col("phrase")), joined_length(F.col("toks"))
    shared = joined_length(F.array_intersect("phrase", "toks"))
    near = F.abs(la - lb) <= DIFFER * (la + lb) + 1e-9
    alone = lambda length: length - shared <= DIFFER * (length + shared) + 1e-9
    scored = pairs.where(near | ((shared > 0) & (alone(la) | alone(lb)))).withColumn("score", set_ratios("phrase", "toks")).where(F.col("score") >= LEAST)
    return asked.join(scored, mine).join(offers, theirs).where(F.array_contains("allowed", F.col("ctype"))).groupBy(*mine, "allowed").agg(
        F.min_by("url", F.struct((-F.col("score")).alias("s"), "seq")).alias("suggested_url"))
