"""Query: dead links with misspelt words and the live pages that they mean."""

from pyspark.sql import functions as F

from crawlwright import constants as K
from crawlwright.operators import suggest as S
from crawlwright.plans import duck as D
from crawlwright.plans.duck import view
from crawlwright.plans.registry import query
from crawlwright.sources.tables import read_table

DEAD = 1 << 40


def misspelt_audit(spark, d):
    """Every document is a live page named by three long words of its text, and a dead link that lacks the last letter of each."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,12}"), F.lit(0)), 1, 3)
    kind = F.when(F.col("doc_id") % 4 == 0, "category").otherwise("product")
    pages = read_table(spark, d, "documents").select(F.col("source").alias("site"), "doc_id", words.alias("w"), kind.alias("kind")).where("size(w) > 1")
    address = lambda folder, w: F.concat(F.lit("https://"), F.col("site"), F.lit(".example.com/"), folder, F.lit("/"), F.array_join(w, "-"))
    live = pages.select("site", F.col("doc_id").alias("seq"), address(F.when(F.col("kind") == "product", "products").otherwise("categories"), F.col("w")).alias("url"),
                        F.col("kind").alias("page_type"), F.col("kind").alias("link_type"), F.lit(True).alias("available"), F.lit("ok").alias("fetch_code"))
    cut = F.transform("w", lambda x: F.substr(x, F.lit(1), F.char_length(x) - 1))
    dead = pages.select("site", (F.col("doc_id") + DEAD).alias("seq"), address(F.lit("products"), cut).alias("url"), F.lit("broken").alias("page_type"),
                        F.lit("product").alias("link_type"), F.lit(False).alias("available"), F.lit("http_404").alias("fetch_code"))
    rest = {"display_name": F.lit(""), "chain": F.lit(""), "final_url": F.lit(""), "indexable": F.lit(True)}
    return live.unionByName(dead).withColumns(rest)


_STOP, _VARIANTS = D.lst(K.PATH_STOP_WORDS), D.lst(S.VARIANTS)
view("spell_words", """SELECT * FROM (SELECT source AS site, doc_id AS seq, CASE WHEN doc_id % 4 = 0 THEN 'category' ELSE 'product' END AS kind,
    regexp_extract_all(lower(text), '[a-z]{6,12}')[1:3] AS w FROM documents) WHERE len(w) > 1""")
view("spell_live", f"""SELECT site, seq, kind, 'https://' || site || '.example.com/' || CASE kind WHEN 'product' THEN 'products/' ELSE 'categories/' END
    || array_to_string(w, '-') AS url, list_sort(list_filter(list_distinct(w), lambda t: NOT list_contains({_STOP}, t))) AS toks FROM spell_words""")
view("spell_common", """SELECT site, list(t) AS common FROM (SELECT site, t, count(*) AS k FROM (SELECT site, unnest(toks) AS t FROM spell_live) GROUP BY 1, 2)
    JOIN (SELECT site, count(*) AS n FROM spell_live GROUP BY 1) USING (site) WHERE k > greatest(3, n * 0.33) GROUP BY 1""")
view("spell_ask", f"""SELECT *, CASE WHEN len(core) > 0 THEN core ELSE want END AS base FROM (
    SELECT *, list_filter(want, lambda t: NOT list_contains({_VARIANTS}, t)) AS core FROM (
      SELECT s.site, seq + {DEAD} AS seq, list_sort(list_distinct(cut)) AS phrase,
        list_filter(list_distinct(cut), lambda t: NOT list_contains({_STOP}, t) AND NOT list_contains(coalesce(common, []), t)) AS want
      FROM (SELECT *, list_transform(w, lambda x: x[1:len(x) - 1]) AS cut FROM spell_words) s LEFT JOIN spell_common USING (site))) WHERE len(want) > 0""")
view("spell_met", f"""SELECT *, hit::DOUBLE / len(base) AS score,
      len(list_intersect(list_filter(want, lambda t: list_contains({_VARIANTS}, t)), ct)) AS vhit
    FROM (SELECT a.*, c.seq AS cseq, c.url, c.kind, ct, len(list_intersect(a.base, ct)) AS hit FROM spell_ask a JOIN (
      SELECT p.*, list_filter(toks, lambda t: NOT list_contains(coalesce(common, []), t)) AS ct FROM spell_live p LEFT JOIN spell_common USING (site)) c
      ON c.site = a.site) WHERE hit > 0""")
view("spell_pairs", """SELECT *, len(array_to_string(sect, ' ')) AS ls, array_to_string(only_a, ' ') AS sa, array_to_string(only_b, ' ') AS sb FROM (
    SELECT a.site, a.seq, c.seq AS cseq, c.url, list_intersect(phrase, toks) AS sect, list_filter(phrase, lambda t: NOT list_contains(toks, t)) AS only_a,
      list_filter(toks, lambda t: NOT list_contains(phrase, t)) AS only_b
    FROM (SELECT * FROM spell_ask x WHERE NOT EXISTS (SELECT 1 FROM spell_met y WHERE y.site = x.site AND y.seq = x.seq)) a
    JOIN spell_live c ON c.site = a.site AND len(c.toks) > 0)""")
# longest common subsequence by bits: a row of ones, one step per letter of the second string
_MASK = "list_sum(list_transform(range(1, len(sa) + 1), lambda i: CASE WHEN sa[i] = c THEN 1::HUGEINT << (i - 1)::INTEGER ELSE 0::HUGEINT END))::HUGEINT"
view("spell_lcs", f"""SELECT *, len(sa) - bit_count(CASE WHEN sa = '' OR sb = '' THEN ones ELSE list_reduce([ones] || list_transform(string_split(sb, ''), lambda c: {_MASK}),
      lambda r, m: ((r + (r & m)) | (r - (r & m))) & ones) END) AS lcs
    FROM (SELECT *, (1::HUGEINT << len(sa)::INTEGER) - 1 AS ones FROM spell_pairs)""")
view("spell_scored", """SELECT *, CASE WHEN ls > 0 AND (sa = '' OR sb = '') THEN 100.0::DOUBLE ELSE greatest(
      100 - 100 * (len(sa) + len(sb) - 2 * lcs)::DOUBLE / (2 * (ls + gap) + len(sa) + len(sb)),
      CASE WHEN ls > 0 THEN 100 - 100 * (1 + len(sa))::DOUBLE / (2 * ls + 1 + len(sa)) ELSE 0 END,
      CASE WHEN ls > 0 THEN 100 - 100 * (1 + len(sb))::DOUBLE / (2 * ls + 1 + len(sb)) ELSE 0 END) END AS score
    FROM (SELECT *, CASE WHEN ls > 0 THEN 1 ELSE 0 END AS gap FROM spell_lcs)""")


@query("i4_suggest_with_spelling", """SELECT site, seq, url AS suggested_url, CASE WHEN hit >= 2 AND score >= 0.75 THEN 'high' ELSE 'medium' END AS suggestion_conf
    FROM (SELECT *, row_number() OVER (PARTITION BY site, seq ORDER BY score DESC, hit DESC, vhit DESC, CASE kind WHEN 'product' THEN 0 ELSE 1 END, cseq) AS rn FROM spell_met)
    WHERE rn = 1 AND ((hit >= 2 AND score >= 0.5) OR (len(want) = 1 AND hit = 1 AND kind = 'category'))
    UNION ALL
    SELECT site, seq, url, 'medium' FROM (SELECT *, row_number() OVER (PARTITION BY site, seq ORDER BY score DESC, cseq) AS rn FROM spell_scored) WHERE rn = 1 AND score >= 88""")
def _(spark, d):
    return S.suggest_alternatives(misspelt_audit(spark, d), spelling=True)
