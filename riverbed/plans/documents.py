"""Queries over documents, pages, vectors, labels and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.functions import text as text_
from riverbed.operators import changes, latest, search, similarity
from riverbed.plans.registry import Tables, query
from riverbed.sources import html


def titled(t: Tables) -> DataFrame:
    """Documents with their first line as title and the rest as body."""
    cut = F.instr("text", "\n")
    title = F.when(cut > 0, F.substring(F.col("text"), F.lit(1), cut - 1)).otherwise(F.col("text"))
    body = F.when(cut > 0, F.substring(F.col("text"), cut + 1, F.length("text"))).otherwise(F.lit(""))
    return t.documents.select("doc_id", "source", "lang", "n_chars", title.alias("title"), body.alias("body"))


_TITLED = """d AS (SELECT doc_id, source, lang, n_chars, CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title,
  CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, instr(text, chr(10)) + 1) ELSE '' END AS body FROM documents)"""


@query(f"""WITH {_TITLED} SELECT doc_id, CAST((CASE WHEN contains(lower(title), 'the') THEN 9 ELSE 0 END) + (CASE WHEN contains(lower(body), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(title), 'tion') THEN 9 ELSE 0 END) + (CASE WHEN contains(lower(body), 'tion') THEN 1 ELSE 0 END) AS INTEGER) AS points
FROM d WHERE (contains(lower(title), 'the') OR contains(lower(body), 'the')) AND (contains(lower(title), 'tion') OR contains(lower(body), 'tion'))""")
def search_relevance(t: Tables) -> DataFrame:
    return search.relevance(titled(t), search.terms_of("The tion")).select("doc_id", "points")


@query("""SELECT doc_id FROM documents WHERE regexp_matches(regexp_replace(text, 'other', ' ', 'gi'), '(^|[^a-zA-Z])the([^a-zA-Z]|$)', 'i')""")
def guarded_match(t: Tables) -> DataFrame:
    return t.documents.filter(search.guarded(F.col("text"), "the", ["other"])).select("doc_id")


@query("""SELECT source, lang, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY 1, 2""")
def source_facets(t: Tables) -> DataFrame:
    return search.facets(t.documents.filter("n_chars > 500"), "source", "lang")


@query(f"""WITH {_TITLED} SELECT lower(title) AS title, count(*) AS copies, min(doc_id) AS first, count(DISTINCT source) AS sources FROM d WHERE length(title) >= 8 GROUP BY 1 HAVING count(*) > 1""")
def title_copies(t: Tables) -> DataFrame:
    return titled(t).filter(F.length("title") >= 8).groupBy(F.lower("title").alias("title")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"), F.count_distinct("source").alias("sources")).filter("copies > 1")


@query(rf"""WITH {_TITLED}, k AS (SELECT doc_id, source, lang, substring(regexp_replace(lower(coalesce(title, '')), '[^\p{{L}}\p{{N}}]', '', 'g'), 1, 300) AS title FROM d),
n AS (SELECT source, lang, title, min(doc_id) AS id FROM k WHERE length(title) > 1 GROUP BY 1, 2, 3),
g AS (SELECT *, list_distinct(list_transform(generate_series(1, length(title) - 1), lambda i: substring(title, i, 2))) AS grams FROM n),
p AS (SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.grams, y.grams)) / len(list_distinct(list_concat(x.grams, y.grams))), 6) AS score FROM g x JOIN g y ON x.source = y.source AND x.lang = y.lang AND x.id < y.id)
SELECT a, b, score FROM p WHERE score >= 0.6""")
def bigram_pairs(t: Tables) -> DataFrame:
    return similarity.title_pairs(titled(t).select(F.col("doc_id").alias("id"), "source", "lang", "title"), ["source", "lang"], 0.6)


@query()
def simhash_pairs(t: Tables) -> DataFrame:
    return similarity.near_fingerprints(t.documents.select(F.col("doc_id").alias("id"), text_.simhash64_once_udf("text").alias("fp")))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.id AS query, v.id AS id, round(list_cosine_similarity(q.v, v.v), 6) AS score FROM v q, v WHERE q.id % 100 = 0 AND q.id <> v.id)
SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.1) WHERE rank <= 10""")
def cosine_topk(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.nearest(vectors, vectors.filter("id % 100 = 0"), k=10, least=0.1)


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '[?&](page=[0-9]+)', 1) AS page FROM pages)
SELECT page_id, 'https://' || regexp_replace(regexp_replace(lower(host), '^www\.', ''), ':(80|443)$', '') || CASE WHEN page = '' AND path <> '/' THEN regexp_replace(path, '/$', '') ELSE path END || CASE WHEN page <> '' THEN '?' || page ELSE '' END AS identity FROM p""")
def url_identity(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text_.normalize_url_udf("url").alias("identity"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS path FROM pages)
SELECT path, count(*) AS links, count(DISTINCT page_id) AS pages FROM l GROUP BY 1""")
def link_pairs(t: Tables) -> DataFrame:
    return html.links(t.pages).filter("href like '/%'").groupBy(F.col("href").alias("path")).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("page_id").alias("pages"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\+?[0-9][0-9() -]{7,}[0-9]', '[phone]', 'g'), '(https?://[^ ?]+)\?[^ ]*', '\1', 'g') AS text FROM documents""")
def pii_mask(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text_.mask_personal(F.col("text")).alias("text"))


@query(r"""WITH m AS (SELECT conv_id, turn, role, sha256(trim(regexp_replace(coalesce(role, ''), '\s+', ' ', 'g')) || chr(1) || trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS content_hash FROM conversations),
f AS (SELECT *, coalesce(lag(content_hash) OVER (PARTITION BY conv_id ORDER BY turn) = content_hash, false) AS same FROM m)
SELECT conv_id, turn, role, content_hash, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS revision FROM f WHERE NOT same""")
def content_revisions(t: Tables) -> DataFrame:
    return changes.revisions(t.conversations, "conv_id", [F.asc("turn")], "role", "text").select("conv_id", "turn", "role", "content_hash", "revision")


@query("""SELECT source, count(*) AS documents, count(quality) AS labelled, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, round(avg(quality), 6) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def label_agreement(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.avg("quality"), 6).alias("share"))


@query("""SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 5""")
def longest_by_language(t: Tables) -> DataFrame:
    return latest.first_per_key(t.documents.select("lang", "doc_id", "n_chars"), ["lang"], 5, F.desc("n_chars"), F.asc("doc_id"))


@query("""SELECT sha256(text) AS content, min(doc_id) AS first, count(*) AS copies, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_copies(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("content")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.count_distinct("source").alias("sources")).filter("copies > 1")


@query()
def page_text(t: Tables) -> DataFrame:
    return html.readable(t.pages)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS paid, CAST(l_quantity AS INTEGER) AS n FROM lineitem),
p AS (SELECT *, CAST(power(10, greatest(length(CAST(paid AS VARCHAR)) - 3, 0)) AS BIGINT) AS step FROM l)
SELECT l_orderkey, l_linenumber, 'usd:' || ((2 * paid + step) // (2 * step) * step) AS amount FROM p UNION ALL SELECT l_orderkey, l_linenumber, 't:' || (n * 1000000) FROM p""")
def key_amounts(t: Tables) -> DataFrame:
    said = F.concat(F.lit("Paid US$"), F.floor("l_extendedprice").cast("string"), F.lit(" in 1996 for "), F.col("l_quantity").cast("int").cast("string"), F.lit(" million tonnes"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.explode(text_.key_amounts_udf(said)).alias("amount"))


@query()
def document_amounts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(text_.key_amounts_udf("text")).alias("amount"))
