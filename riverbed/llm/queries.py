"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm.common import cut, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.chunk_dedup import dedup_chunks

    return dedup_chunks(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), limit=2048)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.line_dedup import dedup_lines

    lines = dedup_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.warc import read_archives, write_archives

    return read_archives(cut(write_archives(table(spark, sf_dir, "pages")), "warc"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.quality_rules import quality_rules

    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.quality_classifier import classify, fit, held_out

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, fit(docs, labels.filter(~held_out(F.col("doc_id")))))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.prefix_trie import prefix_trie, rebuilt

    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.cross_polytope import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riverbed.llm.codebooks import compress

    return compress(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), s AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM s
"""


#: The bucket of an n-gram is crc32 of its UTF-8 bytes modulo 16384; the table is made by
#: the polynomial's rule.
OP8_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) t(i)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM d
), hexed AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM g)), b AS (
  SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, tab[1 + xor(c % 256, x)])), 4294967295) % 16384 AS bucket FROM hexed, crc
), t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), gb AS (
  SELECT g.r, b.bucket, CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM g JOIN b USING (gram) LEFT JOIN t ON t.doc_id = g.doc_id
), c AS (SELECT bucket, count(*) AS raw, sum(hit) AS target FROM gb GROUP BY 1), tot AS (SELECT sum(raw) AS raws, sum(target) AS targets FROM c), wt AS (
  SELECT bucket, CASE WHEN targets > 0 THEN CAST(round((ln((target + 1.0) / (targets + 16384.0)) - ln((raw + 1.0) / (raws + 16384.0))) * 10000) AS BIGINT) ELSE 0 END AS weight FROM c, tot
), sc AS (SELECT r, sum(weight) AS total FROM gb JOIN wt USING (bucket) GROUP BY 1), win AS (
  SELECT r, p, array_to_string(w[p:p + 4], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d)
), rep AS (SELECT r, p FROM (SELECT *, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1), cov AS (
  SELECT r, count(DISTINCT p + k) AS n FROM rep, range(5) q(k) GROUP BY 1
), ln AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(total, 0) AS total
  FROM d LEFT JOIN ln USING (r) LEFT JOIN cov USING (r) LEFT JOIN sc USING (r)
), f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND total >= -7000 * greatest(2 * n_words - 1, 0) AS kept FROM f
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

_CRC_TABLE = "SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)"

OP11_SQL = f"""
WITH crc AS ({_CRC_TABLE}), t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({{'s': md5(length(role)::VARCHAR || ':' || role || text), 'n': length(text)::BIGINT}} ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) AS ts FROM t GROUP BY 1
), hd AS (
  SELECT c, ts, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(c::VARCHAR)), lambda k: ascii(substr(c::VARCHAR, CAST(k + 1 AS BIGINT), 1))::BIGINT)),
    lambda a, x: xor(a >> 8, tab[1 + xor(a % 256, x)])), 4294967295) % 6 AS h FROM own, crc
), r AS (SELECT hd.c, list_concat(coalesce(b.ts[1:h], []), hd.ts[h + 1:]) AS ts FROM hd LEFT JOIN own b ON b.c = hd.c - hd.c % 100), p AS (
  SELECT c, d, len(ts) AS size, list_transform(ts[1:d], lambda x: x.s) AS k, CASE WHEN d > 0 THEN ts[d].n ELSE 0 END AS n FROM (SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM r)
), node AS (
  SELECT k, d, min(c) AS c, count(*) AS m, any_value(n) AS n, coalesce(string_agg(CASE WHEN size = d THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM p GROUP BY 1, 2
), kids AS (SELECT k[1:d - 1] AS k, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1), f AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids USING (k)), up AS (
  SELECT k[1:a] AS k, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((m - 1) * n) AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM f) GROUP BY 1
)
SELECT f.c AS conv_id, f.d AS depth, g.c AS parent_conv_id, f.m AS n_convs, f.kids AS n_children, CAST(up.leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN up USING (k) LEFT JOIN f g ON f.d > 0 AND g.k = f.k[1:f.d - 1]
"""


def _op13_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry, round by round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (
  SELECT x.r, x.p, arg_min(b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {entries} + b.e) AS e,
    min(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM part x JOIN book{k} b USING (p) GROUP BY 1, 2
)""")
        if k < rounds:
            steps.append(f"""comp{k} AS (
  SELECT p, e, i, CAST(floor(sum(c)::DOUBLE / count(*)) AS BIGINT) AS c FROM (SELECT n.p, n.e, unnest(x.v) AS c, unnest(range(len(x.v))) AS i FROM near{k} n JOIN part x USING (r, p)) GROUP BY 1, 2, 3
), book{k + 1} AS (
  SELECT b.p, b.e, coalesce(f.v, b.v) AS v FROM book{k} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS v FROM comp{k} GROUP BY 1, 2) f USING (p, e)
)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM (SELECT r, v, unnest(range({parts})) AS p FROM kept)),
book0 AS (SELECT p, r AS e, v FROM part WHERE r < {entries}), {", ".join(steps)},
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS s FROM book{rounds}), coded AS (
  SELECT r, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY 1
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM kept JOIN coded USING (r), sha
"""


QUERIES = (op1_substring_dedup, op2_chunk_dedup, op3_token_counts, op4_line_dedup, op5_decontaminate, op6_packing, op7_warc, op8_quality_rules, op9_near_duplicates, op10_quality_classifier, op11_prefix_trie, op12_nearest_vectors, op13_vector_codes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": OP7_SQL, "op8_quality_rules": OP8_SQL, "op9_near_duplicates": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_vector_codes": _op13_sql()}
