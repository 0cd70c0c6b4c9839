"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm.alignment import link_statistics
from sitewright.llm.common import table
from sitewright.llm.conversations import damaged, repair_report
from sitewright.llm.decontamination import contaminated, find_phrases, hit_words
from sitewright.llm.html_text import extract
from sitewright.llm.licenses import scan
from sitewright.llm.neardup import near_duplicates
from sitewright.llm.packing import pack
from sitewright.llm.quality import judged
from sitewright.llm.sharding import assign
from sitewright.llm.tokens import attribute_tokens
from sitewright.llm.topk import top_k
from sitewright.llm.toxicity import held_out, score, train
from sitewright.llm.warc import archive

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), keep=("doc_id",), name="score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op2_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = attribute_tokens(table(spark, sf_dir, "documents"), special=True)
    by = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], f["n_tokens"])))
    return t.select(
        "doc_id", "n_tokens", "n_sections", "n_crossing", "n_outside",
        F.coalesce(by["title"], F.lit(0).cast("bigint")).alias("title_tokens"), F.coalesce(by["body"], F.lit(0).cast("bigint")).alias("body_tokens"),
    )


@query
def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"), unnamed=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select(F.col("query_id").cast("bigint"), "rank", F.col("id").cast("bigint").alias("vec_id"), "score")


@query
def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"), ("lang", "source", "n_chars"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=("page_id", "url"), name="text").withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op8_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("contamination")
    return find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",)).select(
        "doc_id", found["n_words"].alias("n_words"), hit_words().alias("n_hit"), F.size(found["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


@query
def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("license")
    return scan(table(spark, sf_dir, "documents", native=True)).select(
        "doc_id", x["n_words"].alias("n_words"), x["n_base"].alias("n_base"), x["first_word"].alias("first_word"), x["last_word"].alias("last_word"),
        F.array_join(x["base_labels"], ",").alias("base_labels"), F.array_join(x["labels"], ",").alias("labels"), x["score"].alias("score"),
    )


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), content="crc32", special=True).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op11_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


@query
def op12_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return repair_report(damaged(talks), known=talks)


@query
def op13_common_end_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_statistics(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')".format("text")
_ALNUM_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format("text")

SQL["op2_bottom_k_near_duplicates"] = f"""WITH RECURSIVE w AS (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS p FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.p = b.p AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i.c >= 80 * (a.c + b.c - i.c)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN m ON m.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

#: base32 of a SHA-1: forty bits are eight digits
_BASE32 = " || ".join(f"to_base(('0x' || substr(x, {1 + 10 * i}, 10))::BIGINT, 32, 8)" for i in range(4))
SQL["op4_warc_index"] = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n AS payload_bytes, translate(upper({_BASE32}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
 CASE WHEN page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to FROM d"""

SQL["op5_cover_tree_top_k"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

SQL["op8_fm_decontamination"] = f"""WITH w AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents), b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS p FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 11, 2))) AS i) WHERE len(w) > 0),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n FROM w, (SELECT DISTINCT n FROM p)), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
h AS (SELECT doc_id, item_id, i, g.n FROM g JOIN p ON p.p = g.p AND p.n = g.n),
k AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM h), LATERAL (SELECT unnest(range(i, i + n)) AS j) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id"""


#: CRC-32 bit by bit: the bytes of the key, each followed by eight shifts
_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
_CRC = f"""xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({_KEY}, ''), lambda ch: [ord(ch), -1, -1, -1, -1, -1, -1, -1, -1]))),
 lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)::BIGINT, 4294967295)"""


def _plus(v: str, cost: str | int, audit: str) -> str:
    """A state is its cost in nine digits and its audit, so that ``least`` compares both."""
    return f"(lpad((left({v}, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr({v}, 10) || '{audit}')"


_U = f"least(u, {_plus('z', 3, 'I')}, {_plus('s', 3, 'I')}, {_plus('a', 3, 'I')})"  # states before a row, after insertions
_A = f"least(a, {_plus('u', 3, 'I')}, {_plus('z', 6, 'II')}, {_plus('s', 6, 'II')})"


def _kept(v: str, who: str) -> str:
    return f"CASE WHEN fault <= 0 THEN least(CASE WHEN who = '{who}' THEN {_plus(v, 'late', 'K')} END, {_plus(v, '(3 + late)', 'R')}) END" if who != "s" else f"CASE WHEN fault <= 0 AND who = 's' THEN {_plus(v, 'late', 'K')} END"


SQL["op12_grammar_repair"] = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS d FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
 FROM k, LATERAL (SELECT unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) WHERE d > 0),
o AS (SELECT *, coalesce(conv_id::VARCHAR, '') AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM e),
f AS (SELECT *, CASE WHEN t = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 1 WHEN right(t, 1) IN ('.', '!', '?') THEN 0 ELSE -1 END AS fault, left(role, 1) AS who FROM o),
g AS (SELECT *, CASE fault WHEN -1 THEN 3 ELSE 0 END AS late, lag(who) OVER (PARTITION BY conv_id ORDER BY i) || who AS pair FROM f),
p AS (SELECT c, 0::BIGINT AS i, '000000000' AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM (SELECT DISTINCT c FROM g)
 UNION ALL SELECT g.c, g.i, {_plus('z', 4, 'D')}, least({_plus('s', 4, 'D')}, {_kept('z', 's')}), least({_plus(_U, 4, 'D')}, {_kept('z', 'u')}, {_kept('s', 'u')}, {_kept(_A, 'u')}), least({_plus(_A, 4, 'D')}, {_kept(_U, 'a')})
 FROM p JOIN g ON g.c = p.c AND g.i = p.i + 1),
w AS (SELECT c, least(z, {_plus('s', 6, 'II')}, {_plus('u', 3, 'I')}, a) AS v FROM p QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1),
x AS (SELECT c, j, substr(v, 9 + j, 1) AS l FROM w, LATERAL (SELECT unnest(range(1, length(v) - 8)) AS j)),
y AS (SELECT *, sum(CASE WHEN l <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY j) AS i, sum(CASE WHEN l <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY j) AS n FROM x),
r AS (SELECT y.c, j, n, l, role, text, coalesce(max(CASE WHEN n = 1 AND l = 'K' AND who = 's' THEN 1 END) OVER (PARTITION BY y.c), 0) AS sys FROM y LEFT JOIN g ON g.c = y.c AND g.i = y.i AND l <> 'I' WHERE l <> 'D'),
h AS (SELECT c, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (n - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM r GROUP BY c),
m AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 1) AS duplicate, count(*) FILTER (fault = -1) AS truncated,
 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(left(v, 9), '0')::BIGINT AS cost, coalesce(substr(v, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS c FROM conversations) LEFT JOIN m USING (c) LEFT JOIN w USING (c) LEFT JOIN h USING (c)"""
