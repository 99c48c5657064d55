"""Queries of text functions, ids, locators and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, training
from lodestone.operators.evaluate import word_error_rate
from lodestone.plans import sqltext as S
from lodestone.plans.registry import query, table
from lodestone.sources.scratch import spread


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, sha1(array_to_string(t, ' ')) AS tokens_sha1 FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def text_tokens_normalized(spark, d):
    t = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha1(F.array_join("t", " ")).alias("tokens_sha1"))


@query(f"WITH {S.normalized('part', 'p_name')} SELECT name, norm, replace(norm, ' ', '') AS name_key FROM normal")
def name_normalize(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().select("name", T.normalized("name").alias("norm"), T.name_key("name").alias("name_key"))


@query(f"WITH {S.normalized('supplier', 's_name')} SELECT name, coalesce(nullif(trim(regexp_replace(norm, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'concept') AS slug FROM normal")
def name_slug(spark, d):
    return table(spark, d, "supplier").select(F.col("s_name").alias("name")).distinct().select("name", T.slug("name").alias("slug"))


@query(f"SELECT DISTINCT w AS word, {S.singular('w')} AS one FROM (SELECT unnest({S.words(S.plain('text'))}) AS w FROM documents)")
def singularize_terms(spark, d):
    w = spread(table(spark, d, "documents").select("text")).select(F.explode(T.words(T.plain("text"))).alias("word")).distinct()
    return w.select("word", T.singular("word").alias("one"))


@query("SELECT DISTINCT p_type AS model, regexp_replace(p_type || ':' || p_brand, '[^A-Za-z0-9._-]+', '-', 'g') AS slug FROM part")
def model_slug(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("model"), T.model_slug(F.concat_ws(":", "p_type", "p_brand")).alias("slug")).distinct()


@query("SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS memory_key FROM conversations")
def memory_norm_key(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.memory_key("text").alias("memory_key"))


@query(f"SELECT doc_id, array_to_string(({S.words('text')})[1:12], ' ') AS short FROM documents")
def short_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.short("text").alias("short"))


@query(rf"""SELECT item_id, {S.collapse(r"regexp_replace(regexp_replace(text || ' 6006 and the 6.824 notes', '\b(?:(?:6\.)?006|6006|18\.06|(?:6\.)?034|6\.042J?|(?:6\.)?824|6\.046J?)\b', 'this course', 'g'), '^\s*MIT OpenCourseWare\b', ' ')")} AS cleaned FROM benchmark""")
def clean_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.clean_lecture(F.concat("text", F.lit(" 6006 and the 6.824 notes"))).alias("cleaned"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    t AS (SELECT doc_id, i, length(line) AS s FROM l)
    SELECT format('{}:{:04d}', doc_id, i) AS chunk_id, CASE WHEN s >= 3600 THEN format('{}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) ELSE format('{:02d}:{:02d}', s // 60, s % 60) END AS ends,
    CASE WHEN i % 3 = 1 THEN format('p. {}', i) WHEN i % 3 = 2 THEN format('p. {}-{}', i, i + 2) ELSE format('chunk {}', i) END AS locator FROM t"""
)
def chunk_id_locator(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    page = F.when(F.col("i") % 3 != 0, F.col("i"))
    none = F.lit(None).cast("double")
    where = T.locator(none, none, page, F.when(F.col("i") % 3 == 2, F.col("i") + 2), F.array().cast("array<string>"), F.col("i"))
    return lines.select(T.chunk_id("doc_id", "i").alias("chunk_id"), T.timestamp(F.length("line")).alias("ends"), where.alias("locator"))


@query("SELECT doc_id, sha256(text)[:16] AS source_id, sha1(CAST(doc_id AS VARCHAR) || chr(10) || text)[:16] AS fact_id, sha1('m' || chr(10) || text) AS embed_hash FROM documents")
def content_hash_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_id("text").alias("source_id"), T.fact_id(F.col("doc_id").cast("string"), "text").alias("fact_id"), T.embedding_hash("m", "text").alias("embed_hash"))


@query("SELECT item_id, CASE WHEN CAST('0x' || sha1(CAST(item_id AS VARCHAR))[:2] AS INT) % 2 = 0 THEN 'dev' ELSE 'test' END AS half FROM benchmark")
def query_split_dev_test(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.query_half(F.col("item_id").cast("string")).alias("half"))


@query(
    r"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(list_max(list_transform(s, lambda x: length(x))) AS BIGINT) AS longest
    FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents)"""
)
def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"))


@query()
def chunk_pack_overlap(spark, d):
    """Lines of each document as timed blocks, packed to passages; held against a plain re-statement in the tests."""
    block = lambda t, i: F.struct(t.alias("text"), (i * 10.0).alias("start"), (i * 10.0 + 9).alias("end"), F.array().cast("array<string>").alias("heading"))
    sources = spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("source_id"), F.transform(F.split("text", "\n"), block).alias("blocks"))
    return chunking.chunks(sources).select("source_id", "chunk_id", "index", "n_words", "start", "end", F.sha1("text").alias("text_sha1"), T.locator().alias("locator"))


@query("SELECT doc_id, CASE WHEN length(text) <= 700 THEN text ELSE text[:697] || '...' END AS snippet FROM documents")
def search_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet("text").alias("snippet"))


@query(
    r"""SELECT page_id, coalesce(nullif(rtrim(regexp_replace(regexp_replace(trim(regexp_replace(url, '[\\/:*?"<>|#^\[\]]', ' ', 'g')), '^\.+|\.+$', '', 'g'), '\s+', ' ', 'g')[:40]), ''), 'untitled') AS note,
    CASE WHEN url LIKE '%example.org/%' THEN '[at](' || replace(url, 'example.org', 'youtube.com') || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 't=' || page_id || 's)' ELSE 'at' END AS link FROM pages"""
)
def note_names_and_links(spark, d):
    u = F.replace("url", F.lit("example.org"), F.lit("youtube.com"))
    return table(spark, d, "pages").select("page_id", T.safe_name("url", 40).alias("note"), T.time_link(u, "page_id", F.lit("at")).alias("link"))


@query(
    """SELECT conv_id, turn, list_extract([['procedure','relation'],['definition','fact'],['procedure','definition'],['relation','fact'],['procedure','fact'],['relation','definition']], CAST(turn % 6 + 1 AS INT))[1] AS first,
    list_extract([['procedure','relation'],['definition','fact'],['procedure','definition'],['relation','fact'],['procedure','fact'],['relation','definition']], CAST(turn % 6 + 1 AS INT))[2] AS second FROM conversations"""
)
def type_rotation(spark, d):
    t = training.requested_types("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", t[0].alias("first"), t[1].alias("second"))


@query()
def turn_word_errors(spark, d):
    """Word errors between each turn and the one before it in its conversation; rows only, held against a plain form in the tests."""
    from pyspark.sql import Window as W

    c = table(spark, d, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn", "text"))).where("before is not null")
    return word_error_rate(spread(c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("before").alias("reference"), F.col("text").alias("hypothesis"))))
