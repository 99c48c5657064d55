"""Retrieval queries: benchmark items search the documents; vectors search vectors. The query sets are whole tables or ids divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.vectors import dot, index_score
from lodestone.operators import incremental as I
from lodestone.operators import knowledge as K
from lodestone.operators import search as R
from lodestone.operators import training
from lodestone.operators.cells import VectorIndex
from lodestone.operators.index import InvertedIndex
from lodestone.plans import sqltext as S
from lodestone.plans.registry import query, table
from lodestone.sources.scratch import kept, materialise, spread

_TOKENS = f"dt AS (SELECT doc_id AS doc, {S.tokens('text')} AS tokens FROM documents), qt AS (SELECT item_id AS query, {S.tokens('text')} AS tokens FROM benchmark)"
BM25 = f"""{_TOKENS}, terms AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest(tokens) AS term FROM qt) GROUP BY ALL), stats AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM dt),
tf AS (SELECT doc, size, term, count(*) AS tf FROM (SELECT doc, len(tokens) AS size, unnest(tokens) AS term FROM dt) WHERE term IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query, doc, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)))), 6) AS score FROM terms JOIN df USING (term) JOIN tf USING (term), stats GROUP BY ALL)"""
#: Concepts of the document graph: items, by their first two and first three words.
LINKS = """form AS (SELECT DISTINCT query AS concept, unnest([tokens[1:2], tokens[1:3]]) AS form FROM qt WHERE len(tokens) >= 3), size2 AS (SELECT unnest([2, 3]) AS n),
span AS (SELECT doc, a, a + n AS b, concept FROM (SELECT doc, a, n, tokens[a + 1 : a + n] AS gram FROM (SELECT doc, tokens, n, unnest(range(0, len(tokens) - n + 1)) AS a FROM dt, size2 WHERE len(tokens) >= n)) JOIN form ON gram = form),
link AS (SELECT doc, concept, min(a) AS a FROM (SELECT *, max(b) OVER (PARTITION BY doc ORDER BY a, b DESC, concept ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM span) WHERE covered IS NULL OR covered < b GROUP BY ALL),
told AS (SELECT doc, concept, count(*) AS facts FROM span GROUP BY ALL),
qspan AS (SELECT query, a, a + n AS b, concept FROM (SELECT query, a, n, tokens[a + 1 : a + n] AS gram FROM (SELECT query, tokens, n, unnest(range(0, len(tokens) - n + 1)) AS a FROM qt, size2 WHERE len(tokens) >= n)) JOIN form ON gram = form),
named AS (SELECT DISTINCT query, concept, 1.0 AS weight FROM (SELECT *, max(b) OVER (PARTITION BY query ORDER BY a, b DESC, concept ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM qspan) WHERE covered IS NULL OR covered < b),
near AS (SELECT q.vec_id AS query, c.vec_id - 100 AS concept, round((1 + round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6)) / 2, 6) AS weight FROM embeddings q, embeddings c WHERE q.vec_id IN (SELECT query FROM qt) AND c.vec_id - 100 IN (SELECT query FROM qt)),
seed AS (SELECT query, concept, max(weight) AS weight FROM (SELECT * FROM named UNION ALL SELECT * FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query ORDER BY weight DESC, concept) <= 3) WHERE weight >= 0.55) GROUP BY ALL)"""
GRAPH = """edge AS (SELECT DISTINCT a.concept AS node, b.concept AS other FROM link a JOIN link b ON a.doc = b.doc AND a.concept <> b.concept),
idf AS (SELECT concept, ln(1 + (SELECT count(*) FROM documents) / count(DISTINCT doc)) AS idf FROM link GROUP BY concept),
given AS (SELECT query, concept, sum(weight) AS weight FROM (SELECT query, concept, weight FROM seed UNION ALL SELECT query, other, weight * 0.25 FROM seed JOIN edge ON node = concept) GROUP BY ALL),
gs AS (SELECT query, doc, round(sum(weight * idf * (1 + 0.5 * least(facts, 3))), 6) AS score FROM given JOIN idf USING (concept) JOIN link USING (concept) JOIN told USING (doc, concept) GROUP BY ALL)"""
_RANKED = "(SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM {0})"


def documents(spark, d):
    """(doc, tokens) of whole texts, split once a session."""
    def split(folder):
        texts = spread(table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc"), "text"))
        texts.select("doc", T.tokens("text").alias("tokens")).write.parquet(f"{folder}/tokens")

    return spark.read.parquet(kept(spark, f"{d}/documents.parquet", "tokens", split) + "/tokens")


def index(spark, d):
    """The inverted index of the documents, made once a session."""
    folder = kept(spark, f"{d}/documents.parquet", "index", lambda folder: InvertedIndex(spark, folder).add(documents(spark, d)))
    return InvertedIndex(spark, folder)


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), T.tokens("text").alias("tokens"))


def forms(spark, d):
    q = items(spark, d).where(F.size("tokens") >= 3)
    return q.select(F.col("query").alias("concept"), F.explode(F.array(F.slice("tokens", 1, 2), F.slice("tokens", 1, 3))).alias("form")).distinct()


def links(spark, d):
    return K.linked(documents(spark, d), forms(spark, d))


def seeds(spark, d):
    """What an item names, and the three concepts whose vectors are nearest to its own: those of the ids from 100 on."""
    own = items(spark, d)
    named = K.linked(own.select(F.col("query").alias("doc"), "tokens"), forms(spark, d)).select(F.col("doc").alias("query"), "concept", F.lit(1.0).alias("weight"))
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    concepts = v.join(own.select((F.col("query") + 100).alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("doc"), "v")
    queries = v.join(own.select(F.col("query").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query"), "v")
    near = R.vector_topk(concepts.select((F.col("doc") - 100).alias("doc"), "v"), queries, 3, own=True, scaled=True)  # a concept's id is another numbering than a query's
    return materialise(R.vector_seeds(named, near), "seeds")


def mentioned(spark, d):
    """(concept, doc, facts) of the document graph: the longest matches, and how often the document has the concept's forms."""
    found = materialise(K.spans(documents(spark, d), forms(spark, d)), "spans")
    told = found.groupBy("doc", "concept").agg(F.count("*").alias("facts"))
    return materialise(K.longest_matches(found).join(told, ["doc", "concept"]).select("concept", "doc", "facts"), "mentioned")


def graph(spark, d, linked=None, seed=None):
    """What graph scores are made of: the documents' links or given ones (concept, doc, facts), edges between concepts that meet in a document, seeds, and the number of documents."""
    m = mentioned(spark, d) if linked is None else linked
    together = m.groupBy("doc").agg(F.collect_set("concept").alias("c"))
    edges = materialise(together.where(F.size("c") > 1).select(F.explode("c").alias("node"), "c").select("node", F.explode("c").alias("other")).where("node <> other").distinct(), "concept-edges")
    return m, edges, seeds(spark, d) if seed is None else seed, table(spark, d, "documents").agg(F.count("*").alias("n"))


def bm25(spark, d, k):
    """(query, doc, score, rank): the k best documents of each item."""
    return index(spark, d).search(items(spark, d), k)


@query(f"WITH {BM25} SELECT query, doc, score, rank FROM {_RANKED.format('bm')} WHERE rank <= 10")
def bm25_topk(spark, d):
    return bm25(spark, d, 10)


@query(f"WITH {_TOKENS}, {LINKS} SELECT doc, concept, a FROM link")
def link_terms_longest_match(spark, d):
    return links(spark, d).select("doc", "concept", F.col("a").cast("long").alias("a"))


@query(f"WITH {_TOKENS}, {LINKS}, {GRAPH} SELECT query, doc, score, rank FROM {_RANKED.format('gs')} WHERE rank <= 10")
def graph_score_topk(spark, d):
    return R.graph_topk(*graph(spark, d), 10)


@query(
    f"""WITH {BM25}, {LINKS}, {GRAPH}, pool AS (SELECT query, doc, bm.score, coalesce(gs.score, 0) AS g FROM {_RANKED.format('bm')} bm LEFT JOIN gs USING (query, doc) WHERE rank <= 50),
    re AS (SELECT query, doc, round(score + 0.05 * g / CASE WHEN max(g) OVER (PARTITION BY query) > 0 THEN max(g) OVER (PARTITION BY query) ELSE 1 END, 6) AS score FROM pool)
    SELECT query, doc, score, rank FROM {_RANKED.format('re')} WHERE rank <= 10"""
)
def hybrid_rerank(spark, d):
    pool = materialise(bm25(spark, d, R.POOL), "pool")
    return R.rerank(pool, R.graph_scores_of(pool, *graph(spark, d)), 10)


_FUSED = f"""b50 AS (SELECT query, doc, rank FROM {_RANKED.format('bm')} WHERE rank <= 50), g50 AS (SELECT query, doc, rank FROM {_RANKED.format('gs')} WHERE rank <= 50),
fu AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM b50 UNION ALL SELECT * FROM g50) GROUP BY ALL)"""


@query(f"WITH {BM25}, {LINKS}, {GRAPH}, {_FUSED} SELECT query, doc, score, rank FROM {_RANKED.format('fu')} WHERE rank <= 10")
def hybrid_rrf(spark, d):
    return R.rrf([(bm25(spark, d, 50), 1.0), (R.graph_topk(*graph(spark, d), 50), 1.0)], 10)


@query(
    f"""WITH {BM25}, {LINKS}, {GRAPH}, {_FUSED}, top AS (SELECT * FROM {_RANKED.format('fu')} WHERE rank <= 50), cov AS (SELECT query, doc, sum(weight) AS covered FROM seed JOIN link USING (concept) GROUP BY ALL),
    tot AS (SELECT query, sum(weight) AS total FROM seed GROUP BY query),
    s AS (SELECT query, doc, rank AS was, rank > 20 AS tail, round(score + CASE WHEN rank <= 20 AND coalesce(total, 0) > 0 THEN 0.05 * coalesce(covered, 0) / total ELSE 0 END, 6) AS score FROM top LEFT JOIN cov USING (query, doc) LEFT JOIN tot USING (query))
    SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY tail, CASE WHEN NOT tail THEN -score END, CASE WHEN NOT tail THEN doc END, was) AS rank FROM s"""
)
def hybrid_rrf_seed_bonus(spark, d):
    linked, seed = mentioned(spark, d), seeds(spark, d)
    fused = materialise(R.rrf([(bm25(spark, d, 50), 1.0), (R.graph_topk(*graph(spark, d, linked, seed), 50), 1.0)], 50), "fused")
    return R.seed_coverage(fused, linked, seed)


_VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_TOPK = f"{_VECTORS}, s AS (SELECT q.vec_id AS query, v.vec_id AS doc, round(list_dot_product(q.e, v.e), 6) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)"


def vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return v, v.where("doc % 100 = 0").select(F.col("doc").alias("query"), "v")


@query(f"WITH {_TOPK} SELECT query, doc, score, rank FROM {_RANKED.format('s')} WHERE rank <= 10")
def vector_topk(spark, d):
    return R.vector_topk(*vectors(spark, d), 10)


@query(f"WITH {_TOPK} SELECT query, doc, round((1 + score) / 2, 6) AS score, rank FROM {_RANKED.format('s')} WHERE rank <= 10 AND (1 + score) / 2 >= 0.55")
def vector_topk_scaled(spark, d):
    """On the scale of an index, with a floor."""
    return R.vector_topk(*vectors(spark, d), 10).where(index_score("score") >= 0.55).withColumn("score", F.round(index_score("score"), 6))


@query(f"WITH {_TOPK} SELECT a.label, count(*) AS hits, count(*) FILTER (a.label = b.label) AS same FROM {_RANKED.format('s')} r JOIN v a ON a.vec_id = query JOIN v b ON b.vec_id = doc WHERE rank <= 10 GROUP BY a.label")
def dense_retrieval_batch(spark, d):
    v, q = vectors(spark, d)
    kinds = v.select("doc", "label")
    r = R.vector_topk(v, q, 10).join(kinds, "doc").withColumnRenamed("label", "found")
    return r.join(kinds.withColumnRenamed("doc", "query"), "query").groupBy("label").agg(F.count("*").alias("hits"), F.count_if(F.col("label") == F.col("found")).alias("same"))


@query(
    f"""WITH {_VECTORS}, x AS (SELECT label, unnest(e) AS y, generate_subscripts(e, 1) AS i FROM v), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, round(avg(y), 9) AS m FROM x GROUP BY ALL) GROUP BY label),
    s AS (SELECT vec_id, v.label, c.label AS nearest, round(list_dot_product(e, c), 6) AS score FROM v, c) SELECT vec_id, label, nearest, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, nearest) = 1"""
)
def zeroshot_nearest_centroid(spark, d):
    """Each vector's nearest class by dot product with one centroid for each label."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    each = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 9).alias("m"))
    c = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    classes = c.agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("nearest"), "c"))).alias("classes"))  # labels, not rows
    scored = F.transform("classes", lambda k: F.struct((-F.round(dot("v", k["c"]), 6)).alias("minus"), k["nearest"].alias("nearest")))
    best = v.crossJoin(F.broadcast(classes)).select("vec_id", "label", F.array_min(scored).alias("b"))
    return best.select("vec_id", "label", F.col("b.nearest").alias("nearest"), (-F.col("b.minus")).alias("score"))


@query(
    f"""WITH {_VECTORS}, q AS (SELECT label, arg_min(e, vec_id) AS e, min(vec_id) AS own FROM v GROUP BY label), s AS (SELECT v.label AS scope, vec_id AS seq, round((1 + list_dot_product(q.e, v.e)) / 2, 6) AS score FROM v JOIN q USING (label) WHERE vec_id <> own),
    b AS (SELECT * FROM s WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY scope ORDER BY score DESC, seq) <= 5) SELECT scope, seq, score, row_number() OVER (PARTITION BY scope ORDER BY seq DESC) AS position FROM b"""
)
def memory_recall(spark, d):
    """The five best memories of each scope for its first vector, newest first."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("seq"), F.col("vec_id").alias("created"), F.col("embedding").cast("array<double>").alias("v"))
    q = v.groupBy("scope").agg(F.min_by("v", "seq").alias("q"), F.min("seq").alias("own"))
    s = v.join(q, "scope").where("seq <> own").select("scope", "seq", F.round(index_score(dot("q", "v")), 6).alias("score"))
    return I.recall(v.select("scope", "seq", "created"), s, 5, 0.5).select("scope", "seq", "score", "position")


@query(f"WITH {_TOPK}, n AS (SELECT query, doc, score FROM s JOIN v a ON a.vec_id = query JOIN v b ON b.vec_id = doc WHERE a.label = b.label AND abs(query - doc) > 1) SELECT query, doc, score FROM n QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) = 3")
def hard_negatives(spark, d):
    v, _ = vectors(spark, d)
    passages = v.select("doc", F.col("label").alias("source"), F.col("doc").alias("index"), "v")
    questions = passages.where("doc % 100 = 0").select(F.col("doc").alias("query"), "source", "index", "v")
    return training.hard_negatives(questions, passages)


@query(
    f"""WITH {_VECTORS}, s AS (SELECT q.vec_id AS query, v.vec_id AS doc, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query, doc, label, round((1 + score) / 2, 6) AS score, rank FROM {_RANKED.format('s')} JOIN v ON vec_id = doc WHERE rank <= 5"""
)
def similar_concepts(spark, d):
    """The five concepts most similar to each of a set, from a kept index of cells, on the scale of an index."""
    v, q = vectors(spark, d)
    folder = kept(spark, f"{d}/embeddings.parquet", "cells", lambda folder: VectorIndex(spark, folder).build(v.select(F.col("doc").alias("id"), "v")) and None)
    return VectorIndex(spark, folder).search(q, 5).join(v.select("doc", "label"), "doc").select("query", "doc", "label", F.round(index_score("score"), 6).alias("score"), "rank")
