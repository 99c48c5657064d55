"""Queries that measure: retrieval metrics, extraction and merge quality, classification, bootstraps."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluate as E
from lodestone.operators import knowledge as K
from lodestone.operators import search as R
from lodestone.plans import search_plans as P
from lodestone.plans import sqltext as S
from lodestone.plans.graph_plans import MENTIONS, mentions
from lodestone.plans.registry import query, table
from lodestone.sources.scratch import materialise, spread

_QRELS = f"""qrels AS (SELECT query, doc FROM (SELECT item_id AS query, array_to_string({S.tokens('text')}, ' ') AS item FROM benchmark) JOIN (SELECT doc_id AS doc, ' ' || array_to_string({S.tokens('text')}, ' ') || ' ' AS held FROM documents)
ON item <> '' AND contains(held, ' ' || item || ' '))"""
_METRICS = """hit AS (SELECT query, min(rank) AS first, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, sum(1 / log2(rank + 1)) AS dcg FROM qrels JOIN ranking USING (query, doc) WHERE rank <= 10 GROUP BY query),
per AS (SELECT query, coalesce(h1, 0) / n AS r1, coalesce(h5, 0) / n AS r5, coalesce(h10, 0) / n AS r10, CASE WHEN coalesce(h5, 0) > 0 THEN 1.0 ELSE 0.0 END AS hit5, coalesce(1 / first, 0) AS rr,
coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))) AS ndcg FROM (SELECT query, count(*) AS n FROM qrels GROUP BY query) LEFT JOIN hit USING (query))"""
_MEAN = "round(avg(r1), 6) AS r1, round(avg(r5), 6) AS r5, round(avg(r10), 6) AS r10, round(avg(hit5), 6) AS hit5, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg"
_BM = f"ranking AS (SELECT query, doc, rank FROM {P._RANKED.format('bm')} WHERE rank <= 10)"
_HALF = "CASE WHEN CAST('0x' || sha1(CAST(query AS VARCHAR))[:2] AS INT) % 2 = 0 THEN 'dev' ELSE 'test' END"


def qrels(spark, d):
    """Documents that hold all tokens of an item in a row: places meet items by their first tokens, so it is an equi-join."""
    whole = P.items(spark, d).select(F.col("query").alias("concept"), F.col("tokens").alias("form"))
    return materialise(K.spans(P.documents(spark, d), whole).select(F.col("concept").alias("query"), "doc").distinct(), "qrels")


def means():
    return [F.round(F.avg(c), 6).alias(a) for c, a in (("r1", "r1"), ("r5", "r5"), ("r10", "r10"), ("hit5", "hit5"), ("rr", "mrr"), ("ndcg", "ndcg"))]


@query(f"WITH {P.BM25}, {_QRELS}, {_BM}, {_METRICS} SELECT {_MEAN} FROM per")
def ir_metrics(spark, d):
    return E.ir_per_query(P.bm25(spark, d, 10), qrels(spark, d)).agg(*means())


@query(f"WITH {P.BM25}, {_QRELS}, {_BM}, {_METRICS} SELECT {_HALF} AS type, count(*) AS n, {_MEAN} FROM per GROUP BY 1")
def ir_metrics_by_type(spark, d):
    return E.ir_per_query(P.bm25(spark, d, 10), qrels(spark, d)).groupBy(T.query_half(F.col("query").cast("string")).alias("type")).agg(F.count("*").alias("n"), *means())


@query(f"WITH {P.BM25}, {_QRELS}, {_BM}, {_METRICS} SELECT query, round(ndcg, 6) AS ndcg FROM per")
def ndcg_at_10(spark, d):
    return E.ir_per_query(P.bm25(spark, d, 10), qrels(spark, d)).select("query", F.round("ndcg", 6).alias("ndcg"))


_PER2 = _METRICS.replace("hit AS", "hit2 AS").replace("per AS", "per2 AS").replace("JOIN ranking", "JOIN ranking2").replace("LEFT JOIN hit ", "LEFT JOIN hit2 ")


@query(
    f"""WITH {P.BM25}, {P.LINKS}, {P.GRAPH}, {_QRELS}, {_BM}, ranking2 AS (SELECT query, doc, rank FROM {P._RANKED.format('gs')} WHERE rank <= 10), {_METRICS}, {_PER2}
    SELECT round(avg(per2.rr - per.rr), 6) AS rr_gain, round(avg(per2.r10 - per.r10), 6) AS r10_gain, count(*) AS n FROM per JOIN per2 USING (query)"""
)
def metric_diff_mean(spark, d):
    q = qrels(spark, d)
    a = E.ir_per_query(P.bm25(spark, d, 10), q).select("query", F.col("rr").alias("a"), F.col("r10").alias("a10"))
    b = E.ir_per_query(R.graph_topk(*P.graph(spark, d), 10), q).select("query", F.col("rr").alias("b"), F.col("r10").alias("b10"))
    return a.join(b, "query").agg(F.round(F.avg(F.col("b") - F.col("a")), 6).alias("rr_gain"), F.round(F.avg(F.col("b10") - F.col("a10")), 6).alias("r10_gain"), F.count("*").alias("n"))


_PRF = """round(coalesce(tp / nullif(n_pred, 0), 0), 6) AS precision, round(coalesce(tp / nullif(n_gold, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(n_pred + n_gold, 0), 0), 6) AS f1"""


@query(
    f"""WITH {P._TOKENS}, {P.LINKS}, {_QRELS}, p AS (SELECT lang, count(*) AS n_pred FROM link JOIN documents ON doc = doc_id GROUP BY lang), g AS (SELECT lang, count(*) AS n_gold FROM qrels JOIN documents ON doc = doc_id GROUP BY lang),
    t AS (SELECT lang, count(*) AS tp FROM qrels q JOIN link l ON q.doc = l.doc AND q.query = l.concept JOIN documents ON q.doc = doc_id GROUP BY lang),
    c AS (SELECT lang, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_gold, 0) AS n_gold FROM p FULL JOIN g USING (lang) LEFT JOIN t USING (lang)),
    u AS (SELECT lang, tp, n_pred, n_gold FROM c UNION ALL SELECT 'all', sum(tp), sum(n_pred), sum(n_gold) FROM c)
    SELECT lang, CAST(tp AS BIGINT) AS tp, {_PRF} FROM u"""
)
def prf_micro(spark, d):
    """Linked concepts against documents that hold the item, by language and in all: counts are added, then divided."""
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang")
    pred, gold = materialise(P.links(spark, d), "links").select(F.col("concept").alias("query"), "doc"), qrels(spark, d)
    n = lambda rows, name: rows.join(lang, "doc").groupBy("lang").agg(F.count("*").alias(name))
    c = n(pred, "n_pred").join(n(gold, "n_gold"), "lang", "full").join(n(pred.join(gold, ["query", "doc"]), "tp"), "lang", "left").fillna(0)
    u = c.select("lang", "tp", "n_pred", "n_gold").union(c.agg(F.lit("all"), F.sum("tp"), F.sum("n_pred"), F.sum("n_gold")))
    return u.select("lang", "tp", *E.prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")))


@query(f"WITH {P._TOKENS}, {P.LINKS}, {_QRELS} SELECT lang, count(*) AS matched, count(*) - count(DISTINCT concept) AS duplicates FROM link JOIN documents ON doc = doc_id WHERE concept IN (SELECT query FROM qrels) GROUP BY lang")
def duplicates_claimed(spark, d):
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang")
    m = P.links(spark, d).join(qrels(spark, d).select(F.col("query").alias("concept")).distinct(), "concept", "left_semi").join(lang, "doc")
    return m.groupBy("lang").agg(F.count("*").alias("matched"), (F.count("*") - F.countDistinct("concept")).alias("duplicates"))


@query(
    """SELECT CAST((SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM part GROUP BY p_size, p_brand, p_type)) AS BIGINT) AS tp,
    CAST((SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM part GROUP BY p_size, p_brand)) AS BIGINT) AS pred, CAST((SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM part GROUP BY p_size, p_type)) AS BIGINT) AS gold"""
)
def merge_quality_pairs(spark, d):
    return E.merge_quality(table(spark, d, "part").select(F.col("p_size").alias("source"), F.col("p_brand").alias("concept"), F.col("p_type").alias("gold")))


_PAIRS = "p AS (SELECT DISTINCT a.concept AS s, b.concept AS o, a.l_linenumber AS k FROM m a JOIN m b ON a.chunk = b.chunk AND b.l_linenumber = a.l_linenumber + 1 AND a.concept <> b.concept WHERE a.l_linenumber <= 2)"


@query(f"WITH {MENTIONS}, {_PAIRS}, a AS (SELECT DISTINCT least(s, o) AS x, greatest(s, o) AS y FROM p WHERE k = 1), b AS (SELECT DISTINCT least(s, o) AS x, greatest(s, o) AS y FROM p WHERE k = 2) SELECT x, y, (x, y) IN (SELECT (x, y) FROM b) AS matched FROM a")
def unordered_pair_match(spark, d):
    m = mentions(spark, d).select("chunk", "concept", "l_linenumber")

    def pairs(k):
        a, b = m.where(F.col("l_linenumber") == k).select("chunk", F.col("concept").alias("s")), m.where(F.col("l_linenumber") == k + 1).select("chunk", F.col("concept").alias("o"))
        return a.join(b, "chunk").where("s <> o").select(F.least("s", "o").alias("x"), F.greatest("s", "o").alias("y")).distinct()

    return pairs(1).join(pairs(2).withColumn("matched", F.lit(True)), ["x", "y"], "left").select("x", "y", F.coalesce("matched", F.lit(False)).alias("matched"))


_RULE = r"CASE WHEN regexp_matches(text, '[%#&$*]{3}|!!') THEN 0 ELSE 1 END"


def judged(spark, d):
    """Quality labels against a rule on signs."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.when(F.col("text").rlike(r"[%#&$*]{3}|!!"), 0).otherwise(1).alias("pred"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("gold")), "doc_id")


_J = f"j AS (SELECT doc_id, source, quality AS gold, {_RULE} AS pred FROM documents JOIN labels USING (doc_id))"


@query(
    f"""WITH {_J}, l AS (SELECT gold AS label, count(*) AS n_gold, count(*) FILTER (gold = pred) AS tp, (SELECT count(*) FROM j k WHERE k.pred = j.gold) AS n_pred FROM j GROUP BY gold),
    f AS (SELECT {_PRF} FROM l) SELECT (SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) FROM j) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f"""
)
def accuracy_macro_f1(spark, d):
    j = judged(spark, d)
    f = E.per_label(j).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return j.agg(F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 6).alias("accuracy")).crossJoin(f)  # one row each


@query(f"WITH {_J} SELECT gold, pred, count(*) AS n FROM j GROUP BY ALL")
def confusion_matrix(spark, d):
    return judged(spark, d).groupBy("gold", "pred").agg(F.count("*").alias("n"))


@query(f"WITH {_J}, v AS (SELECT source, pred, count(*) AS n, min(doc_id) AS first FROM j GROUP BY ALL) SELECT source, arg_min(pred, row(-n, first)) AS pred, max(n) AS n FROM v GROUP BY source")
def lecture_vote(spark, d):
    return K.majority(judged(spark, d), ["source"], "pred", "doc_id")


@query()
def paired_bootstrap_ci(spark, d):
    """The range of the mean gain in reciprocal rank of the graph over BM25, queries drawn again."""
    q = qrels(spark, d)
    a = E.ir_per_query(P.bm25(spark, d, 10), q).select("query", F.col("rr").alias("a"))
    b = E.ir_per_query(R.graph_topk(*P.graph(spark, d), 10), q).select("query", F.col("rr").alias("b"))
    return E.bootstrap(a.join(b, "query").select(F.col("query").alias("cluster"), (F.col("b") - F.col("a")).alias("value"), F.lit(1).alias("size")))


@query()
def cluster_bootstrap_ci(spark, d):
    """The range of accuracy with sources drawn again as a whole."""
    c = judged(spark, d).groupBy(F.col("source").alias("cluster")).agg(F.sum((F.col("gold") == F.col("pred")).cast("int")).alias("value"), F.count("*").alias("size"))
    return E.bootstrap(c)


@query()
def paired_cluster_bootstrap_ci(spark, d):
    """The range of the gain in accuracy of each document's own label over its source's vote, sources drawn again as a whole, both methods with the same draws."""
    j = judged(spark, d)
    vote = K.majority(j, ["source"], "pred", "doc_id").select("source", F.col("pred").alias("vote"))
    gain = (F.col("gold") == F.col("pred")).cast("int") - (F.col("gold") == F.col("vote")).cast("int")
    return E.seeded_bootstrap(j.join(vote, "source").groupBy(F.col("source").alias("cluster")).agg(F.sum(gain).alias("value"), F.count("*").alias("size")))


@query()
def tfidf_logreg(spark, d):
    """Languages of documents by tf-idf and logistic regression: learned on four fifths, counted on the rest."""
    from lodestone.operators.classify import TfidfRegression

    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("label")).where("label is not null")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = TfidfRegression().fit(rows.where(~held)).predict(rows.where(held))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("right"))


@query()
def vector_logreg(spark, d):
    """Labels of embeddings by logistic regression: learned on four fifths, counted on the rest."""
    from lodestone.operators.classify import VectorRegression

    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding"), F.col("label").cast("string").alias("label")).where("label is not null and embedding is not null")
    held = F.crc32(F.col("vec_id").cast("string")) % 5 == 0
    rows = materialise(spread(rows), "labelled-vectors")
    out = VectorRegression().fit(rows.where(~held)).predict(rows.where(held))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("right"))
