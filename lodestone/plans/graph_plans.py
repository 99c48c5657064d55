"""Queries over the concept graph that the star tables stand for: parts are concepts, order lines mentions, orders chunks, customers sources."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import incremental as I
from lodestone.operators import knowledge as K
from lodestone.operators import merge as M
from lodestone.operators import training
from lodestone.plans import sqltext as S
from lodestone.plans.registry import query, table

_M = "m AS (SELECT p_name AS concept, l_orderkey AS chunk, p_brand AS surface, 1 - l_discount AS confidence, l_shipdate AS start, l_returnflag, l_linenumber, p_type, p_partkey, {pos} AS pos FROM lineitem JOIN part ON l_partkey = p_partkey)"
_POS = "row(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)"
MENTIONS = _M.format(pos=_POS)
EDGES = "e AS (SELECT DISTINCT a.concept AS src, b.concept AS dst FROM m a JOIN m b ON a.chunk = b.chunk AND a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.concept <> b.concept)"


def mentions(spark, d):
    pos = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_name").alias("concept"), F.col("l_orderkey").alias("chunk"), F.col("p_brand").alias("surface"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_shipdate").alias("start"), "l_returnflag", "l_linenumber", "p_type", "p_partkey", pos.alias("pos")
    )


def edges(spark, d):
    m = mentions(spark, d)
    a = m.where("l_linenumber = 1").select("chunk", F.col("concept").alias("src"))
    b = m.where("l_linenumber = 2").select("chunk", F.col("concept").alias("dst"))
    return a.join(b, "chunk").where("src <> dst").select("src", "dst").distinct()


@query(
    """SELECT 'Concept' AS kind, count(DISTINCT p_name) AS n FROM part UNION ALL SELECT 'Chunk', count(*) FROM orders UNION ALL SELECT 'Source', count(*) FROM customer
    UNION ALL SELECT 'MENTIONED_IN', count(*) FROM (SELECT DISTINCT p_name, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)"""
)
def graph_counts(spark, d):
    one = lambda kind, rows: rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    parts = [("Concept", table(spark, d, "part").select("p_name").distinct()), ("Chunk", table(spark, d, "orders")), ("Source", table(spark, d, "customer")), ("MENTIONED_IN", mentions(spark, d).select("concept", "chunk").distinct())]
    out = one(*parts[0])
    for p in parts[1:]:
        out = out.union(one(*p))
    return out


@query(
    f"""WITH {MENTIONS}, s AS (SELECT concept, chunk, surface, count(*) AS n, max(confidence) AS confidence, min(row(pos, start)) AS first FROM m GROUP BY ALL)
    SELECT concept, chunk, CAST(sum(n) AS BIGINT) AS n, round(max(confidence), 6) AS confidence, arg_min(first[2], first) AS start, string_agg(surface, ',' ORDER BY first) AS surfaces FROM s GROUP BY ALL"""
)
def mention_collapse(spark, d):
    c = K.collapse_mentions(mentions(spark, d))
    return c.select("concept", "chunk", "n", F.round("confidence", 6).alias("confidence"), "start", F.array_join("surfaces", ",").alias("surfaces"))


@query(f"WITH {MENTIONS} SELECT concept, count(*) AS n_mentions, count(DISTINCT o_orderkey) AS n_chunks FROM m LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON chunk = o_orderkey GROUP BY concept HAVING count(DISTINCT o_orderkey) >= 2")
def concept_support(spark, d):
    loaded = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    j = mentions(spark, d).select("concept", "chunk").join(loaded, F.col("chunk") == F.col("o_orderkey"), "left")
    return j.groupBy("concept").agg(F.count("*").alias("n_mentions"), F.countDistinct("o_orderkey").alias("n_chunks")).where("n_chunks >= 2")


@query(
    f"""WITH {MENTIONS}, r AS (SELECT a.concept AS subject, a.p_type AS predicate, b.concept AS object, a.chunk, least(a.confidence, b.confidence) AS confidence
    FROM m a JOIN m b ON a.chunk = b.chunk AND a.l_linenumber = 1 AND b.l_linenumber = 2 AND a.concept <> b.concept)
    SELECT subject, predicate, object, md5(string_agg(DISTINCT CAST(chunk AS VARCHAR), ',' ORDER BY CAST(chunk AS VARCHAR))) AS chunks_md5, round(max(confidence), 6) AS confidence, count(*) AS n FROM r GROUP BY ALL"""
)
def relation_evidence(spark, d):
    m = mentions(spark, d).withColumn("chunk", F.col("chunk").cast("string"))
    a = m.where("l_linenumber = 1").select("chunk", F.col("concept").alias("subject"), F.col("p_type").alias("predicate"), F.col("confidence").alias("c1"))
    b = m.where("l_linenumber = 2").select("chunk", F.col("concept").alias("object"), F.col("confidence").alias("c2"))
    r = K.relation_evidence(a.join(b, "chunk").withColumn("confidence", F.least("c1", "c2")))
    return r.select("subject", "predicate", "object", F.md5(F.array_join("chunks", ",")).alias("chunks_md5"), F.round("confidence", 6).alias("confidence"), "n")


_FACTS = "f AS (SELECT concept, chunk, count(*) AS facts FROM m WHERE l_returnflag = 'R' GROUP BY ALL), mf AS (SELECT concept, chunk, coalesce(facts, 0) AS facts FROM (SELECT DISTINCT concept, chunk FROM m) LEFT JOIN f USING (concept, chunk))"


@query(f"WITH {MENTIONS}, {_FACTS} SELECT concept, chunk, facts FROM mf")
def facts_per_concept_chunk(spark, d):
    m = mentions(spark, d)
    return K.facts_per_mention(m, m.where("l_returnflag = 'R'"))


@query(f"WITH {MENTIONS} SELECT concept, chunk, count(*) AS n FROM m WHERE chunk IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL")
def semi_join_loaded(spark, d):
    loaded = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("chunk"))
    return mentions(spark, d).select("concept", "chunk").join(loaded, "chunk", "left_semi").groupBy("concept", "chunk").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join_missing(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(
    f"""WITH {MENTIONS} SELECT DISTINCT concept, chunk, c_name AS title, o_orderdate AS begins,
    dense_rank() OVER (PARTITION BY concept ORDER BY c_name NULLS LAST, o_orderdate NULLS LAST, chunk) AS place FROM m JOIN orders ON chunk = o_orderkey JOIN customer ON o_custkey = c_custkey"""
)
def graph_trace(spark, d):
    """Where each concept stands: mention, chunk and source, in reading order."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), "o_custkey", F.col("o_orderdate").alias("begins"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("title"))
    t = mentions(spark, d).select("concept", "chunk").distinct().join(o, "chunk").join(c, "o_custkey")
    w = W.partitionBy("concept").orderBy(F.asc_nulls_last("title"), F.asc_nulls_last("begins"), "chunk")
    return t.select("concept", "chunk", "title", "begins", F.row_number().over(w).alias("place"))


@query(f"WITH {MENTIONS}, {EDGES}, n AS (SELECT src AS node, dst AS other, 'out' AS dir FROM e UNION ALL SELECT dst, src, 'in' FROM e) SELECT node, other, dir, count(*) OVER (PARTITION BY node) AS degree FROM n")
def graph_neighbours(spark, d):
    n = K.both_ends(edges(spark, d))
    degree = n.groupBy("node").agg(F.count("*").alias("degree"))
    return n.join(degree, "node").select("node", "other", "dir", "degree")


@query(f"WITH {MENTIONS} SELECT lower(surface) AS q, arg_min(concept, row(-n, concept)) AS concept, max(n) AS n FROM (SELECT surface, concept, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1")
def find_concept(spark, d):
    """For each alias, whatever its case, the concept with the most mentions."""
    n = mentions(spark, d).groupBy(F.lower("surface").alias("q"), "concept").agg(F.count("*").alias("n"))
    return n.groupBy("q").agg(F.min_by("concept", F.struct(-F.col("n"), "concept")).alias("concept"), F.max("n").alias("n"))


@query(
    f"""WITH {MENTIONS}, {EDGES} SELECT a.src AS concept, b.dst AS via, count(DISTINCT a.dst) AS paths FROM e a JOIN e b ON a.dst = b.src AND b.dst <> a.src GROUP BY ALL"""
)
def two_hop_paths(spark, d):
    e = edges(spark, d)
    a, b = e.select(F.col("src").alias("concept"), F.col("dst").alias("mid")), e.select(F.col("src").alias("mid"), F.col("dst").alias("via"))
    return a.join(b, "mid").where("concept <> via").groupBy("concept", "via").agg(F.countDistinct("mid").alias("paths"))


@query(
    f"""WITH {MENTIONS} SELECT concept, count(DISTINCT o_custkey) AS sources, count(*) AS mentions FROM m JOIN orders ON chunk = o_orderkey GROUP BY concept HAVING count(DISTINCT o_custkey) > 1 ORDER BY sources DESC, mentions DESC, concept LIMIT 10"""
)
def multi_source_concepts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), "o_custkey")
    g = mentions(spark, d).select("concept", "chunk").join(o, "chunk").groupBy("concept").agg(F.countDistinct("o_custkey").alias("sources"), F.count("*").alias("mentions"))
    return g.where("sources > 1").orderBy(F.desc("sources"), F.desc("mentions"), "concept").limit(10)


@query(
    f"""WITH {MENTIONS} SELECT concept, string_agg(DISTINCT r_name, ',' ORDER BY r_name) AS domains FROM m JOIN orders ON chunk = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY concept"""
)
def concept_domains(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    j = mentions(spark, d).select("concept", "chunk").join(o, "chunk").join(c, "c_custkey").join(n, "n_nationkey")
    return j.groupBy("concept").agg(F.array_join(F.sort_array(F.collect_set("r_name")), ",").alias("domains"))


@query("WITH c AS (SELECT p_name, p_type, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL) SELECT p_name, arg_min(p_type, row(-n, first)) AS p_type, max(n) AS n FROM c GROUP BY p_name")
def concept_majority_type(spark, d):
    return K.majority(table(spark, d, "part"), ["p_name"], "p_type", "p_partkey")


@query("WITH c AS (SELECT p_type, p_name, count(*) AS n FROM part GROUP BY ALL) SELECT p_type, arg_min(p_name, row(-n, length(p_name), p_name)) AS p_name, max(n) AS n FROM c GROUP BY p_type")
def canonical_surface(spark, d):
    return K.canonical_surface(table(spark, d, "part"), "p_type", "p_name")


@query("SELECT p_name, arg_min(p_partkey, row(-p_retailprice, p_partkey)) AS best, max(p_retailprice) AS confidence FROM part GROUP BY p_name")
def best_definition(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("best"), F.max("p_retailprice").alias("confidence"))


_CLASHING = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' 2' WHEN 1 THEN p_name || ' 2 2' WHEN 2 THEN p_name || ' 3' ELSE p_name END"


@query(
    f"""WITH s AS (SELECT p_partkey AS g, trim(regexp_replace(lower({_CLASHING}), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part), f AS (SELECT list(row(g, slug) ORDER BY g) AS x FROM s GROUP BY regexp_replace(slug, '(-[0-9]+)+$', '')),
    r AS (SELECT list_reduce(list_transform(x, lambda e: [e]), lambda used, e: list_append(used, row(e[1][1], CASE WHEN NOT list_contains(list_transform(used, lambda u: u[2]), e[1][2]) THEN e[1][2]
    ELSE e[1][2] || '-' || list_filter(range(2, len(used) + 3), lambda n: NOT list_contains(list_transform(used, lambda u: u[2]), e[1][2] || '-' || n))[1] END)), []) AS ids FROM f)
    SELECT u[1] AS p_partkey, u[2] AS id FROM (SELECT unnest(ids) AS u FROM r)"""
)
def slug_collisions(spark, d):
    """Ids of names of which many have one slug, and whose numbered slugs are others' plain ones."""
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat("p_name", F.lit(" 2"))).when(k == 1, F.concat("p_name", F.lit(" 2 2"))).when(k == 2, F.concat("p_name", F.lit(" 3"))).otherwise(F.col("p_name"))
    return M.numbered_ids(table(spark, d, "part").select(F.col("p_partkey").alias("group"), name.alias("name"))).select(F.col("group").alias("p_partkey"), "id")


@query(
    f"""WITH {S.normalized('(SELECT p_type AS x FROM part UNION SELECT p_brand FROM part UNION SELECT p_name FROM part)', 'x')},
    f AS (SELECT p_name, p_brand AS form, p_partkey * 2 AS pos FROM part UNION ALL SELECT p_name, p_type, p_partkey * 2 + 1 FROM part),
    k AS (SELECT p_name, b.norm AS k, min(row(pos, form)) AS first FROM f JOIN normal a ON a.name = p_name JOIN normal b ON b.name = form WHERE a.norm <> b.norm GROUP BY ALL)
    SELECT p_name, string_agg(first[2], ',' ORDER BY first) AS aliases FROM k GROUP BY p_name"""
)
def alias_list(spark, d):
    p = table(spark, d, "part")
    f = p.select("p_name", F.col("p_brand").alias("form"), (F.col("p_partkey") * 2).alias("pos")).union(p.select("p_name", "p_type", F.col("p_partkey") * 2 + 1))
    a = K.other_forms(f.withColumn("name", F.col("p_name")), "p_name", "form", "pos", "name")
    return a.select("p_name", F.array_join("aliases", ",").alias("aliases"))


@query(
    """WITH RECURSIVE i AS (SELECT c_custkey AS item, c_mktsegment || c_nationkey AS k, c_mktsegment || (c_nationkey + 5) AS alias FROM customer),
    first AS (SELECT k, min(item) AS item FROM i GROUP BY k), link AS (SELECT i.item AS u, f.item AS v FROM i JOIN first f ON f.k = i.k UNION SELECT i.item, f.item FROM i JOIN first f ON f.k = i.alias),
    twoway AS (SELECT u, v FROM link UNION SELECT v, u FROM link), reach(n, root) AS (SELECT item, item FROM first UNION SELECT b.v, r.root FROM reach r JOIN twoway b ON b.u = r.n JOIN first f ON f.item = b.v),
    top AS (SELECT n, min(root) AS root FROM reach GROUP BY n) SELECT i.item, top.root AS "group" FROM i JOIN first f ON f.k = i.k JOIN top ON top.n = f.item"""
)
def name_groups_components(spark, d):
    """Customers named by segment and nation; each has the name five nations on as an alias."""
    c = table(spark, d, "customer")
    items = c.select(F.col("c_custkey").alias("item"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), F.array(F.concat("c_mktsegment", (F.col("c_nationkey") + 5).cast("string"))).alias("aliases"))
    return K.name_groups(items)


_CONTRAST = """CASE WHEN len(list_intersect(x, y)) = 0 THEN false ELSE (len(list_filter(x, lambda w: NOT list_contains(y, w))) = 0) <> (len(list_filter(y, lambda w: NOT list_contains(x, w))) = 0)
OR (len(list_filter(x, lambda w: NOT list_contains(y, w))) = 1 AND len(list_filter(y, lambda w: NOT list_contains(x, w))) = 1) END"""


@query(f"WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part), p AS (SELECT a.name AS a, b.name AS b, string_split(a.name, ' ') AS x, string_split(b.name, ' ') AS y FROM n a JOIN n b ON a.name < b.name) SELECT a, b, {_CONTRAST} AS blocked FROM p")
def contrast_guard(spark, d):
    """Pairs of the fixed set of concept names."""
    n = table(spark, d, "part").select(F.lower("p_name").alias("a")).distinct()
    return n.join(n.select(F.col("a").alias("b")), F.col("a") < F.col("b")).select("a", "b", T.contrast("a", "b").alias("blocked"))


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderkey) AS place FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL)) WHERE place <= 3")
def training_pairs_topn(spark, d):
    """The three passages (orders) with the most facts (returned lines) of each source."""
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.count("*").alias("facts"))
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("concept"), F.col("o_orderkey").alias("chunk")).join(lines, "chunk")
    return training.top_passages(facts).select(F.col("concept").alias("o_custkey"), F.col("chunk").alias("o_orderkey"), F.col("rank").alias("place"))


@query(
    f"""WITH {MENTIONS}, r AS (SELECT a.concept AS subject, b.concept AS object, list_sort(list_distinct(list(c_mktsegment))) AS s FROM m a JOIN m b ON a.chunk = b.chunk AND a.l_linenumber = 1 AND b.l_linenumber = 2
    JOIN orders ON o_orderkey = a.chunk JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
    SELECT subject, object, array_to_string(s, ',') AS sources FROM r WHERE len(list_filter(s, lambda x: NOT list_contains(['AUTOMOBILE', 'BUILDING', 'FURNITURE'], x))) = 0"""
)
def relation_subset_filter(spark, d):
    m = mentions(spark, d)
    a, b = m.where("l_linenumber = 1").select("chunk", F.col("concept").alias("subject")), m.where("l_linenumber = 2").select("chunk", F.col("concept").alias("object"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("c_custkey"))
    s = a.join(b, "chunk").join(o, "chunk").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    r = s.groupBy("subject", "object").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("s"))
    return r.where(training.within("s", ["AUTOMOBILE", "BUILDING", "FURNITURE"])).select("subject", "object", F.array_join("s", ",").alias("sources"))


@query(
    f"""WITH q AS (SELECT conv_id, turn, role, {S.collapse('text')} AS question FROM conversations), a AS (SELECT * FROM q WHERE length(question) >= 10 AND NOT regexp_matches(question, '{training.META}')),
    b AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'question': question}} ORDER BY turn, role, question) AS x FROM a GROUP BY conv_id),
    c AS (SELECT conv_id, list_reduce(list_prepend([], list_transform(x, lambda e: [e])), lambda kept, e: CASE WHEN len(list_filter(kept, lambda k: k.role = e[1].role OR lower(k.question) = lower(e[1].question))) > 0 THEN kept ELSE list_concat(kept, e) END) AS kept FROM b)
    SELECT conv_id, k.turn AS turn, k.role AS role, k.question AS question FROM (SELECT conv_id, unnest(kept[1:3]) AS k FROM c)"""
)
def question_clean_dedupe(spark, d):
    q = table(spark, d, "conversations").select(F.col("conv_id").alias("chunk"), F.col("turn").alias("pos"), F.col("role").alias("type"), F.col("text").alias("question"))
    return training.clean_questions(q).select(F.col("chunk").alias("conv_id"), F.col("pos").alias("turn"), F.col("type").alias("role"), "question")


@query(
    """SELECT state, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT coalesce(c_acctbal, s_acctbal) AS balance, CASE WHEN c_custkey IS NULL THEN 'kept' WHEN s_suppkey IS NULL THEN 'created'
    WHEN coalesce(c_acctbal, s_acctbal) IS NOT DISTINCT FROM s_acctbal AND coalesce(c_nationkey, s_nationkey) IS NOT DISTINCT FROM s_nationkey THEN 'unchanged' ELSE 'updated' END AS state
    FROM supplier FULL JOIN customer ON s_suppkey = c_custkey) GROUP BY state"""
)
def upsert_merge_counts(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return I.upsert(old, new, ["id"]).groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query(
    """WITH old AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), new AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'O')
    SELECT 'kept' AS state, count(*) AS n FROM old WHERE k IN (SELECT k FROM new) UNION ALL SELECT 'pruned', count(*) FROM old WHERE k NOT IN (SELECT k FROM new)"""
)
def mirror_prune_counts(spark, d):
    lines = table(spark, d, "lineitem")
    kept, gone = I.mirror(lines.where("l_returnflag = 'R'").select("l_partkey").distinct(), lines.where("l_linestatus = 'O'").select("l_partkey"), ["l_partkey"])
    return kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("state"), "n").union(gone.agg(F.count("*").alias("n")).select(F.lit("pruned").alias("state"), "n"))


@query("WITH s AS (SELECT conv_id AS id, sha1('m' || chr(10) || text) AS hash FROM conversations WHERE turn = 0), t AS (SELECT doc_id AS id, sha1('m' || chr(10) || text) AS now FROM documents) SELECT t.id, now FROM t LEFT JOIN (SELECT id, min(hash) AS hash FROM s GROUP BY id) s USING (id) WHERE now IS DISTINCT FROM hash")
def stale_embedding_anti_join(spark, d):
    stored = table(spark, d, "conversations").where("turn = 0").groupBy(F.col("conv_id").alias("id")).agg(F.min(T.embedding_hash("m", "text")).alias("hash"))
    return I.stale(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), stored, "m")


@query(
    """SELECT CASE WHEN b.id IS NULL THEN 'removed' WHEN a.id IS NULL THEN 'created' WHEN a.content = b.content THEN 'unchanged' ELSE 'updated' END AS state, count(*) AS n
    FROM (SELECT s_nationkey AS id, min(s_name) AS content FROM supplier GROUP BY 1) a FULL JOIN (SELECT n_nationkey + 3 AS id, 'Supplier#' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') AS content FROM nation) b USING (id) GROUP BY 1"""
)
def vault_reconcile_states(spark, d):
    old = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.min("s_name").alias("content"))
    notes = table(spark, d, "nation").select((F.col("n_nationkey") + 3).alias("id"), F.concat(F.lit("Supplier#"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("content"))
    return I.reconcile(notes, old).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)")
def resume_pending(spark, d):
    """Documents without a good result: labels are the results so far, quality 0 an error."""
    done = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("v1").alias("version"), F.when(F.col("quality") != 1, "bad").alias("error"), "quality").where("quality is not null")
    return I.pending(table(spark, d, "documents").select(F.col("doc_id").alias("id")), done, "v1").select("id")


_MEMORY = "SELECT conv_id, role, turn, text, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS k FROM conversations"


@query(f"SELECT conv_id, role, turn FROM ({_MEMORY}) WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, role, k ORDER BY turn) = 1")
def memory_dedup(spark, d):
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("scope"), F.col("role").alias("kind"), F.col("turn").alias("seq"), "text")
    return I.dedupe_memories(m).select(F.col("scope").alias("conv_id"), F.col("kind").alias("role"), F.col("seq").alias("turn"))


@query(
    f"""WITH t AS (SELECT conv_id || ':' || turn AS memory, turn, {S.tokens('text')} AS tokens FROM conversations WHERE text IS NOT NULL), f AS (SELECT DISTINCT tokens[1:2] AS form FROM t WHERE turn = 0 AND len(tokens) >= 2)
    SELECT memory, array_to_string(form, ' ') AS concept, CAST(min(a) AS INT) AS a FROM (SELECT *, unnest(range(0, len(tokens) - 1)) AS a FROM t) JOIN f ON tokens[a + 1 : a + 2] = form GROUP BY ALL"""
)
def memory_concept_links(spark, d):
    """The concepts that each turn of a conversation names; concepts are what conversations begin with, by their first two words."""
    m = table(spark, d, "conversations").where("text is not null").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("memory"), "turn", "text")
    first = m.where("turn = 0").select(F.slice(T.tokens("text"), 1, 2).alias("form")).where("size(form) = 2").distinct()
    return I.concept_links(m, first.select(F.array_join("form", " ").alias("concept"), "form")).groupBy("memory", "concept").agg(F.min("a").alias("a"))


@query("SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS place FROM events) WHERE place <= 5")
def memory_list_latest(spark, d):
    m = table(spark, d, "events").select(F.col("user_id").alias("scope"), F.col("ts").alias("created"), F.col("event_id").alias("seq"))
    return I.latest_memories(m, 5).select(F.col("scope").alias("user_id"), F.col("seq").alias("event_id"), F.col("rank").alias("place"))


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    from lodestone.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))
