"""Queries of the stored graph: customers are sources, orders chunks, parts concepts, order lines what a load says of them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.models import embedder, hash_embedding
from lodestone.plans.registry import query, table
from lodestone.sources import vault
from lodestone.sources.graph_store import GraphStore
from lodestone.sources.scratch import materialise, scratch

#: What each load knows: orders whose chunks it brings, and the lines that its knowledge comes from.
ORDERS = ("o_orderstatus <> 'O'", "o_orderpriority <> '1-URGENT'")
LINES = ("l_linestatus = 'F'", "l_quantity >= 25")


def rows(spark, d, orders: str, lines: str) -> dict:
    """The rows of a graph: each line mentions its part, an order's neighbouring lines relate their parts, returned lines are facts."""
    o = table(spark, d, "orders").where(orders).select(F.col("o_orderkey").cast("string").alias("chunk"), F.col("o_custkey").cast("string").alias("source"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("text"))
    text = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  keys are moved as numbers
    p = table(spark, d, "part").select(F.col("p_partkey").alias("concept"), "p_name", "p_type").hint("merge")  # a small file of many rows
    said = table(spark, d, "lineitem").where(lines).select(F.col("l_partkey").alias("concept"), F.col("l_orderkey").alias("chunk"), "l_linenumber", "l_returnflag", F.round(1 - F.col("l_discount"), 6).alias("confidence"))
    # lines of a concept are moved once, for its chunks and its name; then its chunks lie in one file
    each = said.select("concept", "chunk", "confidence").repartition("concept").groupBy("concept", "chunk").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    each = materialise(each.join(p, "concept").select(text("concept"), text("chunk"), "n", "confidence", "p_name", "p_type"), "said-mentions")
    concepts = each.groupBy(F.col("concept").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type")).agg(F.sum("n").alias("n_mentions"), F.count("*").alias("n_chunks"), F.max("confidence").alias("confidence"))
    # the concepts of the next line's number are a frame of the order's window, so lines are moved once and not as two sides of a join
    after = F.collect_list("concept").over(W.partitionBy("chunk").orderBy("l_linenumber").rangeBetween(1, 1))
    pairs = said.where("l_linenumber is not null and chunk is not null").select(F.col("concept").alias("subject"), "chunk", "confidence", after.alias("objects")).select("subject", "chunk", "confidence", F.explode("objects").alias("object")).where("subject <> object")
    kinds = p.select(F.col("concept").alias("subject"), F.lower("p_type").alias("predicate"))
    edges = pairs.join(kinds, "subject").groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_mentions"), F.array_sort(F.collect_set(F.col("chunk").cast("string"))).alias("chunks"))
    edges = edges.select(text("subject"), "predicate", text("object"), "confidence", "n_mentions", "chunks")
    edges = materialise(edges, "said-edges")
    facts = said.where("l_returnflag = 'R'").join(p, "concept").select(F.concat_ws("-", text("chunk"), text("l_linenumber"), text("concept")).alias("id"), text("chunk"), F.concat_ws(" ", F.lit("returned"), "p_name").alias("statement"), "confidence", F.lit("model").alias("linked_by"), F.array(text("concept")).alias("concepts"))
    return {
        "sources": table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title")), "chunks": o,
        "concepts": concepts, "mentions": each.select("concept", "chunk", "confidence", F.array("p_name").alias("surfaces")),
        "relations": edges.where("predicate <> 'economy'"), "part_of": edges.where("predicate = 'economy'").drop("predicate"), "facts": facts,
    }


def _said_sql(k: int, chunks: str) -> str:
    """CTEs of what load k + 1 says, with the chunks that are there by then."""
    return f"""c{k} AS (SELECT o_orderkey AS chunk, o_custkey AS source FROM orders WHERE {chunks}),
s{k} AS (SELECT l_partkey AS concept, l_orderkey AS chunk, l_linenumber AS line, l_returnflag AS flag, lower(p_type) AS predicate FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {LINES[k]}),
con{k} AS (SELECT DISTINCT concept FROM s{k}), men{k} AS (SELECT DISTINCT concept, chunk FROM s{k} WHERE chunk IN (SELECT chunk FROM c{k})),
e{k} AS (SELECT DISTINCT a.concept AS subject, a.predicate, b.concept AS object FROM s{k} a JOIN s{k} b ON a.chunk = b.chunk AND b.line = a.line + 1 WHERE a.concept <> b.concept),
f{k} AS (SELECT DISTINCT chunk, line, concept FROM s{k} WHERE flag = 'R' AND chunk IN (SELECT chunk FROM c{k}))"""


_BOTH = f"({ORDERS[0]}) OR ({ORDERS[1]})"
_STATES = f"""{_said_sql(0, ORDERS[0])}, {_said_sql(1, _BOTH)}, dom0 AS (SELECT DISTINCT concept, 'first' AS domain FROM men0),
dom1 AS (SELECT concept, domain FROM dom0 WHERE concept IN (SELECT concept FROM con1) UNION SELECT concept, unnest(['first', 'second']) FROM (SELECT concept FROM men1 UNION SELECT concept FROM men0 WHERE concept IN (SELECT concept FROM con1)))"""


def _counts_sql(k: int) -> str:
    domains = k + 1
    return f"""SELECT 'Domain' AS kind, {domains} AS n UNION ALL SELECT 'Source', count(*) FROM customer UNION ALL SELECT 'Chunk', count(*) FROM c{k} UNION ALL SELECT 'Concept', count(*) FROM con{k} UNION ALL SELECT 'Fact', count(*) FROM f{k}
UNION ALL SELECT 'RELATED_TO', count(*) FROM e{k} WHERE predicate <> 'economy' UNION ALL SELECT 'ABOUT', count(*) FROM f{k}
UNION ALL SELECT 'MENTIONED_IN', (SELECT count(*) FROM men{k}) + (SELECT count(*) FROM f{k})
UNION ALL SELECT 'PART_OF', (SELECT count(*) FROM customer) * {domains} + (SELECT count(*) FROM dom{k}) + (SELECT count(*) FROM c{k}) + (SELECT count(*) FROM (SELECT DISTINCT subject, object FROM e{k} WHERE predicate = 'economy'))"""


@query(f"""WITH {_STATES}, n0 AS ({_counts_sql(0)}), n1 AS ({_counts_sql(1)}) SELECT n0.kind, n0.n AS first, n1.n AS second FROM n0 JOIN n1 USING (kind)""")
def load_states(spark, d):
    """Counts of a graph after a load, and after one of other knowledge and domain."""
    store, out = GraphStore(spark, scratch(spark, "graph"), buckets=8), None
    for k, name in enumerate(("first", "second")):
        said, domain = rows(spark, d, ORDERS[k], LINES[k]), name
        store.load(said, domain, "model")
        counts = store.counts().withColumnRenamed("n", name)
        out = counts if out is None else out.join(counts, "kind", "full")
    return out


@query(
    f"""WITH {_STATES}, gone AS (SELECT concept FROM con0 WHERE concept NOT IN (SELECT concept FROM con1))
    SELECT 'concepts' AS kind, count(*) AS n FROM gone UNION ALL SELECT 'facts', count(*) FROM f0 WHERE (chunk, line, concept) NOT IN (SELECT (chunk, line, concept) FROM f1)
    UNION ALL SELECT 'edges', (SELECT count(*) FROM men0 WHERE (concept, chunk) NOT IN (SELECT (concept, chunk) FROM men1) AND concept NOT IN (SELECT concept FROM gone))
    + (SELECT count(*) FROM (SELECT * FROM e0 WHERE predicate <> 'economy' EXCEPT SELECT * FROM e1) WHERE subject NOT IN (SELECT concept FROM gone) AND object NOT IN (SELECT concept FROM gone))
    + (SELECT count(*) FROM (SELECT subject, object FROM e0 WHERE predicate = 'economy' EXCEPT SELECT subject, object FROM e1 WHERE predicate = 'economy') WHERE subject NOT IN (SELECT concept FROM gone) AND object NOT IN (SELECT concept FROM gone))"""
)
def prune_by_kind(spark, d):
    """What the second load removes of the first: concepts, facts, and edges between what stays."""
    store = GraphStore(spark, scratch(spark, "graph"), buckets=8)
    store.load(rows(spark, d, ORDERS[0], LINES[0]), "first", "model")
    removed = store.load(rows(spark, d, ORDERS[1], LINES[1]), "second", "model")["removed"]
    return spark.createDataFrame([(k, n) for k, n in removed.items()], "kind string, n long")


@query(
    """WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1)
    SELECT count(*) FILTER (text IS NOT NULL) AS first, 0 AS again, count(*) FILTER (text IS NOT NULL AND turn = 0) AS changed, count(*) AS chunks FROM c"""
)
def load_passages(spark, d):
    """Texts embedded when conversations are loaded as sources, when they are loaded again, and after their first turns changed."""
    turns = table(spark, d, "conversations").where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    chunks = turns.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk"), F.col("conv_id").cast("string").alias("source"), F.col("turn").cast("int").alias("index"), "text")
    sources = turns.select(F.col("conv_id").cast("string").alias("id")).distinct()
    store, embed = GraphStore(spark, scratch(spark, "graph"), buckets=8), ("hashed", embedder(hash_embedding))
    first, again = (store.load_passages(sources, chunks, "talk", embed) for _ in range(2))
    changed = store.load_passages(sources, chunks.withColumn("text", F.when(F.col("index") == 0, F.concat("text", F.lit(" again"))).otherwise(F.col("text"))), "talk", embed)
    return store.table("chunk_vectors").agg(F.lit(first).alias("first"), F.lit(again).alias("again"), F.lit(changed).alias("changed")).crossJoin(store.table("chunks").agg(F.count("*").alias("chunks")))  # one row each


@query(
    """WITH s AS (SELECT s_suppkey AS k FROM supplier), n AS (SELECT CASE WHEN k % 7 = 0 THEN CASE WHEN k % 4 = 0 THEN 'removed' ELSE 'deleted' END WHEN k % 2 = 0 THEN 'updated' ELSE 'unchanged' END AS state, k % 3 = 0 AS moved FROM s UNION ALL SELECT 'created', false FROM nation)
    SELECT state, count(*) AS n, count(*) FILTER (moved) AS moved FROM n GROUP BY state"""
)
def vault_export_states(spark, d):
    """Suppliers are notes; a reader moves some, adds keys and text to others; then some suppliers change or are gone, nations are new, and the vault is exported again with pruning."""
    root, key = scratch(spark, "vault"), F.col("k") % 2 == 0
    first = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("Concepts").alias("folder"), F.concat(F.lit("# "), "s_name").alias("block"), F.lit("supplier").alias("kind"))
    keys = [("note_kind", F.col("kind"))]
    vault.export(spark, first, keys, root)
    k = F.regexp_extract("content", r"note_id: \"s(\d+)\"", 1).cast("long")
    own = vault.read_vault(spark, root).withColumn("k", k)
    text = F.when(F.col("k") % 5 == 0, F.replace("content", F.lit("\n---\n"), F.lit("\nrating: 5\n---\n"))).otherwise(F.col("content"))
    text = F.when(F.col("k") % 4 == 0, F.concat(text, F.lit("\nmine\n"))).otherwise(text)
    by_hand = materialise(own.withColumn("content", text).withColumn("to", F.when(F.col("k") % 3 == 0, F.concat(F.lit("Read/"), "path")).otherwise(F.col("path"))), "by-hand")
    vault.write_vault(by_hand.where("to <> path").select("path", F.lit(None).cast("string").alias("content")), root)
    vault.write_vault(by_hand.select(F.col("to").alias("path"), "content"), root)
    changed = first.where("k % 7 <> 0").withColumn("block", F.when(key, F.concat("block", F.lit(" again"))).otherwise(F.col("block")))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("Concepts").alias("folder"), F.concat(F.lit("# "), "n_name").alias("block"), F.lit("nation").alias("kind"))
    done = vault.export(spark, changed.unionByName(nations), keys, root, prune=True)
    return done.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("path").startswith("Read/")).alias("moved"))
