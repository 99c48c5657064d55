"""Merkle manifest of a dataset: level by level, every run of nodes is hashed into a parent; then every row's proof is joined down from the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, table, with_hot
from lodestone.llm.importance import CRC_TABLE_SQL, crc_sql
from lodestone.operators.numbering import numbered

#: Nodes that become one parent, and a leaf's columns in order.
FANOUT, FIELDS = 3, ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: dict[str, Column]) -> Column:
    """Hex SHA-256 of a row's fields, each `-` if null, else its UTF-8 length, a colon and the value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (values[f].cast("string") for f in FIELDS)]), 256)


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above nodes (key, idx, n, hash): of every key with several nodes, each run of fanout neighbours is one parent.

    A group holds fanout rows at most, so no key gathers, however many nodes it has.
    """
    runs = nodes.where("n > 1").groupBy("key", F.expr(f"idx div {fanout}").alias("idx")).agg(F.ceil(F.min("n") / fanout).cast("long").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("run"))
    children = F.transform("run", lambda x: x["hash"])
    return runs.select("key", "idx", "n", F.sha2(F.array_join(children, ""), 256).alias("hash"), children.alias("children"))


def levels(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """nodes and the levels above them, each written; a key's last level has its one node."""
    out, wide = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while wide > 1:
        out.append(materialise(parents(out[-1], fanout), "level"))
        wide = -(-wide // fanout)
    return out


def proofs(tables: list[DataFrame], tops: DataFrame, carried: list[str], fanout: int = FANOUT) -> DataFrame:
    """Level 0 with path and carried; tops (key, level, path, carried) say them for the one node at the end of each key.

    path has, from the node's own level up, what its siblings' hashes are to the left and to the right. From the last level
    down, each joins the one above by (key, idx div fanout) and puts its own siblings before its parent's path.
    """
    out = None
    for level in reversed(range(len(tables))):
        nodes = tables[level]
        now = nodes.where("n = 1").join(tops.where(F.col("level") == level).select("key", "path", *carried), "key")
        if out is not None:
            above = out.select("key", F.col("idx").alias("up"), F.col("children").alias("run"), F.col("path").alias("rest"), *carried)
            at = (F.col("idx") % fanout).cast("int")
            own = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("run", at + 2, F.lit(fanout)), "").alias("right"))
            several = nodes.where("n > 1").withColumn("up", F.expr(f"idx div {fanout}")).join(above, ["key", "up"])
            now = several.select(*nodes.columns, F.concat(F.array(own), "rest").alias("path"), *carried).unionByName(now)
        out = now
    return out


def manifest(docs: DataFrame, fanout: int = FANOUT, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of documents.

    Rows are leaves of their source's tree, by doc_id; the sources' roots, by source, are leaves of the tree above. tampered
    is the text that a verifier holds for a row, if it is not the one under the root: its leaf is folded with the row's
    siblings, and verified says whether the root comes out.

    Null is a source of its own, before all others; a null doc_id is before all others of its source; rows that repeat a
    doc_id follow each other by leaf, and equal rows have equal leaves but places of their own. Empty and very long texts are
    hashed whole. An empty table has no root and no rows. Other columns are ignored, whatever their names. A source that holds
    any share of the rows is numbered by ranges and hashed by runs, so it is never in one task.
    """
    own = {f: F.col(f) for f in FIELDS}
    held = leaf(own | {"text": tampered}) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key"), leaf(own).alias("hash"), held.alias("held"))
    rows = materialise(rows.withColumn("held", F.when(F.col("held") != F.col("hash"), F.col("held"))), "leaves")
    placed = numbered(rows, [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("hash")], "place")
    sources = materialise(placed.groupBy("key").agg(F.min("place").alias("start"), F.count("*").alias("n")), "sources")
    leaves = with_hot(placed, sources, "key", "n").select("key", (F.col("place") - F.col("start")).alias("idx"), "n", "hash", "doc_id", "held")
    trees = levels(materialise(leaves, "level"), fanout)
    subroots = trees[0].where("n = 1").select("key", F.lit(0).alias("level"), "hash")
    for level, nodes in enumerate(trees[1:], 1):
        subroots = subroots.unionByName(nodes.where("n = 1").select("key", F.lit(level).alias("level"), "hash"))
    subroots = numbered(materialise(subroots, "subroots"), ["key"], "idx").withColumnRenamed("key", "source")
    above = levels(materialise(subroots.select(F.lit("").alias("key"), "idx", F.lit(subroots.count()).cast("long").alias("n"), "hash", "source", F.col("level").alias("tree")), "level"), fanout)
    top = above[-1].select("key", F.lit(len(above) - 1).alias("level"), F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("hash").alias("root"))
    tops = materialise(proofs(above, top, ["root"], fanout).select(F.col("source").alias("key"), F.col("tree").alias("level"), "path", "root", F.col("hash").alias("subroot")), "tops")
    rows = proofs(trees, tops, ["root", "subroot"], fanout)
    folded = F.aggregate("path", F.coalesce("held", "hash"), lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    out = rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, held against texts without line ends where 2 divides the CRC-32 of the doc_id."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return manifest(table(spark, sf_dir, "documents"), tampered=F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def _levels_sql(name: str, height: int) -> str:
    """CTEs {name}1 ... {name}height(key, idx, n, h, run) above {name}0(key, idx, n, h); a key's one node is handed up as it is."""
    out = []
    for k in range(height):
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT key, idx // {FANOUT} AS idx, ceil(any_value(n) / {FANOUT})::BIGINT AS n, list(h ORDER BY idx) AS run, "
                   f"CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {name}{k} GROUP BY key, idx // {FANOUT})")
    return ",\n".join(out)


def _fold_sql(name: str, tree: str, height: int) -> str:
    """CTEs {name}1 ... {name}height(id, key, idx, n, fold, proof) from {name}0: each level's siblings around and behind."""
    out = []
    for k in range(height):
        left, right = f"array_to_string(run[: f.idx % {FANOUT}], '')", f"array_to_string(run[f.idx % {FANOUT} + 2 :], '')"
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT id, f.key, f.idx // {FANOUT} AS idx, ceil(f.n / {FANOUT})::BIGINT AS n, CASE WHEN f.n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold, "
                   f"CASE WHEN f.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof FROM {name}{k} f JOIN {tree}{k + 1} t ON f.key = t.key AND f.idx // {FANOUT} = t.idx)")
    return ",\n".join(out)


#: Levels that the SQL unrolls: sources of up to 3**12 rows, and up to 3**8 sources.
_TREE, _ABOVE = 12, 8
_LEAF_SQL = " || ".join(f"coalesce(strlen({x})::VARCHAR || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "text"))
_HELD_SQL = _LEAF_SQL.replace("text", "replace(text, chr(10), '')")
OP13_SQL = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE_SQL}),
leaves AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce('s' || source, 'n') AS key, sha256({_LEAF_SQL}) AS h,
  CASE WHEN doc_id IS NOT NULL AND {crc_sql('doc_id::VARCHAR')} % 2 = 0 THEN sha256({_HELD_SQL}) ELSE sha256({_LEAF_SQL}) END AS held FROM documents, crc),
a0 AS MATERIALIZED (SELECT id, doc_id, key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n, h, held FROM leaves),
{_levels_sql('a', _TREE)},
b0 AS MATERIALIZED (SELECT '' AS key, row_number() OVER (ORDER BY encode(key)) - 1 AS idx, count(*) OVER () AS n, h, key AS source FROM a{_TREE}),
{_levels_sql('b', _ABOVE)},
f0 AS (SELECT id, key, idx, n, held AS fold, '' AS proof FROM a0),
{_fold_sql('f', 'a', _TREE)},
g0 AS (SELECT f.id, '' AS key, b.idx, b.n, fold, proof FROM f{_TREE} f JOIN b0 b ON f.key = b.source),
{_fold_sql('g', 'b', _ABOVE)}
SELECT doc_id, a0.h AS leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.h AS verified
FROM a0 JOIN g{_ABOVE} g USING (id) JOIN a{_TREE} s ON a0.key = s.key, b{_ABOVE} r
"""
