"""Connected components by alternating stars; each round is a grouping and a join, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise


def _least(edges: DataFrame) -> DataFrame:
    """For each node u of the two-column frame (u, v): v and the least of u and its neighbours."""
    low = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(low, "u").select("u", "v", "m")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of edges (u, v) reaches. Nodes without edges are not listed.

    Large stars link a node's larger neighbours to the least one; small stars link the smaller ones. Both only need each
    node's minimum, so no neighbourhood is gathered. It ends when a round changes no edge; nulls in edges are dropped.
    """
    now = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    now = materialise(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large.where("u > v"))
        now = materialise(
            small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct(),
            "edges",
        )
    else:
        raise RuntimeError("the components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(now.select("v", "v").distinct().toDF("node", "root")).groupBy("node").agg(F.min("root").alias("root"))
