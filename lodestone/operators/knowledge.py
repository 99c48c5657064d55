"""The concept graph as tables: evidence per mention and relation, traversals, naming, and dictionary links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.automaton import linked, spans  # noqa: F401  dictionary links are part of the graph
from lodestone.sources.scratch import materialise


def first_seen(value: str, position) -> Column:
    """Values in the order of their positions, after a grouping that left each once."""
    return F.transform(F.array_sort(F.collect_list(F.struct(T.col(position).alias("p"), F.col(value).alias("v")))), lambda x: x["v"])


def collapse_mentions(mentions: DataFrame) -> DataFrame:
    """(concept, chunk, n, confidence, start, surfaces) from mentions (concept, chunk, surface, confidence, start, pos).

    The largest confidence, the first start, and surfaces as first seen. Grouping by surface first keeps the arrays as
    short as the number of different surfaces.
    """
    each = mentions.groupBy("concept", "chunk", "surface").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min(F.struct("pos", "start")).alias("first"))
    return each.groupBy("concept", "chunk").agg(F.sum("n").alias("n"), F.max("confidence").alias("confidence"), F.min("first")["start"].alias("start"), first_seen("surface", F.col("first.pos")).alias("surfaces"))


def relation_evidence(relations: DataFrame) -> DataFrame:
    """(subject, predicate, object, chunks, confidence, n) from (subject, predicate, object, chunk, confidence).

    Chunks of a relation are counted before they are gathered; the list itself is the edge's property and as long as its
    evidence, one value a chunk.
    """
    each = relations.where("subject <> object").groupBy("subject", "predicate", "object", "chunk").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    return each.groupBy("subject", "predicate", "object").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"), F.max("confidence").alias("confidence"), F.sum("n").alias("n"))


def facts_per_mention(mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """(concept, chunk, facts): the facts about a concept in each chunk that mentions it, 0 where there are none."""
    n = facts.groupBy("concept", "chunk").agg(F.count("*").alias("facts"))
    return mentions.select("concept", "chunk").distinct().join(n, ["concept", "chunk"], "left").select("concept", "chunk", F.coalesce("facts", F.lit(0)).cast("long").alias("facts"))


def both_ends(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) seen from either end: (node, other, dir)."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("dir"), *[c for c in edges.columns if c not in ("src", "dst")]).unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("dir"), *[c for c in edges.columns if c not in ("src", "dst")])
    )


def majority(rows: DataFrame, by: list[str], value: str, position) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the first seen."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    w = W.partitionBy(*by).orderBy(F.desc("n"), F.asc("first"))
    return counts.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(*by, value, "n")


def canonical_surface(rows: DataFrame, by: str, surface: str) -> DataFrame:
    """The wording a group is named by: the most frequent, then the shortest, then the first in order."""
    counts = rows.groupBy(by, surface).agg(F.count("*").alias("n"))
    w = W.partitionBy(by).orderBy(F.desc("n"), F.length(surface), F.asc(surface))
    return counts.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(by, surface, "n")


def other_forms(forms: DataFrame, by: str, form: str, position: str, name: str) -> DataFrame:
    """(by, aliases): a group's forms as first seen, one for each normalized form, without the name's own."""
    keyed = forms.select(by, form, position, name, T.normalized(form).alias("key"), T.normalized(name).alias("own")).where("key <> own")
    first = keyed.groupBy(by, "key").agg(F.min(F.struct(position, form)).alias("f"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x[form]).alias("aliases"))


def longest_matches(found: DataFrame) -> DataFrame:
    """(doc, concept, a): spans that lie in no span before them in the order of begin, longer first, concept; each concept at its first place."""
    w = W.partitionBy("doc").orderBy("a", F.desc("b"), "concept").rowsBetween(W.unboundedPreceding, -1)
    kept = found.withColumn("covered", F.max("b").over(w)).where("covered is null or covered < b")
    return kept.groupBy("doc", "concept").agg(F.min("a").alias("a"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for edges (u, v): each node's least reachable node, by spreading minima with pointer jumps, each round written to the shared folder.

    Labels are a row a node, whose files are small for their rows: they are never broadcast by their size.
    """
    both = materialise(edges.select("u", "v").union(edges.select("v", "u").toDF("u", "v")).where("u is not null and v is not null").distinct(), "edges")
    label = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(label.hint("merge"), both.v == label.node).groupBy("u").agg(F.min("root").alias("m"))
        spread = label.join(near.hint("merge"), label.node == near.u, "left").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = label.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = materialise(spread.join(up.hint("merge"), "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")), "labels")
        label = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return label
    raise RuntimeError("the components did not settle")


def name_groups(items: DataFrame) -> DataFrame:
    """(item, group) from (item, name, aliases): items with one key, or whose alias is another's name, share their least item."""
    keyed = materialise(items.select("item", T.name_key("name").alias("key"), F.transform("aliases", T.name_key).alias("aliases")), "name-keys")
    first = keyed.groupBy("key").agg(F.min("item").alias("first"))
    same = keyed.join(first, "key").select(F.col("item").alias("u"), F.col("first").alias("v"))
    alias = keyed.select("item", F.explode("aliases").alias("key")).join(first, "key").select(F.col("item").alias("u"), F.col("first").alias("v"))
    roots = components(same.union(alias))
    return items.select("item").join(roots.hint("merge"), F.col("item") == F.col("node")).select("item", F.col("root").alias("group"))
