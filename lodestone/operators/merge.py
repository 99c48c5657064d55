"""From extracted items to merged knowledge and to the rows of the graph: groups by name, then by vector, then ids, relations and facts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import knowledge as K
from lodestone.operators.cells import similar_links
from lodestone.sources.scratch import materialise, small

#: Representatives of a tile of the similarity join.
TILE = 1024


def similar_pairs(reps: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(u, v, score): pairs u < v of reps (id, block, name, v) with one block and a cosine of `threshold` or more, unless their names are a contrast.

    A block is dealt to tiles by hash, and each pair of tiles is compared as a matrix, so a block of a third of all rows is
    many bounded tasks. Rows without a vector meet nothing; a zero vector has cosine 0.
    """
    rows = reps.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("block").cast("string").alias("block"), "name", F.col("v").cast("array<double>").alias("v"))
    tiles = rows.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = rows.join(small(tiles), "block").withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("id", "block", "name", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        a, b = part[part["own"] == i], part[part["own"] == j]
        x, y = (np.array(p["v"].tolist(), float).reshape(len(p), -1) for p in (a, b))
        norms = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) if len(a) and len(b) else np.zeros((len(a), len(b)))
        score = np.round(np.divide(x @ y.T, norms, out=np.zeros_like(norms), where=norms > 0), 6) if norms.size else norms
        r, c = np.nonzero(score >= threshold)
        u, v, p, q, s = a["id"].to_numpy()[r], b["id"].to_numpy()[c], a["name"].to_numpy()[r], b["name"].to_numpy()[c], score[r, c]
        keep = u < v if i == j else np.ones(len(u), bool)
        turn = u > v
        return pd.DataFrame({"u": np.where(turn, v, u)[keep], "v": np.where(turn, u, v)[keep], "a": np.where(turn, q, p)[keep], "b": np.where(turn, p, q)[keep], "score": s[keep]})

    found = dealt.groupBy("block", "i", "j").applyInPandas(compare, "u long, v long, a string, b string, score double")
    return found.where(~T.contrast("a", "b")).select("u", "v", "score")


def grouped(items: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(items with their group, one row of statistics). A group is named by its first item.

    First by normalized names and aliases that are another's name; with `embed`, which takes (id, name) and gives (id, v),
    groups of one majority type whose representative names' vectors are that similar join as well.
    """
    named = items.join(K.name_groups(items.select(F.col("pos").alias("item"), "name", "aliases")).withColumnRenamed("item", "pos").hint("merge"), "pos")
    named = materialise(named, "named-items")
    stats = named.agg(F.count("*").alias("mentions"), F.countDistinct("group").alias("after_names"))
    if embed is None:
        return named, stats.withColumn("embedding_merges", F.lit(0).cast("long"))
    kinds = K.majority(named, ["group"], "type", "pos").select("group", F.col("type").alias("block"))
    reps = K.majority(named.withColumn("norm", T.normalized("name")), ["group"], "norm", "pos").join(kinds, "group").select(F.col("group").alias("id"), "block", F.col("norm").alias("name"))
    links = similar_links(reps.join(embed(reps.select("id", "name")), "id"), threshold)
    roots = materialise(K.components(links), "merged-groups")
    out = named.join(roots, F.col("group") == F.col("node"), "left").withColumn("group", F.coalesce("root", "group")).drop("node", "root")
    merges = roots.agg(F.count_if(F.col("node") != F.col("root")).alias("embedding_merges"))
    return out, stats.crossJoin(merges)  # one row each


def _free_ids(rows: pa.Table) -> pa.Table:
    """Ids of the names of one family, in order: the slug, or with the first number from 2 on that no name before has taken."""
    rows = rows.sort_by("group")
    used: set[str] = set()
    after: dict[str, int] = {}
    ids = []
    for slug in rows.column("slug").to_pylist():
        own, n = slug, after.get(slug, 2)
        while own in used:
            own, n = f"{slug}-{n}", n + 1
        used.add(own)
        after[slug] = n
        ids.append(own)
    return pa.table({"group": rows.column("group"), "id": ids})


def numbered_ids(concepts: DataFrame) -> DataFrame:
    """concepts (group, name) with ids: each in the order of groups gets its slug, or the slug with the first number from 2 on that is free.

    A numbered slug can be another name's plain one, but only within a family: slugs that are the same but for numbers at
    their end. Where a family has one slug, places in it are the numbers; only families of several slugs are gone through in
    order, each in one task, since there every id depends on those before.
    """
    slugs = materialise(concepts.select(F.col("group").cast("long").alias("group"), T.slug("name").alias("slug")).withColumn("family", F.regexp_replace("slug", "(-[0-9]+)+$", "")), "slugs")
    mixed = slugs.groupBy("family").agg(F.min("slug").alias("least"), F.max("slug").alias("most")).where("least <> most").select("family")
    k = F.row_number().over(W.partitionBy("slug").orderBy("group"))
    plain = slugs.join(mixed, "family", "left_anti").withColumn("k", k)
    ids = plain.select("group", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("k").cast("string"))).alias("id"))
    free = slugs.join(mixed, "family", "left_semi").groupBy("family").applyInArrow(_free_ids, "group long, id string")
    ids = materialise(ids.unionByName(free), "free-ids")
    return concepts.join(ids.withColumnRenamed("group", "__group"), F.col("group") == F.col("__group")).drop("__group")


def merge_concepts(items: DataFrame, embed=None, threshold: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, mentions, statistics) of items (pos, chunk, source, name, aliases, type, definition, confidence, ...).

    A concept has the wording used most (then shortest, then first in order), the other wordings and aliases as first seen,
    the majority type, the definition of its surest mention (the first of equals), and an id from its name. mentions are the
    items with their concept's id; other columns stay. Items without a name are left out.
    """
    items, stats = grouped(items.where("name is not null"), embed, threshold)
    items = materialise(items, "grouped-items")
    names = K.canonical_surface(items, "group", "name").select("group", "name")
    best = items.groupBy("group").agg(F.max_by("definition", F.struct("confidence", -F.col("pos"))).alias("definition"), F.max("confidence").alias("confidence"), F.count("*").alias("n_mentions"), F.min("pos").alias("first"))
    kinds = K.majority(items, ["group"], "type", "pos").select("group", "type")
    at = lambda kind, pos, k: F.struct(F.lit(kind).alias("kind"), pos.cast("long").alias("pos"), k.cast("int").alias("k"))
    forms = items.select("group", F.col("name").alias("form"), at(0, F.col("pos"), F.lit(0)).alias("at"))
    more = items.select("group", "pos", F.posexplode("aliases").alias("k", "form")).select("group", "form", at(1, F.col("pos"), F.col("k")).alias("at"))
    forms = forms.unionByName(more).join(names.withColumnRenamed("name", "own_name"), "group")
    aliases = K.other_forms(forms, "group", "form", "at", "own_name")
    ids = materialise(numbered_ids(names), "concept-ids")
    concepts = ids.join(best, "group").join(kinds, "group").join(aliases, "group", "left")
    concepts = concepts.select("id", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "type", "definition", "confidence", "n_mentions", "first")
    return concepts, items.join(ids.select("group", F.col("id").alias("concept")), "group").drop("group"), stats


def local_ids(mentions: DataFrame) -> DataFrame:
    """(chunk, name, concept): what a chunk's own name stands for after merging."""
    return mentions.groupBy("chunk", "name").agg(F.max_by("concept", "pos").alias("concept"))


def merge_statistics(stats: DataFrame, concepts: DataFrame, relations: DataFrame, facts: DataFrame) -> DataFrame:
    """The statistics of grouping with the numbers of merged concepts, relations and facts; one row."""
    for name, rows in (("concepts", concepts), ("relations", relations), ("facts", facts)):
        stats = stats.crossJoin(rows.agg(F.count("*").alias(name)))  # one row each
    return stats


def merge_relations(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """relations (chunk, subject, predicate, object, confidence) between merged ids, with their evidence; dangling and reflexive ones go."""
    known = local_ids(mentions).hint("merge")
    side = lambda c: known.select("chunk", F.col("name").alias(c), F.col("concept").alias(f"{c}_id"))
    both = relations.join(side("subject"), ["chunk", "subject"]).join(side("object"), ["chunk", "object"])
    return K.relation_evidence(both.select(F.col("subject_id").alias("subject"), "predicate", F.col("object_id").alias("object"), "chunk", "confidence"))


def merge_facts(facts: DataFrame, mentions: DataFrame) -> DataFrame:
    """facts (fact_pos, chunk, statement, names, confidence) with `concepts`, the ids that their names stand for, once each and in order."""
    named = facts.select("fact_pos", "chunk", F.posexplode("names").alias("k", "name")).join(local_ids(mentions).hint("merge"), ["chunk", "name"])
    first = named.groupBy("fact_pos", "concept").agg(F.min("k").alias("k"))
    about = first.groupBy("fact_pos").agg(K.first_seen("concept", F.col("k")).alias("concepts"))  # names of one fact, a handful
    return facts.drop("names").join(about, "fact_pos", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))


def link_facts(facts: DataFrame, mentions: DataFrame, concepts: DataFrame) -> DataFrame:
    """facts without concepts, linked by their text: the longest names and aliases there of concepts that their chunk mentions, in order."""
    forms = concepts.select(F.col("id").alias("concept"), F.explode(F.array_union(F.array("name"), "aliases")).alias("form")).select("concept", T.tokens("form").alias("form")).distinct()
    texts = facts.select(F.col("fact_pos").alias("doc"), "chunk", T.tokens("statement").alias("tokens"))
    found = K.spans(texts.select("doc", "tokens"), forms).join(texts.select("doc", "chunk"), "doc")
    found = found.join(mentions.select("chunk", "concept").distinct(), ["chunk", "concept"], "left_semi")
    near = K.longest_matches(found.select("doc", "a", "b", "concept"))
    about = near.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "concept"))), lambda x: x["concept"]).alias("linked"))  # concepts of one statement
    return facts.join(about, F.col("fact_pos") == F.col("doc"), "left").drop("doc").withColumn("concepts", F.coalesce("linked", "concepts")).drop("linked")


def build_rows(concepts: DataFrame, mentions: DataFrame, relations: DataFrame, facts: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The rows of the graph: concepts, mentions, relations, part_of and facts, restricted to loaded chunks (chunk, ...).

    Several mentions of a concept in a chunk are one row with every wording; a concept counts all its mentions but only
    loaded chunks; relations need both ends; a fact is there once for each chunk and statement, the first with its concepts
    as the model named them, or as its text does.
    """
    loaded = chunks.select("chunk").distinct()
    own = mentions.join(loaded, "chunk", "left_semi")
    edges = materialise(K.collapse_mentions(own.select("concept", "chunk", F.col("name").alias("surface"), "confidence", "start", "pos")), "mention-edges")
    support = edges.groupBy(F.col("concept").alias("id")).agg(F.count("*").alias("n_chunks"))
    nodes = concepts.join(support, "id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long")))
    kept = both_ends_known(relations, concepts)
    said = facts.join(loaded, "chunk", "left_semi").withColumn("id", T.fact_id("chunk", "statement"))
    said = said.groupBy("id").agg(F.min_by(F.struct(*facts.columns), "fact_pos").alias("f")).select("id", "f.*")
    model = said.where(F.size("concepts") > 0).withColumn("linked_by", F.lit("model"))
    text = link_facts(said.where(F.size("concepts") == 0), edges, concepts).withColumn("linked_by", F.lit("text"))
    return {"chunks": chunks, "concepts": nodes, "mentions": edges, "relations": kept.where("predicate <> 'part_of'"), "part_of": kept.where("predicate = 'part_of'"), "facts": model.unionByName(text)}


def both_ends_known(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Relations whose subject and object are both among the concepts."""
    ids = concepts.select("id")
    return relations.join(ids.withColumnRenamed("id", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("id", "object"), "object", "left_semi")


def check_models(meta: dict, model: str, embed_model: str | None = None, replace: bool = False) -> None:
    """A graph holds the knowledge of one extraction model and the vectors of one embedding model, unless it is replaced."""
    for key, new in (("model", model), ("embed_model", embed_model)):
        if new and not replace and meta.get(key) not in (None, new):
            raise ValueError(f"the graph holds {key} {meta[key]!r}, not {new!r}; replace it to swap")


def first_mentions(mentions: DataFrame) -> DataFrame:
    """(concept, source, chunk, start): where each source first mentions a concept."""
    return mentions.groupBy("concept", "source").agg(F.min_by(F.struct("chunk", "start"), "pos").alias("m")).select("concept", "source", "m.*")


def relation_sentence(name: Column, predicate: Column, other: Column, direction: Column) -> Column:
    return F.when(direction == "out", F.concat_ws(" ", name, predicate, other)).otherwise(F.concat_ws(" ", other, predicate, name))
