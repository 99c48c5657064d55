"""Cleaning of what a model extracts from a chunk, as tables, with the reasons of what is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.scratch import materialise

#: What a reply holds, and how many items of each kind a model is asked for at most.
REPLY = (
    "concepts array<struct<name: string, aliases: array<string>, type: string, definition: string, confidence: double>>, "
    "relations array<struct<subject: string, predicate: string, object: string, confidence: double>>, facts array<struct<statement: string, concepts: array<string>, confidence: double>>"
)
CAPS = {"concepts": 12, "relations": 12, "facts": 8}
_SIGNS = ".,;:\"'`"
_BRACKETS = r"^(.+?)\s*\(([^()]+)\)\s*$"


def clean_name(raw) -> Column:
    """struct(name, alias): a trimmed name, and what stands behind it in brackets or null."""
    s = F.btrim(T.collapse(F.coalesce(T.col(raw), F.lit(""))), F.lit(_SIGNS))
    split = s.rlike(_BRACKETS)
    return F.struct(F.when(split, F.trim(F.regexp_extract(s, _BRACKETS, 1))).otherwise(s).alias("name"), F.when(split, F.trim(F.regexp_extract(s, _BRACKETS, 2))).alias("alias"))


def _once(names: Column) -> Column:
    """An array without what stands earlier in it in any case."""
    return F.filter(names, lambda x, i: ~F.exists(F.slice(names, 1, i), lambda y: F.lower(y) == F.lower(x)))


def cleaned(replies: DataFrame) -> dict[str, DataFrame]:
    """Tables concepts, relations, facts and drops (chunk_id, reason, n) of replies (chunk_id, reply as JSON).

    Each name counts once in a chunk, whatever its case; relations and facts name concepts of their chunk by any of their
    forms, the first to have it. A reply that is no such object counts as an empty extraction. All joins are by chunk.
    """
    own = replies.select("chunk_id", F.from_json(F.coalesce("reply", F.lit("{}")), REPLY).alias("r"))
    items = lambda kind: own.select("chunk_id", F.posexplode(f"r.{kind}").alias("pos", "x"))
    nth = lambda *by: F.row_number().over(W.partitionBy("chunk_id", *by).orderBy("pos"))

    named = items("concepts").withColumn("c", clean_name("x.name")).select("chunk_id", "pos", "x", F.col("c.name").alias("name"), F.col("c.alias").alias("alias"), F.lower("c.name").alias("key"))
    named = materialise(named.withColumn("reason", F.when(F.col("name") == "", "empty").when(nth("key") > 1, "duplicate")), "extracted-names")
    more = F.transform(F.coalesce("x.aliases", F.array().cast("array<string>")), lambda a: clean_name(a)["name"])
    usable = F.filter(F.concat(F.array_compact(F.array("alias")), more), lambda a: (a != "") & (F.lower(a) != F.col("key")))
    concepts = named.where("reason is null").withColumn("aliases", usable).withColumn("aliases", _once(F.col("aliases")))
    concepts = concepts.select("chunk_id", "pos", "name", "aliases", *[F.col(f"x.{c}").alias(c) for c in ("type", "definition", "confidence")])
    forms = concepts.select("chunk_id", "pos", "name", F.posexplode(F.concat(F.array("name"), "aliases")).alias("k", "form"))
    forms = materialise(forms.groupBy("chunk_id", F.lower("form").alias("form")).agg(F.min_by("name", F.struct("pos", "k")).alias("known")), "extracted-forms")

    ends = items("relations").select("chunk_id", "pos", "x", *[F.lower(clean_name(f"x.{c}")["name"]).alias(f"{c}_form") for c in ("subject", "object")])
    for c in ("subject", "object"):
        ends = ends.join(forms.select("chunk_id", F.col("form").alias(f"{c}_form"), F.col("known").alias(c)), ["chunk_id", f"{c}_form"], "left")
    usable = F.col("subject").isNotNull() & F.col("object").isNotNull() & (F.col("subject") != F.col("object"))
    ends = ends.withColumn("predicate", F.col("x.predicate"))
    reason = F.when(F.col("subject").isNull() | F.col("object").isNull(), "dangling").when(F.col("subject") == F.col("object"), "self_relation").when(nth(usable, "subject", "predicate", "object") > 1, "duplicate")
    ends = ends.withColumn("usable", usable).withColumn("reason", reason)
    relations = ends.where("reason is null").select("chunk_id", "pos", "subject", "predicate", "object", F.col("x.confidence").alias("confidence"))

    said = items("facts").select("chunk_id", "pos", "x", T.collapse(F.coalesce("x.statement", F.lit(""))).alias("statement"))
    said = said.withColumn("reason", F.when(F.col("statement") == "", "empty"))
    about = said.where("reason is null").select("chunk_id", "pos", F.posexplode("x.concepts").alias("k", "form")).withColumn("form", F.lower("form")).join(forms, ["chunk_id", "form"])
    about = about.groupBy("chunk_id", "pos", "known").agg(F.min("k").alias("k")).groupBy("chunk_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "known"))), lambda x: x["known"]).alias("concepts"))
    facts = said.where("reason is null").join(about, ["chunk_id", "pos"], "left").select("chunk_id", "pos", "statement", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"), F.col("x.confidence").alias("confidence"))

    gone = named.select("chunk_id", "reason").unionByName(ends.select("chunk_id", "reason")).unionByName(said.select("chunk_id", "reason")).where("reason is not null")
    return {"concepts": concepts, "relations": relations, "facts": facts, "drops": gone.groupBy("chunk_id", "reason").agg(F.count("*").alias("n"))}
