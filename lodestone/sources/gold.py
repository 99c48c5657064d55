"""Labelled sets kept as YAML files, and a course manifest joined to what was ingested: rows, and the faults that make a set unusable."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions import text as T

QUERIES = "queries array<struct<id: string, query: string, type: string, answer: string, relevant: string>>, source_id string, sources map<string, string>"
GOLD = "source_id string, title string, concepts array<struct<name: string, aliases: array<string>, type: string, core: boolean, chunks: array<int>>>, relations array<struct<subject: string, predicate: string, object: string, chunks: array<int>>>"


@F.pandas_udf(StringType())
def _as_json(texts: pd.Series) -> pd.Series:
    import yaml

    return texts.map(lambda t: json.dumps(yaml.safe_load(t), default=str))


def yaml_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(file, fields of the schema) of each YAML file of a folder, one document a file. Nested values of string fields stay JSON."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder)
    parsed = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), _as_json(F.col("content").cast("string")).alias("json"))
    return parsed.select("file", F.from_json("json", schema).alias("d")).select("file", "d.*")


def query_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(file, query, text, type, answer, source, index): labels of both file shapes, a list of indexes of one source or lists by source name."""
    docs = yaml_documents(spark, folder, QUERIES)
    q = docs.select("file", "source_id", "sources", F.explode("queries").alias("q"))
    one = F.transform(F.from_json("q.relevant", "array<int>"), lambda i: F.struct(F.col("source_id").alias("source"), i.alias("index")))
    named = F.map_entries(F.from_json("q.relevant", "map<string, array<int>>"))
    many = F.flatten(F.transform(named, lambda e: F.transform(e["value"], lambda i: F.struct(F.element_at("sources", e["key"]).alias("source"), i.alias("index")))))
    labels = F.when(F.col("sources").isNull(), one).otherwise(many)
    return q.select("file", F.col("q.id").alias("query"), F.col("q.query").alias("text"), F.col("q.type").alias("type"), F.coalesce("q.answer", F.lit("")).alias("answer"), F.inline_outer(labels))


def label_faults(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, fault): queries given twice, without labels, or with a label (source, index) that no chunk (source, index, chunk) has."""
    asked = labels.groupBy("query").agg(F.countDistinct("file", "text").alias("given"), F.count("index").alias("labels"))
    twice = asked.where("given > 1").select("query", F.lit("duplicate").alias("fault"))
    none = asked.where("labels = 0").select("query", F.lit("no passages").alias("fault"))
    lost = labels.where("index is not null").join(chunks.select("source", "index"), ["source", "index"], "left_anti").select("query", F.lit("no such passage").alias("fault")).distinct()
    return twice.union(none).union(lost)


def resolved(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, text, type, answer, chunk), each relevant chunk once; a set with faults is an error that names some."""
    faults = label_faults(labels, chunks).orderBy("query", "fault").take(5)
    if faults:
        raise ValueError("; ".join(f"{r.query}: {r.fault}" for r in faults))
    return labels.join(chunks.select("source", "index", "chunk"), ["source", "index"]).select("query", "text", "type", "answer", "chunk").distinct()


def gold_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(concepts, relations): (source, name, aliases, type, core, chunks) and (source, subject, predicate, object, chunks)."""
    docs = yaml_documents(spark, folder, GOLD)
    concepts = docs.select(F.col("source_id").alias("source"), F.inline("concepts")).withColumn("core", F.coalesce("core", F.lit(False))).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return concepts, docs.select(F.col("source_id").alias("source"), F.inline("relations"))


def gold_faults(concepts: DataFrame, relations: DataFrame, types: list[str], predicates: list[str]) -> DataFrame:
    """(source, item, fault): names given twice, unknown types and predicates, forms of two concepts, relation ends that are no concept."""
    fault = lambda rows, item, said: rows.select("source", F.col(item).alias("item"), F.lit(said).alias("fault"))
    twice = fault(concepts.groupBy("source", "name").count().where("count > 1"), "name", "duplicate name")
    kind = fault(concepts.where(~F.col("type").isin(types)), "type", "unknown type").distinct()
    forms = concepts.select("source", "name", F.explode(F.array_union(F.array("name"), "aliases")).alias("form")).withColumn("form", T.normalized("form"))
    shared = fault(forms.groupBy("source", "form").agg(F.countDistinct("name").alias("n")).where("n > 1"), "form", "form of two concepts")
    said = fault(relations.where(~F.col("predicate").isin(predicates)), "predicate", "unknown predicate").distinct()
    ends = relations.select("source", F.explode(F.array("subject", "object")).alias("name")).distinct()
    loose = fault(ends.join(concepts.select("source", "name"), ["source", "name"], "left_anti"), "name", "end is no concept")
    return twice.union(kind).union(shared).union(said).union(loose)


def manifest_lectures(courses: DataFrame, splits: DataFrame) -> DataFrame:
    """(video, course, domain, lecture, split) of courses (course, domain, split, lectures) and splits (lecture, split).

    Lectures are numbered from 1 by place; a null one is left out and the numbers of others stay. A course's own split wins.
    """
    rows = courses.select("course", "domain", F.col("split").alias("own"), F.posexplode("lectures").alias("k", "video")).withColumn("lecture", F.col("k") + 1).where("video is not null")
    return rows.join(splits, "lecture", "left").select("video", "course", "domain", "lecture", F.coalesce("own", "split").alias("split"))


def corpus(lectures: DataFrame, sources: DataFrame, chunks: DataFrame, least_words: int = 5, clean: Callable = T.clean_lecture) -> DataFrame:
    """(text, domain, course, lecture, split, index): passages of least_words or more of the manifest's lectures, cleaned by `clean`.

    sources (source, video, root): the first root that holds a video wins. chunks (source, index, text).
    """
    first = sources.where("video is not null").withColumn("r", F.row_number().over(W.partitionBy("video").orderBy("root", "source"))).where("r = 1").select("source", "video")
    text = chunks.withColumn("text", clean("text")).where(F.size(T.words("text")) >= least_words)
    return text.join(lectures.join(first, "video"), "source").select("text", "domain", "course", "lecture", "split", "index")


def not_ingested(lectures: DataFrame, sources: DataFrame) -> DataFrame:
    """Lectures of the manifest without a source: a corpus with any is not complete."""
    return lectures.join(sources.select("video"), "video", "left_anti")


def checked_corpus(lectures: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """`corpus`, or an error that names lectures without a split or without a source."""
    loose = lectures.where("split is null").orderBy("video").take(5)
    lost = not_ingested(lectures, sources).orderBy("video").take(5)
    if loose or lost:
        raise ValueError(f"lectures without a split: {[r.video for r in loose]}, not ingested: {[r.video for r in lost]}")
    return corpus(lectures, sources, chunks)
