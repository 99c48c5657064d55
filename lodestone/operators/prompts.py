"""What a model is asked and what is taken from its replies: prompts, known names, limits, labels and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T

#: Items that one reply may list, and the label of a reply outside the list of labels.
LIMITS = {"concepts": 12, "relations": 12, "facts": 8}
INVALID = "<invalid>"

REPLY = (
    "concepts array<struct<name: string, aliases: array<string>, type: string, definition: string, confidence: double>>, "
    "relations array<struct<subject: string, predicate: string, object: string, confidence: double>>, facts array<struct<statement: string, concepts: array<string>, confidence: double>>"
)


def limited(reply, schema: str = REPLY) -> Column:
    """A JSON reply as a struct with at most as many items of each kind as LIMITS allows; what is no object is null."""
    r = F.from_json(T.col(reply), schema)
    return F.when(r.isNotNull(), F.struct(*[F.slice(r[k], 1, n).alias(k) for k, n in LIMITS.items()]))


def known_names(chunks: DataFrame, most: int = 60) -> DataFrame:
    """chunks (source, index, names) with `known`: the last `most` distinct names of earlier chunks of the source, in the order of their first use.

    First uses are numbered within the source, and each chunk fetches the numbers before it by key, so no list outgrows `most`.
    """
    said = chunks.select("source", "index", F.posexplode("names").alias("k", "name"))
    first = said.groupBy("source", "name").agg(F.min(F.struct("index", "k")).alias("at"))
    order = W.partitionBy("source").orderBy("at.index", "at.k", "name")
    numbered = first.withColumn("n", F.row_number().over(order))
    new = numbered.groupBy("source", F.col("at.index").alias("index")).agg(F.count("*").alias("new"))
    before = F.sum(F.coalesce("new", F.lit(0))).over(W.partitionBy("source").orderBy("index").rangeBetween(W.unboundedPreceding, -1))
    upto = chunks.select("source", "index").distinct().join(new, ["source", "index"], "left").select("source", "index", before.alias("last")).where("last > 0")
    wanted = upto.select("source", "index", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("last") - most + 1), F.col("last"))).alias("n"))
    seen = wanted.join(numbered.select("source", F.col("n").cast("long").alias("n"), "name"), ["source", "n"])
    lists = seen.groupBy("source", "index").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias("known"))
    return chunks.join(lists, ["source", "index"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def extraction_prompt(title, place, known, text) -> Column:
    """Source and place, the names in use if there are any, and the passage."""
    names = F.when(F.size(T.col(known)) > 0, F.concat(F.lit("Names in use so far, to be kept for the same idea: "), F.array_join(T.col(known), ", ")))
    return F.concat_ws("\n\n", F.concat(F.lit("Source: "), T.col(title), F.lit(" ("), T.col(place), F.lit(")")), names, F.concat(F.lit("Passage:\n"), T.col(text)))


def label_of(reply, labels: list[str], field: str = "domain") -> Column:
    """The label that a JSON reply names; a failed call, a missing field or another word is INVALID."""
    said = F.get_json_object(T.col(reply), f"$.{field}")
    return F.when(said.isin(labels), said).otherwise(F.lit(INVALID))


def totals(results: DataFrame, by: str = "source") -> DataFrame:
    """Tokens and seconds of results (prompt_tokens, completion_tokens, seconds, error) and how many failed."""
    return results.groupBy(by).agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("seconds").alias("seconds"), F.count("error").alias("failed"))


def dropped_by_reason(results: DataFrame) -> DataFrame:
    """(reason, n) summed over `dropped`, a map of counts in each result."""
    return results.select(F.explode("dropped").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))
