"""What long runs keep: transcripts, replies of a model, questions, knowledge and scores, each written so that a retry adds nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.training import without_meta

TRANSCRIPT = "source_id string, model string, language string, segments array<struct<text: string, start: double, end: double>>"


def write_transcripts(transcripts: DataFrame, root: str) -> None:
    """transcripts (source_id, model, language, segments): those of the sources here are replaced, others stay."""
    transcripts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").json(f"{root}/transcripts")


def cached_transcripts(spark: SparkSession, root: str, model: str) -> DataFrame:
    """Transcripts that this model made."""
    return spark.read.schema(TRANSCRIPT).json(f"{root}/transcripts").where(F.col("model") == model)


def transcript_blocks(transcripts: DataFrame) -> DataFrame:
    """(source_id, pos, text, start, end), one block a segment."""
    return transcripts.select("source_id", F.posexplode("segments").alias("pos", "s")).select("source_id", "pos", "s.*")


def to_transcribe(media: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """Media without a transcript of the model. Chunks may be made anew from cached ones; `force` asks for new transcripts, too."""
    return media if force else media.join(cached.select("source_id"), "source_id", "left_anti")


def append_results(results: DataFrame, root: str, batch: str) -> None:
    """Results of one batch of work as JSON lines below their batch: running the batch again replaces its own lines alone."""
    results.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(root)


def usable_results(results: DataFrame, version: int) -> DataFrame:
    """One good result (chunk, prompt_version, error, batch, ...) of this version a chunk, the latest batch's; errors are tried again."""
    good = results.where((F.col("prompt_version") == version) & F.col("error").isNull())
    return good.groupBy("chunk").agg(F.max_by(F.struct(*good.columns), "batch").alias("r")).select("r.*")


def saved_questions(spark: SparkSession, root: str) -> DataFrame:
    """(chunk, pos, type, question) of saved replies; an empty reply gives no row here, but stands for an answered chunk in the file."""
    rows = spark.read.schema("chunk string, questions array<struct<type: string, question: string>>").json(root)
    return without_meta(rows.select("chunk", F.posexplode("questions").alias("pos", "q")).select("chunk", "pos", "q.*"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Training pairs as JSON lines, in place of older ones."""
    pairs.write.mode("overwrite").json(path)


def write_knowledge(tables: dict[str, DataFrame], root: str) -> None:
    """A merged graph, one Parquet table a kind."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}")


def read_knowledge(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def keep_scores(scores: DataFrame, root: str, method: str) -> None:
    """One method's scores as soon as they are there; a later failure loses none, and running the method again replaces its own."""
    append_results(scores, root, method)
