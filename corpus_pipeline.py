"""A corpus in five stages: quality, near copies, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, ngram_join, packing, quality, secrets
from lodestone.llm.common import materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Rows are decided by their own text, whatever their doc_id; null and empty texts are scored as empty ones, repeated rows
    stay or go alike, very long texts are scored whole, an empty table stays empty, and all columns are kept as they are.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


#: Words of a shingle and similarity in hundredths from which two documents are near copies.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that links of the shingle join hold together, one row stays: that with the smallest doc_id.

    Rows are decided by doc_id and text: unlike texts of one doc_id stay or go apart. Of several texts of that doc_id in the
    group the one with the least fingerprint and hash stays; of rows that repeat it, the least. Rows without words or id stay.
    """
    found = materialise(ngram_join.similar_documents(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT).where("n_shingles > 0 and doc_id is not null").drop("n_shingles"), "similar")
    best = "doc_id = component_id and node = component_node"
    several = materialise(found.where(best).groupBy("doc_id", "node").agg(F.min("text_hash").alias("least"), F.count("*").alias("rows")).where("rows > 1"), "several")
    others = found.where(best).join(several, ["doc_id", "node"]).where("text_hash <> least")
    gone = found.where(f"not ({best})").unionByName(others.select(*found.columns)).select("doc_id", "text_hash").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    kept = keyed.join(gone, ["doc_id", "text_hash"], "left_anti")
    again = several.select("doc_id", F.col("least").alias("text_hash"))
    once = kept.join(again, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.min("row").alias("row"))
    return kept.join(again, ["doc_id", "text_hash"], "left_anti").select("row.*").union(once.select("row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, block_bytes: int = decontamination.BLOCK_BYTES) -> DataFrame:
    """Rows whose own text benchmark passages contaminate go, whatever their doc_id; the others stay as they are."""
    found = decontamination.contaminated_texts(docs, table(spark, sf_dir, "benchmark"), block_bytes=block_bytes)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.md5("text").alias("text_md5"))
    return keyed.join(found, "text_md5", "left_anti").select("row.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays.

    n_chars becomes the length of the new text; null texts and texts without secrets stay as they are, as do null ids, repeated
    rows and other columns; an empty table stays empty.
    """
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone, null ids stay null, repeated rows are packed as often as they come, an empty
    table gives no rows, and other columns end here.
    """
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near copies", near_copies_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("packing", packing_stage)]
#: Classifier, similarity components and tokens are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
