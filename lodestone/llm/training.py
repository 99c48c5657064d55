"""What the two classifiers share: the labelled sample, splits and exact brute figures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, materialise

#: Labelled rows that a classifier is fitted on at most: those whose ids hash lowest.
MOST_LABELLED = 8_000


def held_out():
    """True for the fold that no fit sees: crc32 of the id as text is a multiple of 5. A null id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled documents outside the held-out fold, written to the shared folder.

    Rows without a label are left out; of several labels of one id the larger counts. Only the bounded label rows are
    broadcast; documents are not shuffled.
    """
    bounded(docs)
    chosen = (
        labels.select("doc_id", F.col(column).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"), "labelled")


def calibration_fold(doc_ids: np.ndarray) -> np.ndarray:
    """True for a fifth of the training rows, by id: temperature and isotonic steps are fitted there."""
    x = doc_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)) % np.uint64(5) == 0


def auc(label: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve; ties count half; 0.5 with one class only."""
    _, inverse, count = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(count) - (count - 1) / 2)[inverse]
    pos = int(label.sum())
    return float((ranks[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))) if 0 < pos < len(label) else 0.5
