"""Quality classifier: a byte-level convolutional network over overlapping chunks of the whole document.

Learned filters slide over every chunk and keep their maxima; the maxima are combined over the chunks
(their mean shows how varied the text is throughout, their maximum what occurs anywhere) into one
probability that the document is good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_cnn import ByteCnn, scored, train
from .shared import class_sample, fold
from .training import sampled_windows

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Bound of the training sample: documents per label, read whole.
PER_LABEL = 1500


def train_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> tuple[ByteCnn, float]:
    """Network, and the log-odds to add so that scores follow the labels' own share rather than the balanced sample's."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT))
    share = {r["label"]: r["count"] for r in marked.groupBy("label").count().limit(2).collect()}
    sample = class_sample(marked, "label", "doc_id", per_label)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(sample, "doc_id")
    bags, y = sampled_windows(rows.select(F.col("doc_id").alias("key"), "label", "text"), per_label)
    y = np.array(y, np.int64)
    shift = float(np.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1)) - np.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1)))
    return train(bags, y, 2, whole_max=True), shift


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``; learned from labels outside the held-out fold.

    Defined cases: null and empty texts are scored as empty; label rows with null id or mark are left out;
    without usable labels all scores are 0.5; repeated rows are scored each; held_out is null where the
    id is; very long texts are read whole, chunk by chunk; other columns are ignored, so their names can't clash; an empty table gives an empty result.
    """
    net, shift = train_quality(docs, labels, label_col, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in scored(batches, net):
            z = np.log(np.maximum(p[:, 1], 1e-12)) - np.log(np.maximum(p[:, 0], 1e-12)) + shift
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    scores = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, score double")
    return scores.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
