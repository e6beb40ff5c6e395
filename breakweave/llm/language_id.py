"""Language identification by a byte convolutional network.

Filters of widths 2, 3 and 4 over embedded bytes, maximum pooling in fixed-length windows, softmax over
the languages. A text's windows are scored in batches and their scores averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_cnn import ByteCnn, scored, train
from .shared import fold
from .training import sampled_windows

FOLDS, HELD_OUT = 4, 2
#: Bound of the training sample: documents per language, read whole.
PER_LANGUAGE = 500
UNKNOWN = "und"


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[ByteCnn, list[str]]:
    """Network and its languages, from rows with text and language outside the held-out fold."""
    rows = docs.select(F.col(id_col).alias("key"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("text").rlike(r"\p{L}") & (fold("key", FOLDS) != HELD_OUT))
    bags, names = sampled_windows(rows, per_language)
    languages = sorted(set(names))
    labels = np.array([languages.index(n) for n in names], np.int64)
    return train(bags, labels, max(1, len(languages)), whole_max=False), languages or [UNKNOWN]


def predict_languages(docs: DataFrame, net: ByteCnn, languages: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``; ``und`` (score 0) if the text is null or has no letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in scored(batches, net):
            letters = np.asarray(batch.column(2).fill_null(False))
            names = [languages[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(letters, p.max(axis=1), 0.0))], ["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    return source.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``; learned from the rows not held out.

    Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with a null id
    are never learned from and held_out is null for them; a table without any labelled row gives ``und``
    throughout; repeated rows are predicted each; very long texts are read whole, window by window; other columns are
    ignored, so their names can't clash; an empty table gives an empty result.
    """
    net, languages = train_languages(docs, id_col, text_col, lang_col)
    return predict_languages(docs, net, languages, id_col, text_col).select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language can't be told (``und``, or a score under ``least``).

    Every row is decided by its own text and keeps all its columns, of any type and name.

    Defined cases: null texts and texts without a letter go; a null id and very long texts are handled
    like any other; repeated rows and rows with equal texts share one decision; a table without any
    labelled row is dropped whole (nothing can be told); an empty table gives an empty result.
    """
    net, languages = train_languages(docs, id_col, text_col, lang_col)
    known = languages != [UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in scored(batches, net):
            letters = np.asarray(batch.column(2).fill_null(False))
            yield batch.select([0]).filter(pa.array(letters & known & (p.max(axis=1) >= least)))

    # The row travels as one struct, so that none of its columns can clash with what is added here.
    whole = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    return whole.mapInArrow(run, whole.select("row").schema).select("row.*")
