"""Bounded training samples: the chosen rows travel to the driver with their whole texts, never whole tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .byte_cnn import encode, windows
from .shared import bounded_rows


def sampled_windows(rows: DataFrame, per_class: int) -> tuple[list[np.ndarray], list]:
    """All windows of each sampled row's text (one bag per row) with the rows' labels, in a fixed order.

    ``rows`` has key, label and text. Texts are read whole; ``per_class`` bounds the rows of a label.
    """
    found = bounded_rows(rows, per_class).toPandas()
    found = found.sort_values(["key", "label", "text"], kind="stable")
    return [windows(encode(t)) for t in found["text"]], found["label"].tolist()
