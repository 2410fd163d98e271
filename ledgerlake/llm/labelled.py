"""Folds by checksum of the id, and bounded samples of labelled rows for fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a NULL id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % by


def sample(labels: DataFrame, label: str, fold: Column, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and 0/1 labels of at most `rows` labelled ids of the fold.

    Which ones is decided by a hash of the id, so any input of any size is sampled alike. NULL ids
    and labels are left out; of contradicting labels of one id the larger counts.
    """
    found = (
        labels.where(fold & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .toPandas()
        .sort_values("doc_id")
    )
    return found["doc_id"].to_numpy(np.int64), found["y"].to_numpy(np.int64)


def look_up(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted id among the ascending ids, or -1."""
    if not len(ids):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[at] == wanted, at, -1)


def long_ids(column) -> np.ndarray:
    """An Arrow column of ids as numbers; NULL becomes the smallest number, which labels never hold."""
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
