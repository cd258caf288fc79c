"""Own figures next to published ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import rounded_diff

# Published figures (accuracy in %, AUC per forged kind).
PUBLISHED = [
    ("speech_text", "CREMA", 74.67),
    ("speech_text", "MELD", 68.92),
    ("visual", "CREMA", 86.83),
    ("visual", "MELD", 71.77),
    ("auc_tampering", "CREMA", 0.92),
    ("auc_splice", "CREMA", 0.94),
    ("auc_tampering", "MELD", 0.77),
    ("auc_splice", "MELD", 0.80),
]


def compare(ours: DataFrame, published: DataFrame, keys: Sequence[str], value: str = "ours",
            reference: str = "published", digits: int = 2) -> DataFrame:
    """Own rows with the published value and the rounded difference; unmatched rows stay."""
    return (ours.join(published, list(keys), "left")
            .withColumn("diff", rounded_diff(value, reference, digits)))
