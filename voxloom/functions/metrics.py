"""Overlap metrics as column expressions over tp, fp, fn, tn.

NULL stands for "undefined". Each rule names the empty or full mask that makes
a ratio undefined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.support import div0


def _counts() -> tuple[Column, Column, Column, Column]:
    return F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")


def test_empty() -> Column:
    return F.col("tp") + F.col("fp") == 0


def test_full() -> Column:
    return F.col("tn") + F.col("fn") == 0


def reference_empty() -> Column:
    return F.col("tp") + F.col("fn") == 0


def reference_full() -> Column:
    return F.col("tn") + F.col("fp") == 0


def dice() -> Column:
    tp, fp, fn, _ = _counts()
    return div0(2 * tp, 2 * tp + fp + fn)


def jaccard() -> Column:
    tp, fp, fn, _ = _counts()
    return div0(tp, tp + fp + fn)


def precision() -> Column:
    tp, fp, _, _ = _counts()
    return div0(tp, tp + fp)


def sensitivity() -> Column:
    tp, _, fn, _ = _counts()
    return div0(tp, tp + fn)


def specificity() -> Column:
    _, fp, _, tn = _counts()
    return div0(tn, tn + fp)


def accuracy() -> Column:
    tp, fp, fn, tn = _counts()
    return div0(tp + tn, tp + fp + fn + tn)


def false_omission_rate() -> Column:
    _, _, fn, tn = _counts()
    return div0(fn, fn + tn)


def f_beta(beta: float = 1.0) -> Column:
    """NULL where precision and recall are both zero or undefined."""
    p, r, b2 = precision(), sensitivity(), beta * beta
    return F.when(b2 * p + r != 0, (1 + b2) * p * r / F.when(b2 * p + r != 0, b2 * p + r))


# The metric names of the score report, in report order.
OVERLAP_METRICS: dict[str, Callable[[], Column]] = {
    "False Positive Rate": lambda: 1 - specificity(),
    "Dice": dice,
    "Jaccard": jaccard,
    "Precision": precision,
    "Recall": sensitivity,
    "Accuracy": accuracy,
    "False Omission Rate": false_omission_rate,
    "Negative Predictive Value": lambda: 1 - false_omission_rate(),
    "False Negative Rate": lambda: 1 - sensitivity(),
    "True Negative Rate": specificity,
    "False Discovery Rate": lambda: 1 - precision(),
    "Total Positives Test": lambda: (F.col("tp") + F.col("fp")).cast("double"),
    "Total Negatives Test": lambda: (F.col("tn") + F.col("fn")).cast("double"),
    "Total Positives Reference": lambda: (F.col("tp") + F.col("fn")).cast("double"),
    "total Negatives Reference": lambda: (F.col("tn") + F.col("fp")).cast("double"),
}
SURFACE_METRICS = ("Hausdorff Distance", "Hausdorff Distance 95", "Avg. Surface Distance",
                   "Avg. Symmetric Surface Distance")
