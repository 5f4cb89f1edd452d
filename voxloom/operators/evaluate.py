"""Confusion counts, score tables and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.metrics import OVERLAP_METRICS, dice
from voxloom.support import ZYX, materialize


def pair_counts(reference: DataFrame, test: DataFrame, keys: Sequence[str], ref: str, pred: str) -> DataFrame:
    """Voxels per (case, reference code, predicted code), background as 0."""
    place = [*keys, *ZYX]
    joined = (reference.select(*place, F.col(ref).alias("_r"))
              .join(test.select(*place, F.col(pred).alias("_p")), place, "full"))
    return (joined.groupBy(*keys, F.coalesce("_r", F.lit(0)).alias("ref"), F.coalesce("_p", F.lit(0)).alias("pred"))
            .agg(F.count("*").alias("n")))


def confusion(pairs: DataFrame, keys: Sequence[str], labels: Mapping[str, Sequence[int]],
              cells: int | None) -> DataFrame:
    """tp, fp, fn, tn per case and label; a label may join several codes.

    Works on the per-code counts, so the label list never multiplies voxels.
    ``cells`` is the size of a volume; without it the pairs themselves are taken
    to cover everything, background included.
    """
    options = F.array(*[F.struct(F.lit(name).alias("label"), F.array(*[F.lit(c) for c in codes]).alias("codes"))
                        for name, codes in labels.items()])
    size = F.col("_size")
    in_ref, in_pred = F.array_contains("o.codes", F.col("ref")), F.array_contains("o.codes", F.col("pred"))
    hits = [F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long").alias(name) for name, cond in (
        ("tp", in_ref & in_pred), ("fp", ~in_ref & in_pred), ("fn", in_ref & ~in_pred))]
    hits.append((F.sum("n") if cells is None else F.max(F.lit(cells))).cast("long").alias("_size"))
    return (pairs.withColumn("o", F.explode(options)).groupBy(*keys, F.col("o.label").alias("label")).agg(*hits)
            .withColumn("tn", size - F.col("tp") - F.col("fp") - F.col("fn"))
            .withColumns({
                "test_empty": F.col("tp") + F.col("fp") == 0, "test_full": F.col("tp") + F.col("fp") == size,
                "reference_empty": F.col("tp") + F.col("fn") == 0,
                "reference_full": F.col("tp") + F.col("fn") == size}).drop("_size"))


def metric_table(counts: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None,
                 digits: int | None = None) -> DataFrame:
    """Long score table: one row per case, label and metric name."""
    chosen = names or list(OVERLAP_METRICS)
    show = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), show(OVERLAP_METRICS[n]()).alias("value")) for n in chosen])
    return counts.select(*keys, "label", F.explode(pairs).alias("s")).select(*keys, "label", "s.metric", "s.value")


def score_mean(scores: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean over cases that skips undefined scores."""
    defined = F.when(~F.isnan(value), F.col(value))
    return scores.groupBy(*by).agg(F.round(F.avg(defined), 6).alias(value), F.count(defined).alias("cases"))


def dice_with_policy(policy: str) -> Column:
    """Dice with the rule for empty masks.

    undefined: NULL when both are empty. lenient: 1 when both are empty and 0
    when only the reference is. present: NULL unless the reference holds the label.
    """
    ref_empty, test_empty = F.col("tp") + F.col("fn") == 0, F.col("tp") + F.col("fp") == 0
    if policy == "undefined":
        return dice()
    if policy == "lenient":
        return F.when(ref_empty & test_empty, F.lit(1.0)).when(ref_empty, F.lit(0.0)).otherwise(dice())
    if policy == "present":
        return F.when(~ref_empty, dice())
    raise ValueError(policy)


def strict_mean(value: Column) -> Column:
    """Mean that is undefined as soon as one value is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def region_summary(pairs: DataFrame, case: str, regions: Mapping[str, Sequence[int]], cells: int) -> DataFrame:
    """Dice per region: one row per case, then mean and median, with undefined
    scores skipped and with undefined scores counted as one."""
    scored = confusion(pairs, [case], regions, cells).select(case, "label", dice().alias("d"))
    wide = (scored.groupBy(F.col(case).cast("string").alias("casename"))
            .agg(*[F.max(F.when(F.col("label") == r, F.col("d"))).alias(r) for r in regions]))
    wide = materialize(wide)
    filled = lambda r: F.coalesce(r, F.lit(1.0))
    rows = {"mean": lambda r: F.avg(r), "median": lambda r: F.median(r),
            "mean (nan is 1)": lambda r: F.avg(filled(r)), "median (nan is 1)": lambda r: F.median(filled(r))}
    # one value per case: the medians see as many rows as there are cases
    summary = wide.agg(F.array(*[
        F.struct(F.lit(name).alias("casename"), *[agg(r).alias(r) for r in regions])
        for name, agg in rows.items()]).alias("s")).select(F.inline("s"))
    return wide.unionByName(summary).select("casename", *[F.round(r, 4).alias(r) for r in regions])


def foreground_mean(means: DataFrame, by: Sequence[str], label: str, value: str,
                    background: Sequence[int] = (0, -1, 99)) -> DataFrame:
    return (means.where(~F.col(label).isin(list(background))).groupBy(*by)
            .agg(F.round(F.avg(value), 6).alias("foreground")))


def complete_groups(scores: DataFrame, by: Sequence[str], member: str, expected: Sequence[int]) -> DataFrame:
    """Groups that hold every expected member (fold or task)."""
    return (scores.where(F.col(member).isin(list(expected))).groupBy(*by)
            .agg(F.count_distinct(member).alias("_k")).where(F.col("_k") == len(expected)).drop("_k"))


def fold_mean_of_means(scores: DataFrame, by: Sequence[str], fold: str, folds: Sequence[int]) -> DataFrame:
    kept = scores.join(complete_groups(scores, by, fold, folds), list(by), "left_semi")
    per_fold = kept.groupBy(*by, fold).agg(F.avg("value").alias("_m"))
    return per_fold.groupBy(*by).agg(F.round(F.avg("_m"), 6).alias("mean"))


def fold_pooled(scores: DataFrame, by: Sequence[str], fold: str, folds: Sequence[int]) -> DataFrame:
    kept = scores.join(complete_groups(scores, by, fold, folds), list(by), "left_semi")
    return kept.groupBy(*by).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"))


def all_task_mean(scores: DataFrame, by: Sequence[str], task: str, tasks: Sequence[int]) -> DataFrame:
    """Mean over the required tasks, only for groups that have all of them."""
    kept = scores.where(F.col(task).isin(list(tasks)))
    per_task = kept.groupBy(*by, task).agg(F.avg("value").alias("_m"))
    return (per_task.groupBy(*by).agg(F.count("*").alias("_k"), F.round(F.avg("_m"), 6).alias("mean"))
            .where(F.col("_k") == len(tasks)).drop("_k"))


def micro_dice(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Dice of the summed counts; labels without any voxel are dropped."""
    total = counts.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return total.withColumn("dice", F.round(dice(), 6)).where(F.col("dice").isNotNull())


def batch_dice(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per-batch form, kept finite by 1e-8."""
    total = counts.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return total.withColumn("dice", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + 1e-8), 6))


def soft_confusion(df: DataFrame, keys: Sequence[str], p: Column, y: Column) -> DataFrame:
    """Sums of p*y, p*(1-y), (1-p)*y and (1-p)*(1-y)."""
    terms = {"tp": p * y, "fp": p * (1 - y), "fn": (1 - p) * y, "tn": (1 - p) * (1 - y)}
    return df.groupBy(*keys).agg(*[F.round(F.sum(v), 4).alias(k) for k, v in terms.items()])


def sigmoid_positive(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit)) > 0.5


def unmatched_cases(test: DataFrame, reference: DataFrame, case: str) -> DataFrame:
    """Cases present on one side only, with the side that lacks them."""
    a, b = test.select(case).distinct(), reference.select(case).distinct()
    return (a.join(b, case, "left_anti").withColumn("missing_in", F.lit("reference"))
            .unionByName(b.join(a, case, "left_anti").withColumn("missing_in", F.lit("test"))))


def tolerant_pairs(test: DataFrame, reference: DataFrame, case: str) -> DataFrame:
    """Every reference case with ``predicted``: whether the test set holds it.

    A test case without a reference is an error; an extra reference case is only
    reported.
    """
    joined = (test.select(case).distinct().withColumn("_t", F.lit(True))
              .join(reference.select(case).distinct().withColumn("_r", F.lit(True)), case, "full"))
    alone = F.raise_error(F.concat(F.lit("no reference for case "), F.col(case).cast("string"))).cast("boolean")
    return joined.select(case, F.when(F.col("_r").isNull(), alone).otherwise(F.col("_t").isNotNull()).alias("predicted"))


def threshold_scores(pairs: DataFrame, keys: Sequence[str], code: int, thresholds: Sequence[int]) -> DataFrame:
    """Dice of one class per case and threshold, the class being emptied when
    it holds fewer voxels than the threshold."""
    t = F.explode(F.array(*[F.lit(int(v)) for v in thresholds])).alias("threshold")
    counts = pairs.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long").alias(name) for name, c in (
            ("tp", (F.col("ref") == code) & (F.col("pred") == code)),
            ("fp", (F.col("ref") != code) & (F.col("pred") == code)),
            ("fn", (F.col("ref") == code) & (F.col("pred") != code)))])
    emptied = F.col("tp") + F.col("fp") < F.col("threshold")
    no_ref = F.col("tp") + F.col("fn") == 0
    return counts.select(*keys, "tp", "fp", "fn", t).select(
        *keys, "threshold", emptied.alias("emptied"),
        F.when(emptied, F.when(no_ref, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(dice_with_policy("lenient")).alias("dice"))


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Mean Dice per threshold and whether it is the best (ties: the smallest)."""
    means = scored.groupBy("threshold").agg(F.round(F.avg("dice"), 6).alias("mean_dice"))
    best = means.agg(F.min_by("threshold", F.struct(-F.col("mean_dice"), F.col("threshold"))).alias("_best"))
    return (means.join(best, F.col("threshold") == F.col("_best"), "left")
            .select("threshold", "mean_dice", F.col("_best").isNotNull().alias("best")))


def applied_threshold(best: int, cap: int = 1000, replacement: int = 750) -> int:
    return replacement if best > cap else best


def postprocess_decision(before: DataFrame, after: DataFrame, classes: Sequence[int], threshold: float = 0.0,
                         ) -> DataFrame:
    """Keep the change if one class gains more than ``threshold`` and none loses.

    ``before`` and ``after`` hold label and dice.
    """
    wanted = F.col("label").isin(list(classes))
    both = (before.where(wanted).select("label", F.col("dice").alias("raw"))
            .join(after.where(wanted).select("label", F.col("dice").alias("changed")), "label"))
    gain, loss = F.col("changed") > F.col("raw") + threshold, F.col("changed") < F.col("raw")
    return both.agg(F.round(F.avg("raw"), 6).alias("before"), F.round(F.avg("changed"), 6).alias("after"),
                    F.coalesce(F.bool_or(gain), F.lit(False)).alias("improved"),
                    F.coalesce(F.bool_or(loss), F.lit(False)).alias("worse")) \
        .withColumn("apply", F.col("improved") & ~F.col("worse"))


def close_to(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


