"""Evaluate segmentations and choose the model to submit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import components, evaluate, selection, tiles
from voxloom.operators.geometry import Dims
from voxloom.support import materialize


def evaluate_cases(test: DataFrame, reference: DataFrame, keys: Sequence[str], test_label: str, reference_label: str,
                   labels: Mapping[str, Sequence[int]], cells: int) -> DataFrame:
    """Long score table of all cases; fails if a case exists on one side only."""
    case = keys[0]
    lonely = evaluate.unmatched_cases(test, reference, case).limit(20).collect()
    if lonely:
        raise ValueError(f"cases without a partner: {[(r[case], r['missing_in']) for r in lonely]}")
    pairs = evaluate.pair_counts(reference, test, keys, reference_label, test_label)
    return evaluate.metric_table(evaluate.confusion(pairs, keys, labels, cells), keys)


def object_limits(labelled: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Per class the largest removed and the smallest kept object of
    largest-object filtering, over all cases."""
    group = [*keys, label]
    sizes = materialize(components.component_sizes(labelled, keys, label))
    kept = components.largest(sizes, group).withColumn("kept", F.lit(True))
    marked = sizes.join(kept.select(*group, "component", "kept"), [*group, "component"], "left")
    return marked.groupBy(label).agg(F.max(F.when(F.col("kept").isNull(), F.col("voxels"))).alias("largest_removed"),
                                     F.min(F.when(F.col("kept"), F.col("voxels"))).alias("smallest_kept"))


def ensemble_segmentation(probabilities: DataFrame, models: Sequence[int], model: str, keys: Sequence[str],
                          cls: str = "class", p: str = "p") -> DataFrame:
    """Class of the mean probability of all models; fails unless every model
    delivered every case's values."""
    kept = probabilities.where(F.col(model).isin(list(models)))
    mean = kept.groupBy(*keys, cls).agg(F.avg(F.col(p).cast("double")).alias(p), F.count("*").alias("_n"))
    checked = mean.withColumn(p, F.when(F.col("_n") == len(models), F.col(p)).otherwise(
        F.raise_error(F.lit("a model misses a value of the ensemble")).cast("double"))).drop("_n")
    return tiles.argmax_class(checked, keys, cls, p)


def choose_model(scores: DataFrame, model: str, label: str, value: str) -> DataFrame:
    """Foreground mean per model and the best of them."""
    means = scores.groupBy(model, label).agg(F.avg(value).alias(value))
    ranked = evaluate.foreground_mean(means, [model], label, value)
    return selection.best_models(ranked.withColumn("_all", F.lit(0)), ["_all"], model, "foreground").drop("_all")


def consolidate_folds(folds: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Predictions of all validation folds as one set; a case may occur once only."""
    tagged = [f.withColumn("fold", F.lit(i)) for i, f in enumerate(folds)]
    out = tagged[0]
    for fold in tagged[1:]:
        out = out.unionByName(fold)
    twice = out.groupBy(keys[0]).agg(F.count_distinct("fold").alias("_n")).where(F.col("_n") > 1).limit(5).collect()
    if twice:
        raise ValueError(f"cases in several folds: {[r[keys[0]] for r in twice]}")
    return out


def mean_dice(reference: DataFrame, test: DataFrame, keys: Sequence[str], reference_label: str, test_label: str,
              classes: Sequence[int], cells: int | None) -> DataFrame:
    """(label, dice): mean over the cases where the Dice is defined."""
    pairs = evaluate.pair_counts(reference, test, keys, reference_label, test_label)
    counts = evaluate.confusion(pairs, keys, {str(c): [c] for c in classes}, cells)
    return (counts.groupBy(F.col("label").cast("int").alias("label"))
            .agg(F.avg(evaluate.dice_with_policy("undefined")).alias("dice")))


def determine_postprocessing(predicted: DataFrame, reference: DataFrame, keys: Sequence[str], label: str,
                             reference_label: str, dims: Dims, classes: Sequence[int], threshold: float = 0.0,
                             ) -> DataFrame:
    """Which largest-object filters help: first all foreground as one, then class by class.

    One row for the joint step (label NULL) and one per class with the Dice
    before and after. The class steps start from the result of the joint step if
    that is applied.
    """
    cells = None if isinstance(dims, DataFrame) else dims[0] * dims[1] * dims[2]
    predicted = materialize(predicted.where(F.col(label).isin(list(classes))))
    joint = materialize(components.keep_largest_per_group(predicted, keys, label, dims, [list(classes)]))
    score = lambda df: materialize(mean_dice(reference, df, keys, reference_label, label, classes, cells))
    raw, all_dice = score(predicted), score(joint)
    decision = evaluate.postprocess_decision(raw, all_dice, classes, threshold)
    use_joint = bool(decision.first()["apply"])
    source, base = (joint, all_dice) if use_joint else (predicted, raw)
    single = components.keep_largest_per_group(source, keys, label, dims, [[c] for c in classes])
    per_class = score(single).select("label", F.col("dice").alias("after"))
    rows = (base.select("label", F.col("dice").alias("before")).join(per_class, "label")
            .withColumn("apply", F.col("after") > F.col("before") + threshold))
    first = decision.select(F.lit(None).cast("int").alias("label"), "before", "after", "apply")
    return first.unionByName(rows.select("label", F.round("before", 6).alias("before"),
                                         F.round("after", 6).alias("after"), "apply"))
