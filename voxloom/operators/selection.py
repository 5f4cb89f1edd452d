"""Model ranking, training-curve bookkeeping and data splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.functions.ranking import rank_in_buckets

# Fixed value: worst possible distance, used to turn distances into scores.
WORST_DISTANCE = 373.129


def distance_as_score(distance: Column) -> Column:
    return F.lit(WORST_DISTANCE) - distance


def rank_average(scores: DataFrame, competitor: str, metric: str, case: str, value: str) -> DataFrame:
    """Rank per metric and case, mean over cases, mean over metrics, final rank.

    The rank windows hold one row per competitor.
    """
    order = W.partitionBy(metric, case).orderBy(F.desc(value))
    per_metric = (scores.withColumn("_r", F.rank().over(order)).groupBy(competitor, metric)
                  .agg(F.avg("_r").alias("_m")))
    overall = per_metric.groupBy(competitor).agg(F.round(F.avg("_m"), 6).alias("mean_rank"))
    return overall.withColumn("final_rank", F.rank().over(W.orderBy("mean_rank")))


def rank_candidates(scores: DataFrame, candidates: Sequence[str], candidate: str, dataset: str, value: str,
                    ) -> DataFrame:
    """Best configuration per dataset, rank per dataset (0 is best), mean rank.

    A candidate without a result on a dataset scores 0 there. Ties fall to the
    candidate name. The score map of a dataset has one entry per candidate.
    """
    best = scores.groupBy(dataset, candidate).agg(F.max(value).alias("best"))
    names = F.explode(F.array(*[F.lit(c) for c in candidates])).alias(candidate)
    maps = best.groupBy(dataset).agg(F.map_from_entries(F.collect_list(F.struct(candidate, "best"))).alias("_m"))
    dense = (maps.select(dataset, "_m", names)
             .select(dataset, candidate, F.coalesce(F.col("_m")[F.col(candidate)], F.lit(0.0)).alias("best")))
    order = W.partitionBy(dataset).orderBy(F.desc("best"), candidate)
    ranked = dense.withColumn("_r", F.row_number().over(order) - 1)
    return (ranked.groupBy(candidate).agg(F.round(F.avg("_r"), 6).alias("mean_rank"), F.count("*").alias("datasets"))
            .withColumn("winner", F.row_number().over(W.orderBy("mean_rank", candidate)) == 1))


def best_models(means: DataFrame, by: Sequence[str], model: str, value: str) -> DataFrame:
    """All models at the maximum; ``chosen`` marks the last of them by name."""
    top = W.partitionBy(*by).orderBy(F.desc(value))
    best = means.withColumn("_r", F.rank().over(top)).where(F.col("_r") == 1).drop("_r")
    return best.withColumn("chosen", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(model))) == 1)


def model_pairs(probabilities: DataFrame, model: str, models: Sequence[int], keys: Sequence[str], value: str,
                ) -> DataFrame:
    """Mean probability of every unordered pair of the given models.

    Each row is sent to the pairs its model belongs to, so nothing is joined.
    Only pairs for which both models delivered a value are kept.
    """
    pairs = list(combinations(sorted(models), 2))
    member = F.explode(F.filter(
        F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in pairs]),
        lambda p: (p["first"] == F.col(model)) | (p["second"] == F.col(model)))).alias("pair")
    return (probabilities.select(member, *keys, value)
            .groupBy(F.col("pair.first").alias("first"), F.col("pair.second").alias("second"), *keys)
            .agg(F.avg(value).alias(value), F.count("*").alias("_n")).where(F.col("_n") == 2).drop("_n"))


def _series(df: DataFrame, run: Sequence[str], step: str, value: str) -> DataFrame:
    # one entry per training epoch
    return df.groupBy(*run).agg(F.sort_array(F.collect_list(F.struct(F.col(step), F.col(value)))).alias("_s"))


def _scan(curve: DataFrame, run: Sequence[str], step: str, value: str, made: str,
          walk: Callable[[np.ndarray, np.ndarray], pd.DataFrame]) -> DataFrame:
    """Walk each run's curve once in the order of its steps; a run holds one row per epoch or iteration."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([step, value], kind="stable")
        out = walk(pdf[step].to_numpy(), pdf[value].to_numpy(dtype=float))
        for k, name in enumerate(run):
            out.insert(k, name, pdf[name].iloc[0])
        return out
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in curve.select(*run).schema)
    return curve.select(*run, step, F.col(value).cast("double").alias(value)).groupBy(*run).applyInPandas(
        one, f"{keys}, {made}")


def moving_average(curve: DataFrame, run: Sequence[str], step: str, value: str, alpha: float) -> DataFrame:
    """ma = alpha * ma + (1 - alpha) * new, starting at the first value."""
    def walk(steps: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        out = values.copy()
        for k in range(1, len(out)):
            out[k] = out[k - 1] * alpha + values[k] * (1 - alpha)
        return pd.DataFrame({step: steps, "ma": out})
    kind = dict(curve.dtypes)[step]
    return _scan(curve, run, step, value, f"`{step}` {kind}, ma double", walk).withColumn("ma", F.round("ma", 6))


def decayed_sums(values: np.ndarray, beta: float, block: int = 512) -> np.ndarray:
    """Sum of beta**(n - k) * values[k] over all k up to n, for every n; blocks keep the powers in range."""
    out, before = np.empty(len(values)), 0.0
    for at in range(0, len(values), block):
        part = values[at:at + block]
        power = beta ** np.arange(len(part))
        out[at:at + block] = power * (np.cumsum(part / power) + beta * before)
        before = out[at + len(part) - 1]
    return out


def corrected_average(curve: DataFrame, run: Sequence[str], step: str, value: str, beta: float = 0.98,
                      lr0: float = 1e-6, lr1: float = 10.0, iterations: int = 1000) -> DataFrame:
    """Bias-corrected average over the learning-rate sweep, cut when it explodes.

    The loss is shifted by one. The curve ends before the first step (after the
    first) whose corrected average exceeds four times the best one so far.
    """
    rate = np.log10(lr1 / lr0) / iterations     # decades of the learning rate per step

    def walk(steps: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        number = np.arange(1, len(values) + 1)
        smooth = (1 - beta) * decayed_sums(values + 1, beta) / (1 - beta ** number)
        exploded = np.flatnonzero(smooth[1:] > 4 * np.minimum.accumulate(smooth)[:-1])
        end = exploded[0] + 1 if len(exploded) else len(values)
        return pd.DataFrame({"step": number, "smoothed": smooth, "log_lr": np.log10(lr0) + rate * (number - 1)})[:end]
    out = _scan(curve, run, step, value, "step int, smoothed double, log_lr double", walk)
    return out.withColumns({"smoothed": F.round("smoothed", 6), "log_lr": F.round("log_lr", 6)})


def patience(curve: DataFrame, run: Sequence[str], step: str, value: str, wait: int, eps: float,
             may_stop: bool = True) -> DataFrame:
    """Best epoch of a loss average and the epoch at which training stops.

    An epoch counts as better only if value + eps is below the best. While the
    learning rate is still high (``may_stop`` false) a spent patience is renewed
    by half instead of stopping.
    """
    def push(state, item):
        first = state["best"].isNull()
        better = first | (item[value] + eps < state["best"])
        best = F.when(better, item[value]).otherwise(state["best"])
        epoch = F.when(better, item[step]).otherwise(state["epoch"])
        spent = item[step] - epoch > wait
        if not may_stop:
            epoch = F.when(spent, (item[step] - wait // 2).cast("int")).otherwise(epoch)
        stopped = state["stopped"].isNotNull()
        stop = F.coalesce(state["stopped"], F.when(spent & F.lit(may_stop), item[step]))
        return F.struct(F.when(stopped, state["best"]).otherwise(best).alias("best"),
                        F.when(stopped, state["epoch"]).otherwise(epoch).alias("epoch"), stop.alias("stopped"))
    start = F.expr("named_struct('best', cast(null as double), 'epoch', cast(null as int), 'stopped', cast(null as int))")
    return (_series(curve, run, step, value).select(*run, F.aggregate("_s", start, push).alias("s"))
            .select(*run, F.col("s.best").alias("best"), F.col("s.epoch").alias("best_epoch"),
                    F.col("s.stopped").alias("stopped_at")))


def poly_lr(epoch: Column, epochs: int, lr0: float = 0.01, exponent: float = 0.9) -> Column:
    return F.lit(lr0) * F.pow(1 - epoch / F.lit(float(epochs)), F.lit(exponent))


# A fixed odd multiplier spreads consecutive case numbers; its result is the shuffle order.
# Dropping SHUFFLE_BITS of it leaves the bucket a case is ranked in.
SHUFFLE_MULTIPLIER, SHUFFLE_MODULUS, SHUFFLE_BITS = 48271, 2147483647, 15


def shuffle_key(case: Column) -> Column:
    return ((case + 1) * SHUFFLE_MULTIPLIER) % SHUFFLE_MODULUS


def kfold(cases: DataFrame, case: str, folds: int) -> DataFrame:
    """Validation fold of each case: contiguous blocks of the shuffled order.

    The first n mod k folds hold one case more.
    """
    key = shuffle_key(F.col(case))
    bucket = F.shiftright(key, SHUFFLE_BITS)
    ranked = rank_in_buckets(cases.withColumn("_g", F.lit(0)).withColumn("_k", key), ["_g"], [("_b", bucket)],
                             ["_k", case], "_rank", "_total")
    size, extra = F.floor(F.col("_total") / folds), F.col("_total") % folds
    cut = extra * (size + 1)
    fold = F.when(F.col("_rank") < cut, F.floor(F.col("_rank") / (size + 1))).otherwise(
        extra + F.floor((F.col("_rank") - cut) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("fold", fold.cast("int")).drop("_g", "_k", "_rank", "_total")


def fold_sets(cases: DataFrame, case: str, fold: int | str, folds: int = 5,
              given: DataFrame | None = None) -> DataFrame:
    """(case, role) of one fold, role being ``train`` or ``val``.

    Fold ``all`` trains and validates on every case.  A ``given`` table (fold,
    case, role) decides the folds it holds; without one, folds below ``folds``
    come from ``kfold``.  Any other fold is a shuffle of its own, 80 : 20.
    """
    rows = cases.select(case)
    if fold == "all":
        return rows.withColumn("role", F.explode(F.array(F.lit("train"), F.lit("val"))))
    if given is not None:
        listed = given.where(F.col("fold") == fold).select(case, "role")
        if not listed.isEmpty():
            return listed
    elif fold < folds:
        role = F.when(F.col("fold") == fold, "val").otherwise("train")
        return kfold(rows, case, folds).select(case, role.alias("role"))
    key = shuffle_key(F.col(case) + F.lit(fold))
    ranked = rank_in_buckets(rows.withColumns({"_g": F.lit(0), "_k": key}), ["_g"],
                             [("_b", F.shiftright("_k", SHUFFLE_BITS))], ["_k", case], "_rank", "_total")
    train = F.col("_rank") < F.floor(F.col("_total") * 8 / 10)
    return ranked.select(case, F.when(train, "train").otherwise("val").alias("role"))


def stratified_split(cases: DataFrame, case: str, stratum: str, strata: Sequence[str], share: float,
                     first_fold: int = 5) -> DataFrame:
    """Folds that train on one stratum each, then one that trains on all of them.

    A seeded ``share`` of each stratum trains; every fold validates on the rest
    of all strata. Result: fold, role, case.
    """
    key = shuffle_key(F.col(case))
    bucket = F.shiftright(key, SHUFFLE_BITS)
    ranked = rank_in_buckets(cases.where(F.col(stratum).isin(list(strata))).withColumn("_k", key), [stratum],
                             [("_b", bucket)], ["_k", case], "_rank", "_total")
    trains = F.col("_rank") < F.rint(F.col("_total") * share)
    own = F.array_position(F.array(*[F.lit(s) for s in strata]), F.col(stratum)).cast("int") - 1 + first_fold
    everything = first_fold + len(strata)
    folds = F.when(trains, F.array(own, F.lit(everything))).otherwise(
        F.array(*[F.lit(f) for f in range(first_fold, everything + 1)]))
    return ranked.select(F.explode(folds).alias("fold"), F.when(trains, "train").otherwise("val").alias("role"), case)
