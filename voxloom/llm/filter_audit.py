"""How filters interact: what each removes, alone or after others, in every order of application.

A document leaves one mask, bit k set where filter k fails it.  Documents are
counted by part, mask and label flags, so all orders are judged on at most
2**k * 4 counts a part.  The step at which a mask is removed under an order is
the minimum, over its failing filters, of the filter's place in that order: a
min-plus product of the mask matrix (0 where a filter fails, infinite
elsewhere) with the matrix of inverse permutations.  Counts are then added up
at those steps.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.support import materialize

#: Filters in the order of their bits: letter and failure condition over the measurements; the last sees the whole table.
FILTERS: list[tuple[str, str]] = [
    ("A", "n_words < 200"),
    ("B", "100 * n_distinct < 50 * n_words"),
    ("C", "100 * n_capitals > 3 * n_chars"),
    ("D", "has_symbol"),
    ("E", "is_copy"),
]
_BLANK = r"[\x20\x09-\x0D]+"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def measure(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text) and what the filters look at; a null text is empty, a null part too."""
    body = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    # used twice below, so the words stay a column of their own
    body = body.withColumn("words", F.array_remove(F.split("text", _BLANK), ""))
    return body.select(
        "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        F.char_length("text").cast("long").alias("n_chars"), F.col("text").rlike(r"[#$%&*|]").alias("has_symbol"))


def masks(docs: DataFrame, labels: DataFrame, filters: list[tuple[str, str]] = FILTERS, part: str = "lang") -> DataFrame:
    """part, mask, good, toxic, n: the documents counted by what fails them and by their labels.

    Texts are read once and leave a digest and a mask.  Of equal digests the smallest doc_id is the original, copies
    are found by a join on (digest, doc_id): no task gathers the copies of one text.  Rows that share the smallest
    id are all originals; a null id is no copy and makes none.
    """
    local = [(k, condition) for k, (_, condition) in enumerate(filters) if condition != "is_copy"]
    bits = F.lit(0)
    for k, condition in local:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)))
    seen = materialize(measure(docs, part).select("doc_id", "part", "digest", bits.alias("mask")))
    rows = seen.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    flag = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)
    flags = labels.groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    first = (seen.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("original", F.lit(True)))
    copy = F.col("doc_id").isNotNull() & F.col("original").isNull()
    for k, (_, condition) in enumerate(filters):
        if condition == "is_copy":
            rows = rows.join(first, ["digest", "doc_id"], "left").withColumn(
                "mask", F.col("mask").bitwiseOR(F.when(copy, F.lit(1 << k)).otherwise(F.lit(0)))).drop("original")
    known = rows.join(flags, "doc_id", "left")
    return known.groupBy("part", "mask", F.coalesce("quality", F.lit(False)).alias("good"),
                         F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))


def removal_steps(found: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Step (from 0) at which each mask is removed under each order, the number of filters where it never is.

    ``places[order, filter]`` is the filter's step: the inverse of the order's permutation.
    """
    count = places.shape[1]
    cost = np.where((found[:, None] >> np.arange(count)) & 1, 0, count)
    steps = np.full((len(found), len(places)), count)
    for f in range(count):
        np.minimum(steps, cost[:, f, None] + places[None, :, f], out=steps)
    return steps


def _judge(letters: str):
    count = len(letters)
    orders = np.array(list(itertools.permutations(range(count))))
    places = np.argsort(orders, axis=1)
    names = ["".join(letters[f] for f in order) for order in orders]
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
                        *[(c, pa.int64()) for c in _COUNTS]])

    def run(table: pa.Table) -> pa.Table:
        found, n = (np.asarray(table.column(c)) for c in ("mask", "n"))
        good, toxic = (np.where(table.column(c).to_numpy(), n, 0) for c in ("good", "toxic"))
        steps = removal_steps(found, places)
        each = np.broadcast_to(np.arange(len(orders)), steps.shape)
        lost = np.zeros((3, len(orders), count + 1), dtype=np.int64)
        for out, weight in zip(lost, (n, good, toxic)):
            np.add.at(out, (each, steps), weight[:, None])
        removed = lost[0, :, :count]
        fails = (((found[:, None] >> np.arange(count)) & 1) * n[:, None]).sum(axis=0)
        alone = np.array([n[found == 1 << f].sum() for f in range(count)])
        gained = np.take_along_axis(removed, places, axis=1).sum(axis=0)
        values = {"kept": n.sum() - removed.cumsum(axis=1), "removed": removed, "redundant": fails[orders] - removed,
                  "unique_fails": alone[orders], "good_lost": lost[1, :, :count], "toxic_lost": lost[2, :, :count],
                  "shapley": gained[orders]}
        size = removed.size
        return pa.table([pa.array([table.column("part")[0].as_py()] * size), pa.array(np.repeat(names, count)),
                         pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(orders))),
                         *[pa.array(values[c].reshape(-1).astype(np.int64)) for c in _COUNTS]], schema=schema)

    return run


def audit(counts: DataFrame, letters: str = "".join(f for f, _ in FILTERS)) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``counts`` is the table of ``masks``: at most 2**len(letters) * 4 rows a part, however many documents there are.
    All orders of the filters are judged, so their number should stay below about eight.  No document, no rows.
    """
    return counts.groupBy("part").applyInArrow(
        _judge(letters), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of ``FILTERS`` over whole ``docs``, by ``part``.

    Null and empty texts fail A; they are equal to each other.  Repeated rows count each for itself, a document with
    several label rows is good (toxic) if one of them says so, labels of a null id belong to none.  Other columns of
    either table are dropped.
    """
    return audit(masks(docs, labels, FILTERS, part))
