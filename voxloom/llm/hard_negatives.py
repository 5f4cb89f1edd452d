"""Hard negatives by exact integer products in a residue number system.

Vectors become integers, ``floor(scale * x)``.  A score, the inner product with
an anchor, is computed modulo several small primes: the residues are at most
125 in size, so a float32 matrix product over 1,024 columns stays below 2**24
and is exact.  Mixed-radix Chinese remaindering gives the signed score back.
How many primes a tile takes follows from the lengths of its vectors.

Anchors meet all rows tile by tile, twice: first for the positives of each
anchor, then for the negatives in the score window below each positive.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.support import materialize

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Rows stored together; rows and anchors of a cell at most (on average); rows and anchors of a product; columns of a product.
SLAB, CELL_ROWS, CELL_ANCHORS, TILE_ROWS, TILE_ANCHORS, COLUMNS = 1_024, 262_144, 32_768, 4_096, 128, 1_024
_LARGEST_PRIME = 251
_NONE = np.iinfo(np.int64).min
_SLAB_SCHEMA = ("slab long, n int, width int, kind string, uids binary, ids binary, labels binary, asked binary, "
                "values binary")


@lru_cache(maxsize=1)
def primes() -> list[int]:
    """Odd primes from the largest whose products are exact downwards; together they span far more than 64 bits."""
    sieve = [p for p in range(3, _LARGEST_PRIME + 1) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    return sieve[::-1]


def moduli(bound: float) -> list[int]:
    """The fewest primes whose product is above four times ``bound``, the largest size of a score."""
    if bound >= 2.0 ** 62:
        raise OverflowError("inner products of these vectors do not fit in a long")
    out, span = [], 1
    for p in primes():
        out.append(p)
        span *= p
        if span > 4 * bound + 4:
            return out
    raise OverflowError("no set of primes spans these inner products")


def _centred(values: np.ndarray, p: int) -> np.ndarray:
    """Residues of exact integers (float32, in place), of size (p - 1) / 2 at most, one more beside a rounding."""
    values -= np.float32(p) * np.rint(values * np.float32(1 / p))
    return values


def residues(matrix: np.ndarray, mods: list[int]) -> list[np.ndarray]:
    """The component matrix modulo each prime, centred, as float32."""
    out = []
    for p in mods:
        r = np.mod(matrix, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def products(left: list[np.ndarray], right: list[np.ndarray], mods: list[int]) -> np.ndarray:
    """Exact ``left @ right.T`` as int64 from the residues of both."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(mods):
        a, b = left[k], right[k]
        value = np.zeros((len(a), len(b)), dtype=np.float32)
        for at in range(0, a.shape[1], COLUMNS):
            value += _centred(a[:, at:at + COLUMNS] @ b[:, at:at + COLUMNS].T, p)
            _centred(value, p)
        # mixed radix: take the digits found so far away, one prime after the other
        for q, digit in zip(mods, digits):
            inverse = pow(q, -1, p)
            value = _centred((value - digit) * np.float32(inverse - p if inverse > p // 2 else inverse), p)
        digits.append(value)
    out, weight = np.zeros(digits[0].shape, dtype=np.int64), 1
    for p, digit in zip(mods, digits):
        # wrap-around is harmless: the sum itself fits
        out += digit.astype(np.int64) * np.int64((weight + (1 << 63)) % (1 << 64) - (1 << 63))
        weight *= p
    return out


def _integers(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers of vectors without null and non-finite components, and their integers."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    flat = pc.list_flatten(column)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(np.maximum(sizes, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    rows = np.flatnonzero((sizes >= 0) & (bad[ends] == bad[ends - np.maximum(sizes, 0)]))
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(values * scale)
    if len(rows) and np.abs(np.where(np.isfinite(whole), whole, 0)).max(initial=0) >= 2.0 ** 31:
        raise OverflowError("a component times the scale does not fit in 32 bits")
    return rows, [whole[e - s:e].astype(np.int32) for e, s in zip(ends[rows], sizes[rows])]


def slabs(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows of up to ``SLAB`` vectors of one length as arrays in the smallest integer type; ``uids`` number the rows,
    and ``asked`` holds the column ``__asked``.

    Rows with a null id, label or vector, or a null or non-finite component, take no part.
    """

    def run(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 30
        for batch in batches:
            rows, found = _integers(batch.column(2), scale)
            ids = np.asarray(batch.column(0).take(pa.array(rows)).cast(pa.int64()))
            labels = np.asarray(batch.column(1).take(pa.array(rows)).cast(pa.int64()))
            asked = np.asarray(batch.column(3).take(pa.array(rows)), dtype=bool)
            width = np.array([len(v) for v in found], dtype=np.int64)
            for w in np.unique(width):
                of = np.flatnonzero(width == w)
                for at in range(0, len(of), SLAB):
                    part = of[at:at + SLAB]
                    matrix = np.stack([found[k] for k in part])
                    small = next(t for t in (np.int8, np.int16, np.int32) if not matrix.size or (
                        np.iinfo(t).min <= matrix.min() and matrix.max() <= np.iinfo(t).max))
                    uids = number * SLAB + np.arange(len(part))
                    yield pa.RecordBatch.from_pydict({
                        "slab": pa.array([number]), "n": pa.array([len(part)], pa.int32()),
                        "width": pa.array([w], pa.int32()), "kind": pa.array([np.dtype(small).str]),
                        "uids": pa.array([uids.tobytes()], pa.binary()),
                        "ids": pa.array([ids[part].tobytes()], pa.binary()),
                        "labels": pa.array([labels[part].tobytes()], pa.binary()),
                        "asked": pa.array([asked[part].tobytes()], pa.binary()),
                        "values": pa.array([matrix.astype(small).tobytes()], pa.binary())})
                    number += 1

    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    return whole.select("vec_id", "label", "embedding", "__asked").mapInArrow(run, _SLAB_SCHEMA)


def _unpack(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """uids, ids, labels and matrix (padded with zeros to ``width``) of the slabs in a table, by id."""
    parts = [table.column(c).to_pylist() for c in ("uids", "ids", "labels", "kind", "width", "values")]
    uids, ids, labels = (np.frombuffer(b"".join(p), np.int64) for p in parts[:3])
    matrix = np.zeros((len(ids), width), dtype=np.int32)
    at = 0
    for raw, kind, w, values in zip(parts[0], *parts[3:]):
        n = len(raw) // 8
        matrix[at:at + n, :w] = np.frombuffer(values, np.dtype(kind)).reshape(n, w)
        at += n
    by = np.lexsort((uids, ids))  # equal scores keep this order below
    return uids[by], ids[by], labels[by], matrix[by]


def _scores(anchors: np.ndarray, rows: np.ndarray):
    """(first anchor, first row, exact scores) of every tile."""
    if not len(anchors) or not len(rows):
        return
    if not anchors.shape[1]:
        anchors, rows = np.zeros((len(anchors), 1), np.int32), np.zeros((len(rows), 1), np.int32)
    reach = [np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)) for m in (anchors, rows)]
    for y in range(0, len(rows), TILE_ROWS):
        done: dict[int, list[np.ndarray]] = {}
        for x in range(0, len(anchors), TILE_ANCHORS):
            mods = moduli(reach[0][x:x + TILE_ANCHORS].max() * reach[1][y:y + TILE_ROWS].max() * (1 + 1e-9))
            if len(mods) not in done:
                done[len(mods)] = residues(rows[y:y + TILE_ROWS], mods)
            yield x, y, products(residues(anchors[x:x + TILE_ANCHORS], mods), done[len(mods)], mods)


def _first(scores: np.ndarray, count: int) -> np.ndarray:
    """Positions of the ``count`` largest scores, equal ones by position; ``_NONE`` is no score."""
    some = np.flatnonzero(scores != _NONE)
    if len(some) > 4 * count:
        least = np.partition(scores[some], len(some) - count)[len(some) - count]
        some = some[scores[some] >= least]
    return some[np.argsort(-scores[some], kind="stable")[:count]]


def _table(schema: pa.Schema, columns: list[list]) -> pa.Table:
    return pa.table([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(columns, schema)], schema=schema)


def _positives(count: int):
    schema = pa.schema([("uid", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()),
                        ("positive_score", pa.int64())])

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        width = max([0, *rows.column("width").to_pylist(), *anchors.column("width").to_pylist()])
        a_uid, a_id, a_label, a = _unpack(anchors, width)
        r_uid, r_id, r_label, r = _unpack(rows, width)
        out: list[list] = [[], [], [], []]
        for x, y, scores in _scores(a, r):
            stop, end = x + len(scores), y + scores.shape[1]
            scores[(a_label[x:stop, None] != r_label[None, y:end]) | (a_uid[x:stop, None] == r_uid[None, y:end])] = _NONE
            for k, line in enumerate(scores, x):
                best = _first(line, count)
                for column, values in zip(out, (np.full(len(best), a_uid[k]), np.full(len(best), a_id[k]),
                                                r_id[y:end][best], line[best])):
                    column.append(values)
        return _table(schema, out)

    return run


def _bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(count: int, low: int, high: int):
    schema = pa.schema([("uid", pa.int64()), ("k", pa.int32()), ("negative_id", pa.int64()),
                        ("negative_score", pa.int64())])

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        width = max([0, *rows.column("width").to_pylist(), *anchors.column("width").to_pylist()])
        windows = {u: [_bounds(s, low, high) for s in w] for u, w in zip(
            np.frombuffer(b"".join(anchors.column("uids").to_pylist()), np.int64).tolist(),
            anchors.column("positives").to_pylist())}
        a_uid, _, a_label, a = _unpack(anchors, width)
        _, r_id, r_label, r = _unpack(rows, width)
        out: list[list] = [[], [], [], []]
        for x, y, scores in _scores(a, r):
            end = y + scores.shape[1]
            for k, line in enumerate(scores, x):
                wanted = windows[int(a_uid[k])]
                least, most = min(w[0] for w in wanted), max(w[1] for w in wanted)
                some = np.flatnonzero((line >= least) & (line <= most) & (r_label[y:end] != a_label[k]))
                if not len(some):
                    continue
                some = some[np.argsort(-line[some], kind="stable")]
                falling = -line[some]
                for j, (under, over) in enumerate(wanted):
                    first = int(np.searchsorted(falling, -over))
                    last = min(first + count, int(np.searchsorted(falling, -under, side="right")))
                    if last > first:
                        best = some[first:last]
                        for column, values in zip(out, (np.full(len(best), a_uid[k]), np.full(len(best), j),
                                                        r_id[y:end][best], line[best])):
                            column.append(values)
        return _table(schema, out)

    return run


def _asked(stored: DataFrame) -> DataFrame:
    """The anchors among the stored rows, as slabs of one row each with a column ``uid``."""
    fields = [("uid", pa.int64()), ("width", pa.int32()), ("kind", pa.string()), ("uids", pa.binary()),
              ("ids", pa.binary()), ("labels", pa.binary()), ("values", pa.binary())]

    def run(batches):
        for batch in batches:
            for line in batch.to_pylist():
                size = np.dtype(line["kind"]).itemsize * line["width"]
                cuts = [slice(8 * k, 8 * k + 8) for k in np.flatnonzero(np.frombuffer(line["asked"], bool)).tolist()]
                if cuts:
                    columns = [[int.from_bytes(line["uids"][c], "little", signed=True) for c in cuts],
                               [line["width"]] * len(cuts), [line["kind"]] * len(cuts),
                               *[[line[name][c] for c in cuts] for name in ("uids", "ids", "labels")],
                               [line["values"][c.start // 8 * size:c.stop // 8 * size] for c in cuts]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)],
                                                     names=[n for n, _ in fields])

    return stored.select("n", "width", "kind", "uids", "ids", "labels", "asked", "values").mapInArrow(
        run, "uid long, width int, kind string, uids binary, ids binary, labels binary, values binary")


def _cells(rows: DataFrame, anchors: DataFrame, deal: tuple[int, int]):
    """Rows and anchors grouped by cell: every part of the rows meets every part of the anchors once."""
    parts, lanes = deal
    cells = parts * lanes
    rows = (rows.withColumn("i", F.pmod(F.xxhash64("slab"), F.lit(parts)).cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).drop("slab", "n", "asked"))
    anchors = (anchors.withColumn("j", F.pmod(F.xxhash64("uid"), F.lit(lanes)).cast("int"))
               .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).drop("uid"))
    # an explicit number of partitions: cells are few bytes and much work, and would be put together by size
    return (rows.repartition(cells, "i", "j").groupBy("i", "j"), anchors.repartition(cells, "i", "j").groupBy("i", "j"))


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label (an integer) and embedding; ``anchors`` is a condition over these columns.  A
    component x counts as floor(scale * x), a score is the integer inner product with the anchor.  Higher scores come
    first, ties by smaller vec_id.  The positives of an anchor are its first ``positives`` other rows of its label;
    for each, the first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <=
    high * positive_score are returned, ``rank`` from 1.  A positive without such rows has none.

    Rows with a null id, label or vector, or with a null or non-finite component take no part.  Repeated rows count
    each for itself, as anchors too.  Vectors of different length meet on their common components, so an empty vector
    scores 0.  Other columns are dropped.  An empty table gives no rows.  A component outside 32 bits after scaling,
    or a product outside 64 bits, is an error.

    No label is a group: rows and anchors are dealt out by number, so a label that a third of all rows have is as
    good as any.  A cell holds about ``CELL_ROWS`` rows and ``CELL_ANCHORS`` anchors, whatever their labels.
    """
    spark = vectors.sparkSession
    stored = materialize(slabs(vectors.withColumn("__asked", F.coalesce(anchors, F.lit(False))), scale))
    asked = materialize(_asked(stored))
    count, n_asked = stored.agg(F.sum("n")).first()[0] or 0, asked.count()
    lanes = max(1, math.ceil(n_asked / CELL_ANCHORS))
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = max(math.ceil(count / CELL_ROWS), math.ceil(wide / lanes)), lanes
    rows, chosen = _cells(stored, asked, deal)
    found = rows.cogroup(chosen).applyInArrow(
        _positives(positives), "uid long, anchor_id long, positive_id long, positive_score long")
    best = W.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id")
    firsts = materialize(found.withColumn("k", F.row_number().over(best) - 1).where(F.col("k") < positives))
    lists = firsts.groupBy("uid").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("k", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    rows, chosen = _cells(stored, asked.join(lists, "uid"), deal)
    found = rows.cogroup(chosen).applyInArrow(
        _negatives(negatives, low, high), "uid long, k int, negative_id long, negative_score long")
    best = W.partitionBy("uid", "k").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= negatives)
    return ranked.join(firsts, ["uid", "k"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
