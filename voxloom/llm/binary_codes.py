"""Nearest neighbours by randomly rotated one-bit codes.

A vector is centred, rotated at random and stored as the signs of its
components with two correction scalars: its length and its inner product with
its own code.  These give an unbiased estimate of every distance and a bound of
its error.  Vectors whose lower bound reaches the k-th smallest upper bound are
candidates; they are ranked on the original components in the order of their
lower bounds, until these exceed the k-th distance found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.support import materialize

#: Bounded sample for the centre and length; rows of a block; queries of a block; width of the error bound.
SAMPLE_ROWS, BLOCK_ROWS, BLOCK_QUERIES, BOUND, SEED = 10_000, 16_384, 1_024, 3.0, 7
_LANES = 32
#: Vectors ranked on their components before the bounds are looked at again.
_STEP = 32
_BLOCK = ("block long, ids binary, vectors binary, codes binary, lengths binary, agreement binary")


def _usable(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of vectors of the right length, finite, without nulls and not zero."""
    if not len(column):
        return np.zeros(0, dtype=np.int64), np.zeros((0, dimension))
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    rows = np.flatnonzero(sizes == dimension)
    flat = pc.list_flatten(column.take(pa.array(rows)))
    values = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dimension)
    values = values if values.dtype.kind == "f" else values.astype(np.float64)
    good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return rows[good], values[good]


def fit(vectors: DataFrame, seed: int = SEED, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Dimension (the most common of the sample), centre and rotation, from at most ``sample_rows`` vectors."""
    picked = (vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
              .orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").collect())
    sizes = [len(r.embedding) for r in picked]
    if not sizes:
        return {"dimension": 0}
    dimension = max(sorted(set(sizes)), key=sizes.count)
    _, matrix = _usable(pa.array([r.embedding for r in picked], pa.list_(pa.float64())), dimension)
    centre = matrix.mean(axis=0) if len(matrix) else np.zeros(dimension)
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return {"dimension": dimension, "centre": centre, "rotation": rotation}


def _encode(matrix: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, length of the centred vector and its agreement with the code."""
    centred = matrix.astype(np.float64) - model["centre"]
    length = np.linalg.norm(centred, axis=1)
    turned = centred @ model["rotation"]
    agreement = np.ones(len(matrix))
    some = length > 0
    agreement[some] = np.abs(turned[some]).sum(axis=1) / (length[some] * math.sqrt(model["dimension"]))
    return np.packbits(turned > 0, axis=1), length, agreement


def _once(ids: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without rows that repeat an earlier id and vector."""
    if len(np.unique(ids)) == len(ids):
        return ids, matrix
    seen = set()
    keep = [k for k, row in enumerate(zip(ids.tolist(), map(bytes, matrix))) if not (row in seen or seen.add(row))]
    return ids[keep], matrix[keep]


def index(vectors: DataFrame, model: dict) -> DataFrame:
    """Blocks of at most ``BLOCK_ROWS`` rows: ids, original vectors, packed codes and correction scalars.

    Every usable row is indexed; an id and vector once in a block.  Vectors that are null, zero, of another
    length, or hold null or non-finite components take no part; nor do null ids.
    """
    dimension = model["dimension"]

    def run(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                rows, matrix = _usable(part.column(1), dimension)
                if not len(rows):
                    continue
                ids = np.asarray(part.column(0).take(pa.array(rows)).cast(pa.int64()))
                matrix = matrix.astype(np.float64) if part.column(1).type.value_type == pa.float64() else (
                    matrix.astype(np.float32))
                ids, matrix = _once(ids, matrix)
                codes, length, agreement = _encode(matrix, model)
                kind = b"d" if matrix.dtype == np.float64 else b"f"
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([number]), "ids": pa.array([ids.tobytes()], pa.binary()),
                    "vectors": pa.array([kind + matrix.tobytes()], pa.binary()),
                    "codes": pa.array([codes.tobytes()], pa.binary()),
                    "lengths": pa.array([length.tobytes()], pa.binary()),
                    "agreement": pa.array([agreement.tobytes()], pa.binary())})
                number += 1

    return vectors.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding").mapInArrow(run, _BLOCK)


def _query_blocks(queries: DataFrame, model: dict, blocks: int) -> DataFrame:
    dimension = model["dimension"]

    def run(batches):
        ids, parts = [], []
        for batch in batches:
            rows, matrix = _usable(batch.column(1), dimension)
            ids.append(np.asarray(batch.column(0).take(pa.array(rows)).cast(pa.int64())))
            parts.append(matrix.astype(np.float64))
        if sum(map(len, ids)):
            lane = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({
                "lane": pa.array([lane], pa.int32()),
                "query_ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                "queries": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

    return (queries.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding")
            .repartition(blocks, "vec_id").mapInArrow(run, "lane int, query_ids binary, queries binary"))


def _nearest(model: dict, k: int, bound: float):
    dimension = model["dimension"]
    names = ["query_id", "vec_id", "score", "n_ranked"]

    def one_block(ids, vectors, codes, lengths, agreement, query_ids, queries):
        signs = np.unpackbits(codes.reshape(len(ids), -1), axis=1, count=dimension).astype(np.float32) * 2 - 1
        signs /= math.sqrt(dimension)
        centred = queries - model["centre"]
        reach = np.linalg.norm(centred, axis=1)
        turned = centred @ model["rotation"]
        turned = np.divide(turned, reach[:, None], out=np.zeros_like(turned), where=reach[:, None] > 0)
        error = bound * np.sqrt(np.maximum(1 / agreement ** 2 - 1, 0) / max(dimension - 1, 1))
        # rows of one id side by side: an id counts once, at its smallest bound and distance
        by = np.argsort(ids, kind="stable")
        heads = np.flatnonzero(np.diff(ids[by], prepend=ids[by[0]] - 1))
        for at in range(0, len(query_ids), 64):
            part = slice(at, at + 64)
            cosine = (turned[part].astype(np.float32) @ signs.T) / agreement.astype(np.float32)
            scale = 2 * reach[part, None] * lengths[None]
            square = reach[part, None] ** 2 + lengths[None] ** 2 - scale * cosine
            slack = scale * error[None]
            own = query_ids[part, None] == ids[None]
            upper = np.where(own, np.inf, square + slack)
            if len(heads) < len(ids):
                upper = np.minimum.reduceat(upper[:, by], heads, axis=1)
            need = min(k, len(heads)) - 1
            limit = np.partition(upper, need, axis=1)[:, need]
            chosen = (square - slack <= limit[:, None] * (1 + 1e-5) + 1e-5) & ~own
            for q, mask in enumerate(chosen, at):
                rows = np.flatnonzero(mask)
                lower = (square - slack)[q - at, rows]
                order = np.argsort(lower, kind="stable")
                rows, lower = rows[order], lower[order]
                near, distance, ranked = rows[:0], np.zeros(0), 0
                while ranked < len(rows):
                    if len(near) == k and lower[ranked] > distance[-1] ** 2 * (1 + 1e-5) + 1e-5:
                        break
                    part = rows[ranked:ranked + _STEP]
                    ranked += len(part)
                    gap = vectors[part].astype(np.float64) - queries[q]
                    near = np.concatenate([near, part])
                    distance = np.concatenate([distance, np.sqrt((gap * gap).sum(axis=1))])
                    best = np.lexsort((ids[near], distance))
                    best = best[np.sort(np.unique(ids[near[best]], return_index=True)[1])[:k]]
                    near, distance = near[best], distance[best]
                for r, d in zip(near, distance):
                    yield int(query_ids[q]), int(ids[r]), float(d), ranked

    def run(batches):
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in
                       ("ids", "vectors", "codes", "lengths", "agreement", "query_ids", "queries")]
            for ids, vectors, codes, lengths, agreement, query_ids, queries in zip(*columns):
                found = list(one_block(
                    np.frombuffer(ids, np.int64),
                    np.frombuffer(vectors, np.float64 if vectors[:1] == b"d" else np.float32, offset=1).reshape(
                        -1, dimension),
                    np.frombuffer(codes, np.uint8), np.frombuffer(lengths), np.frombuffer(agreement),
                    np.frombuffer(query_ids, np.int64), np.frombuffer(queries).reshape(-1, dimension)))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64(),
                                                                     pa.int64()))], names=names)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, bound: float = BOUND, seed: int = SEED) -> DataFrame:
    """The ``k`` nearest rows of each query: query_id, rank (from 1), vec_id, score (Euclidean), n_ranked.

    ``n_ranked`` counts the vectors of the row's block that were ranked on
    their original components.  The query's own id is no candidate; ties go to
    the smaller id; repeated ids count once, at their smallest distance.
    Queries without a usable vector have no rows, nor has an empty table; other
    columns are dropped.  Components are read as float32, or as float64 if they
    are stored so.

    Every query block meets every row block once: the query blocks are joined by
    their number, so Spark broadcasts them only while their measured size is
    below its threshold and otherwise deals both sides out over ``_LANES``
    partitions of rows per query block.
    """
    model = fit(vectors, seed)
    spark = vectors.sparkSession
    if not model["dimension"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_ranked long")
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    asked = materialize(_query_blocks(queries, model, blocks).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(_LANES - 1)))))
    rows = index(vectors, model).withColumns({
        "part": F.pmod(F.xxhash64("block"), F.lit(_LANES)).cast("int"),
        "lane": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    found = rows.join(asked, ["lane", "part"]).mapInArrow(
        _nearest(model, k, bound), "query_id long, vec_id long, score double, n_ranked long")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.max("n_ranked").alias("n_ranked"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score", "n_ranked"))
