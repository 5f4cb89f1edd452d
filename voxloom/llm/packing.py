"""Packing along a space-filling curve.

A document's token ids are hashed into a signed vector, projected to a few
dimensions and placed on a Hilbert curve.  Documents sorted by their key form
one stream that is cut every ``length`` tokens, so neighbours on the curve
share sequences and only the last sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.llm.word_bpe import word_bpe
from voxloom.llm.words import U64, mix, text_batches
from voxloom.support import materialize

HASHED, DIMENSIONS, BITS, SEED = 128, 4, 12, 20_250_101


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid cells (n x d, ``bits`` each).

    The coordinates are turned level by level from the highest bit: each level
    reflects or exchanges axes so that its half cells follow the curve, then
    the Gray code of the axes gives the digits of the key.
    """
    axes = [c.astype(np.int64) for c in cells.T]
    d = len(axes)
    for level in range(bits - 1, 0, -1):
        half, low = 1 << level, (1 << level) - 1
        for k in range(d):
            upper = (axes[k] & half) != 0
            change = (axes[0] ^ axes[k]) & low
            axes[0] ^= np.where(upper, low, change)
            if k:
                axes[k] ^= np.where(upper, 0, change)
    for k in range(1, d):
        axes[k] ^= axes[k - 1]
    flip = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flip) >> level) & 1)
    return key


def curve_points(vectors: np.ndarray, dimensions: int, bits: int, seed: int) -> np.ndarray:
    """Grid cells of hashed vectors: unit length, a fixed random projection, then clipped and scaled."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    plane = np.random.default_rng(seed).standard_normal((vectors.shape[1], dimensions))
    place = np.clip(unit @ plane / 6 + 0.5, 0, 1)
    return np.minimum((place * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, dimensions: int = DIMENSIONS, bits: int = BITS,
             seed: int = SEED) -> DataFrame:
    """One row per document: uid, doc_id, curve key, n token ids and the ids (compressed 16-bit)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = word_bpe(tokenizer)
        spread = mix(np.arange(coder.size, dtype=U64) + U64(seed))
        slot = (spread % U64(HASHED)).astype(np.int64)
        sign = np.where(spread >> U64(63), 1.0, -1.0)
        pack = zstandard.ZstdCompressor(level=3).compress
        end = end_id.to_bytes(2, "little")
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 40
        for batch, texts in text_batches(batches, "text", 1 << 20):
            packed, sizes, vectors = [], [], np.zeros((len(texts), HASHED))
            for k, raw in enumerate(coder.ids_of(texts)):
                raw += end
                ids = np.frombuffer(raw, dtype="<u2")
                vectors[k] = np.bincount(slot[ids], weights=sign[ids], minlength=HASHED)
                packed.append(pack(raw))
                sizes.append(len(ids))
            keys = hilbert_keys(curve_points(vectors, dimensions, bits, seed), bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + len(texts))), batch.column(0), pa.array(keys),
                 pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                names=["uid", "doc_id", "curve", "n", "ids"])
            uid += len(texts)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"uid long, doc_id {kind}, curve long, n long, ids binary")


def stream_starts(tokens: DataFrame) -> DataFrame:
    """uid and its first position in the stream ordered by (curve, doc_id, uid).

    Rows are range-sorted without their ids; only one total per partition is
    summed globally.
    """
    spark = tokens.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    light = tokens.select("uid", "doc_id", "curve", "n")
    order = ["curve", "doc_id", "uid"]
    ranged = materialize(light.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per partition
    base = totals.select("part", F.coalesce(F.sum("total").over(
        W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = ranged.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return inside.join(materialize(base), "part").select("uid", (F.col("base") + F.col("inside")).alias("at"))


def _pieces(length: int, with_ids: bool):
    def rows(uid, doc_id, n, packed, at) -> Iterator[tuple]:
        raw = zstandard.decompress(packed, max_output_size=2 * n)
        ids = np.frombuffer(raw, dtype="<u2").astype("<u4")
        start = 0
        while start < n:
            sequence, offset = divmod(at + start, length)
            size = min(n - start, length - offset)
            piece = ids[start:start + size]
            yield (doc_id, start, size, zlib.crc32(piece.tobytes()), n, sequence, offset,
                   *([piece.astype(np.int32)] if with_ids else []))
            start += size

    def run(batches):
        for batch in batches:
            made = [piece for row in zip(*(batch.column(k).to_pylist() for k in range(5))) for piece in rows(*row)]
            if not made:
                continue
            columns = list(zip(*made))
            kinds = [batch.schema.field(1).type, *[pa.int64()] * 6, *([pa.list_(pa.int32())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=NAMES[
                :len(kinds)])

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, dimensions: int = DIMENSIONS,
         bits: int = BITS, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens, neighbours on the curve side by side.

    Returns doc_id, start (first id of the piece in its document), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id,
    offset, and with ``with_ids`` the ids themselves.

    Null and empty texts are documents of the end id alone; a null doc_id sorts
    first; equal keys follow by doc_id, and rows that share a doc_id are packed
    one after another.  An empty table has no pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = materialize(tokenize(docs, tokenizer, end_id, dimensions, bits, seed))
    starts = stream_starts(tokens)
    joined = tokens.join(starts, "uid").select("uid", "doc_id", "n", "ids", "at")
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long" + (", ids array<int>" if with_ids else ""))
    return joined.mapInArrow(_pieces(length, with_ids), schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence with its concatenated ids; needs pieces made ``with_ids``.  A sequence is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
