"""Byte-level BPE: distinct pre-tokens are shuffled once, encoded once and joined back.

Documents are cut into chunks.  A chunk holds its distinct pre-tokens and, for
every document, the positions as numbers into them.  The distinct pre-tokens
of all chunks meet in hash buckets, are encoded once each, and their ids go back
to the chunks, where the documents are put together by position.
"""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voxloom.llm.words import pack_arrays, text_batches, unpack_arrays

#: Pre-tokens of a chunk, and text bytes for each bucket of distinct pre-tokens.
CHUNK_TOKENS, BUCKET_BYTES = 1_000_000, 12 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=1)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def _token_bytes(path: str) -> list[bytes | None]:
    ranks = read_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _pack_positions(ranks: np.ndarray) -> bytes:
    """Numbers that are mostly small: one byte each; larger ones escape, their bytes stored apart."""
    big = ranks[ranks >= 255] - 255
    return pack_arrays(np.minimum(ranks, 255).astype(np.uint8), (big & 0xFF).astype(np.uint8),
                       (big >> 8 & 0xFF).astype(np.uint8), (big >> 16).astype(np.uint16), level=6)


def _unpack_positions(blob: bytes) -> np.ndarray:
    small, low, middle, high = unpack_arrays(blob)
    out = small.astype(np.int32)
    out[out == 255] += low.astype(np.int32) | middle.astype(np.int32) << 8 | high.astype(np.int32) << 16
    return out


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), dtype=np.uint32, count=len(words))
    return pack_arrays(sizes, np.frombuffer(b"".join(words), dtype=np.uint8), level=6)


def _unpack_words(blob: bytes) -> list[bytes]:
    sizes, data = unpack_arrays(blob)
    data, ends = data.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


_PIECES = ("key long, chunk long, words binary, doc_ids binary, positions binary, counts binary, homes binary, "
           "digest long")
_FIELDS = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("doc_ids", pa.binary()),
                     ("positions", pa.binary()), ("counts", pa.binary()), ("homes", pa.binary()),
                     ("digest", pa.int64())])


def _chunks(pattern: str, buckets: int):
    """Rows keyed by bucket (distinct pre-tokens) and one row keyed by chunk (documents as positions)."""
    def rows_of(number, ids, vocabulary, positions, counts):
        local = np.frombuffer(positions, dtype=np.uint32)
        words = [w.encode("utf-8", "surrogatepass") for w in vocabulary]
        by_frequency = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype=np.int32)
        rank[by_frequency] = np.arange(len(words), dtype=np.int32)
        words = [words[i] for i in by_frequency]
        homes = np.fromiter((zlib.crc32(w) % buckets for w in words), dtype=np.uint32, count=len(words))
        order = np.argsort(homes, kind="stable")
        bounds = np.searchsorted(homes[order], np.arange(buckets + 1))
        digest = zlib.crc32(b"\n".join(words))
        empty = [None] * 4
        rows = [[int(k), number, _pack_words([words[i] for i in order[bounds[k]:bounds[k + 1]]]), *empty, digest]
                for k in np.flatnonzero(np.diff(bounds))]
        sink = pa.BufferOutputStream()
        column = pa.record_batch([pa.concat_arrays(ids)], names=["doc_id"])
        with pa.ipc.new_stream(sink, column.schema) as writer:
            writer.write_batch(column)
        rows.append([number, number, None, sink.getvalue().to_pybytes(), _pack_positions(rank[local]),
                     pack_arrays(np.asarray(counts, dtype=np.uint32)), pack_arrays(homes), digest])
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _FIELDS)],
                                          schema=_FIELDS)

    def run(batches):
        find = regex.compile(pattern).findall
        context = TaskContext.get()
        number = ((context.partitionId() if context else 0) + 1) << 32    # beyond every bucket
        ids, vocabulary, positions, counts = [], {}, array("I"), []
        for batch, texts in text_batches(batches, "text", 1 << 20):
            ids.append(batch.column(0))
            for text in texts:
                found = find(text) if text else []
                positions.extend([vocabulary.setdefault(w, len(vocabulary)) for w in found])
                counts.append(len(found))
            if len(positions) >= CHUNK_TOKENS:
                yield rows_of(number, ids, vocabulary, positions, counts)
                number += 1
                ids, vocabulary, positions, counts = [], {}, array("I"), []
        if counts:
            yield rows_of(number, ids, vocabulary, positions, counts)

    return run


def _encode_bucket(path: str, pattern: str):
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary()), ("digest", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        encode = _encoding(path, pattern).encode_ordinary
        ids: dict[bytes, list[int]] = {}
        rows = []
        for chunk, key, blob, digest in zip(*(table.column(c).to_pylist() for c in
                                              ("chunk", "key", "words", "digest"))):
            if blob is None:        # a chunk's documents; they are put together later
                continue
            words = _unpack_words(blob)
            for word in words:
                if word not in ids:
                    ids[word] = encode(word.decode("utf-8", "surrogatepass"))
            sizes = np.fromiter((len(ids[w]) for w in words), dtype=np.uint32, count=len(words))
            flat = np.fromiter((i for w in words for i in ids[w]), dtype=np.uint32, count=int(sizes.sum(dtype=int)))
            low = (flat & 0xFFFF).astype(np.uint16)
            rows.append((chunk, key, pack_arrays(sizes, low, (flat >> 16).astype(np.uint16)), digest))
        return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)
    return run


def _reassemble(id_type: pa.DataType):
    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        outs = []
        names = ("doc_ids", "positions", "counts", "homes", "digest")
        for doc_ids, positions, counts, homes, digest in zip(*(chunk.column(c).to_pylist() for c in names)):
            if doc_ids is None:
                continue
            if any(d != digest for d in replies.column("digest").to_pylist()):
                raise RuntimeError("a chunk was rebuilt from other rows: write the input to a table first")
            ids = pa.ipc.open_stream(doc_ids).read_all().column(0).combine_chunks()
            at, (counts,), (homes,) = _unpack_positions(positions), unpack_arrays(counts), unpack_arrays(homes)
            order = np.argsort(homes, kind="stable")
            by_key = sorted(zip(replies.column("bucket").to_pylist(), replies.column("blob").to_pylist()))
            parts = [unpack_arrays(blob) for _, blob in by_key]
            if sum(len(p[0]) for p in parts) != len(homes):
                raise RuntimeError("a chunk was rebuilt from other rows: write the input to a table first")
            sizes = np.zeros(len(homes), dtype=np.int32)
            starts = np.zeros(len(homes), dtype=np.int32)
            flat = np.zeros(0, dtype=np.int32)
            if parts:
                in_order = np.concatenate([p[0] for p in parts]).astype(np.int32)
                flat = np.concatenate([p[1].astype(np.int32) | p[2].astype(np.int32) << 16 for p in parts])
                sizes[order] = in_order
                starts[order] = np.cumsum(in_order, dtype=np.int32) - in_order
            n = sizes[at]
            ends = np.cumsum(n, dtype=np.int64)
            edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            offsets = np.concatenate([[0], ends])[edges]
            # documents in slices, so that scratch memory stays small
            cuts = np.unique(np.concatenate([[0, len(counts)], np.searchsorted(
                offsets, np.arange(0, int(offsets[-1]), 1 << 20))]))
            for a, b in zip(cuts, cuts[1:]):
                x, y = edges[a], edges[b]
                base = int(offsets[a])
                total = int(offsets[b]) - base
                values = flat[np.repeat(starts[at[x:y]] - (ends[x:y] - n[x:y] - base), n[x:y]) + np.arange(total)]
                outs.append(pa.table(
                    [ids[a:b].cast(id_type),
                     pa.ListArray.from_arrays((offsets[a:b + 1] - base).astype(np.int32), pa.array(values))],
                    names=["doc_id", "ids"]))
        return pa.concat_tables(outs) if outs else pa.table(
            [pa.array([], id_type), pa.array([], pa.list_(pa.int32()))], names=["doc_id", "ids"])
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text, as the rank file's library gives them without special tokens.

    ``ranks_path`` must exist on every worker.  Null and empty texts have no
    ids; null doc_ids and repeated rows pass through.

    Chunks go through one exchange that both the distinct pre-tokens and the
    documents are read from.  A chunk is rebuilt alike from a table scan; each
    carries a digest, so a lost task over input without a fixed order fails
    instead of mixing chunks.
    """
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    kind = docs.schema["doc_id"].dataType
    pieces = docs.mapInArrow(_chunks(pattern, buckets), _PIECES)
    replies = pieces.groupBy("key").applyInArrow(_encode_bucket(ranks_path, pattern),
                                                 "chunk long, bucket long, blob binary, digest long")
    return (pieces.groupBy("key").cogroup(replies.groupBy("chunk"))
            .applyInArrow(_reassemble(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, ids array<int>"))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Add ``bytes``: the ids looked up in the token-byte table (one entry per rank) and concatenated.

    Null ids stay null; an id outside the table raises.
    """
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "bytes"]
    encoded = encoded.drop("bytes")

    def run(batches):
        table = _token_bytes(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):    # few rows at a time: their bytes are held twice
                part = batch.slice(at, 500)
                rows = [None if row is None else b"".join([table[i] for i in row.tolist()])
                        for row in _values(part.column(part.schema.get_field_index(ids)))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.binary())],
                                                 names=[*part.schema.names, "bytes"])

    return encoded.mapInArrow(run, ", ".join([*fields, "bytes binary"]))


def _values(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    for scalar in column:
        yield scalar.values.to_numpy(zero_copy_only=False) if scalar.is_valid else None
