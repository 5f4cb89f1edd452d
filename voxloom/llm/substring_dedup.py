"""Removal of repeated word windows across documents (Rabin-Karp, counted in Spark).

Every window of ``width`` words is hashed.  Tasks settle repeats among their
own documents, so a passage that a third of all rows share reaches its bucket
once per chunk.  Buckets of bounded size find the earliest start of each
repeated window; all later starts go back to their documents, where they merge
into maximal removal intervals.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxloom.llm.words import (WINDOW_BASES, U64, Words, encode_text, first_of_equal, mix, pack_arrays, text_batches,
                               unpack_arrays)

#: Words of windows per chunk of a task, windows per bucket and text bytes per group of documents.
CHUNK_WORDS, BUCKET_WINDOWS, GROUP_BYTES = 1_000_000, 500_000, 6 << 20
#: Bits of the table of ids that several rows have.
SHARED_BITS = 1 << 20
_PACKED = "key int, windows binary, repeats binary"
_INT64 = np.iinfo(np.int64)


def _group_of(ids: np.ndarray, rows: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64) ^ mix(rows.astype(np.int64).view(U64))) % U64(groups)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(_INT64.min), dtype=np.int64)


def _slots(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(U64)) % U64(SHARED_BITS)).astype(np.int64)


def _shared_ids(docs: DataFrame) -> np.ndarray:
    """Packed bits by slot: set for every id that several rows have (and for the few others of its slot)."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(_ids(batch.column(0)))))], names=["slot"])

    ids = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    bits = np.zeros(SHARED_BITS, dtype=bool)
    bits[[r.slot for r in ids.mapInArrow(run, "slot long").distinct().collect()]] = True
    return np.packbits(bits)


def _rows_of(ids: np.ndarray, texts: list[str | None], shared: np.ndarray) -> np.ndarray:
    """What tells rows under one id apart: 64 bits of the text, or 0 where no other row has the id."""
    out = np.zeros(len(ids), dtype=np.int64)
    slots = _slots(ids)
    for k in np.flatnonzero(shared[slots >> 3] >> (7 - (slots & 7)) & 1):
        digest = hashlib.blake2b(encode_text(texts[k]), digest_size=8).digest()
        out[k] = int.from_bytes(digest, "little", signed=True)
    return out


def _later(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Windows that an equal one precedes: a smaller id, or the same id and a smaller start."""
    at, first = first_of_equal(hashes, docs, starts)
    return at[(docs[at] != docs[first]) | (starts[at] != starts[first])]


def _by_key(key: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(key, kind="stable")
    bounds = np.searchsorted(key[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        at = order[bounds[k]:bounds[k + 1]]
        yield int(k), [a[at] for a in arrays]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts in one array; the list is emptied, so that they do not stay beside it."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _delta(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _repeat_payload(docs: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> bytes:
    order = np.lexsort((starts, rows, docs))
    return pack_arrays(_delta(docs[order]), _delta(rows[order]), _delta(starts[order].astype(np.int32)))


def _read_repeats(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, rows, starts = unpack_arrays(blob)
    return np.cumsum(docs), np.cumsum(rows), np.cumsum(starts, dtype=np.int64)


def _window_rows(width: int, buckets: int, groups: int, shared: np.ndarray):
    schema = pa.schema([("key", pa.int32()), ("windows", pa.binary()), ("repeats", pa.binary())])

    def chunk_rows(hashes, bucket, text, starts, ids, owners):
        """Consumes the lists it is given; ``text`` is the place of a window's row in ``ids`` and ``owners``."""
        hashes, bucket, text, starts, ids, owners = map(_joined, (hashes, bucket, text, starts, ids, owners))
        keep = np.ones(len(hashes), dtype=bool)
        later = _later(hashes, ids[text], starts)
        keep[later] = False
        # equal rows under one id share their answer: one of them asks
        if owners.any():
            twins = np.flatnonzero(keep & (owners != 0)[text])
            by = twins[np.lexsort((starts[twins], owners[text[twins]], ids[text[twins]], hashes[twins]))]
            a, b = by[1:], by[:-1]
            keep[a[(hashes[a] == hashes[b]) & (ids[text[a]] == ids[text[b]]) & (owners[text[a]] == owners[text[b]])
                   & (starts[a] == starts[b])]] = False
        rows = []
        # places are dealt out, not values: no array of the chunk is copied whole
        for k, (at,) in _by_key(bucket[keep], buckets, np.flatnonzero(keep)):
            rows.append((k, pack_arrays(hashes[at], _delta(ids[text[at]]), _delta(owners[text[at]]), _delta(starts[at])),
                         None))
        if len(later):
            home = _group_of(ids, owners, groups)[text[later]]
            for k, (at,) in _by_key(home, groups, later):
                rows.append((k % buckets, None, _repeat_payload(ids[text[at]], owners[text[at]], starts[at])))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else None

    def windows_of(texts, first):
        """Hash, bucket, place of the row (from ``first`` on) and start of every window."""
        words = Words(texts)
        hashes, owner, start = words.windows(width)
        seconds = words.windows(width, WINDOW_BASES[1])[0]
        return (hashes, ((seconds >> U64(16)) % U64(buckets)).astype(np.int32), (owner + first).astype(np.int32),
                start.astype(np.int32))

    def run(batches):
        held, size, n_rows = tuple([] for _ in range(6)), 0, 0
        for batch, texts in text_batches(batches, "text", 1 << 20):
            ids = _ids(batch.column(0))
            for column, values in zip(held, (*windows_of(texts, n_rows), ids, _rows_of(ids, texts, shared))):
                column.append(values)
            size += len(held[0][-1])
            n_rows += len(ids)
            if max(size, n_rows) >= CHUNK_WORDS:
                out = chunk_rows(*held)
                size = n_rows = 0
                if out is not None:
                    yield out
                    del out
        if size:
            out = chunk_rows(*held)
            if out is not None:
                yield out

    return run


def _settle(groups: int):
    schema = pa.schema([("key", pa.int32()), ("windows", pa.binary()), ("repeats", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        held, found = [], []
        for windows, repeats in zip(table.column("windows").to_pylist(), table.column("repeats").to_pylist()):
            if windows is not None:
                h, d, o, s = unpack_arrays(windows)
                held.append((h, np.cumsum(d), np.cumsum(o), np.cumsum(s, dtype=np.int64)))
            else:
                found.append(_read_repeats(repeats))
        if held:
            h, d, o, s = map(np.concatenate, zip(*held))
            later = _later(h, d, s)
            found.append((d[later], o[later], s[later]))
        d, o, s = map(np.concatenate, zip(*found))
        rows = [(k, None, _repeat_payload(*part)) for k, part in _by_key(_group_of(d, o, groups), groups, d, o, s)]
        return pa.table([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _pack_documents(groups: int, shared: np.ndarray):
    """Rows of documents as compressed Arrow streams, one for each group in a batch."""
    out_schema = pa.schema([("key", pa.int32()), ("rows", pa.binary())])

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch, texts in text_batches(batches, "text", 8 << 20):
            ids = _ids(batch.column(batch.schema.get_field_index("doc_id")))
            home = _group_of(ids, _rows_of(ids, texts, shared), groups)
            keys, blobs = [], []
            for k, (index,) in _by_key(home, groups, np.arange(batch.num_rows)):
                sink = pa.BufferOutputStream()
                part = batch.take(pa.array(index))
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                keys.append(k)
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())],
                                             schema=out_schema)

    return run


def _cover(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals [a, b) covered by windows at the sorted ``starts``."""
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    return [(int(p[0]), int(p[-1]) + width) for p in np.split(starts, cut)]


def _rewrite(width: int, shared: np.ndarray, out_fields: list[pa.Field], names: list[str]):
    def run(rows: pa.Table, repeats: pa.Table) -> pa.Table:
        parts = []
        for blob in repeats.column("repeats").to_pylist() if repeats.num_rows else []:
            parts.append(_read_repeats(blob))
        if parts:
            docs, owners, starts = map(np.concatenate, zip(*parts))
            order = np.lexsort((starts, owners, docs))
            docs, owners, starts = docs[order], owners[order], starts[order]
        else:
            docs = owners = starts = np.zeros(0, dtype=np.int64)
        edges = np.flatnonzero((np.diff(docs) != 0) | (np.diff(owners) != 0)) + 1
        edges = [0, *edges.tolist(), len(docs)] if len(docs) else [0]
        found = {(int(docs[a]), int(owners[a])): starts[a:b] for a, b in zip(edges, edges[1:])}
        tables = []
        for blob in rows.column("rows").to_pylist():
            table = pa.ipc.open_stream(blob).read_all()
            ids = _ids(table.column("doc_id").combine_chunks())
            texts = table.column("text").to_pylist()
            new, n_words, n_removed, digest, spans = [], [], [], [], []
            for text, key in zip(texts, zip(ids.tolist(), _rows_of(ids, texts, shared).tolist())):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                cover = _cover(np.unique(found[key]), width) if key in found else []
                kept, at = [], 0
                for x, y in cover:
                    kept += words[at:x]
                    at = y
                kept += words[at:]
                joined = b" ".join(kept)
                new.append(joined.decode("utf-8", "surrogatepass") if cover else text)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                spans.append([{"first": x, "end": min(y, len(words))} for x, y in cover])
            extra = {"text": new, "n_words": n_words, "n_removed": n_removed, "kept_sha256": digest, "spans": spans}
            tables.append(pa.table([pa.array(extra[n], type=f.type) if n in extra else table.column(n).cast(f.type)
                                    for n, f in zip(names, out_fields)], names=names))
        return pa.concat_tables(tables) if tables else pa.table(
            [pa.array([], type=f.type) for f in out_fields], names=names)

    return run


def remove_repeats(docs: DataFrame, width: int = 20, bucket_windows: int = BUCKET_WINDOWS,
                   group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Drop every word covered by a window of ``width`` words that also starts earlier.

    Earlier means a smaller doc_id, or the same doc_id and a smaller start; an
    equal start under the same id is not earlier.
    Returns all columns of ``docs`` with ``text`` replaced by the kept words
    joined by one space (texts that lose nothing are unchanged), and
    ``n_words``, ``n_removed``, ``kept_sha256`` and ``spans`` (removed word
    intervals).  Input columns of these names are replaced.

    A null text has no words and stays null; texts shorter than the window lose
    nothing.  A null doc_id counts as the smallest.  Rows that share a doc_id
    (or have none) lose only words of their own; those with the same text lose
    the same words.  An empty table gives an empty result.

    Rows under a shared id are told apart by 64 bits of their text.  Equal rows
    under one id meet in one group of documents.

    Windows are equal when a stored 64-bit hash and the bucket, taken from a
    second hash, agree; the bucket count grows with the input, so the expected
    number of false matches is below windows * bucket_windows / 2**65.
    """
    made = ["n_words", "n_removed", "kept_sha256", "spans"]
    docs = docs.drop(*made)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word has one byte and a separator at least; texts of ordinary words have about six
    buckets = max(1, math.ceil(size / 6 / bucket_windows))
    groups = max(1, math.ceil(size / group_bytes))
    source = docs.select("doc_id", "text")
    shared = _shared_ids(source)
    settled = (source.mapInArrow(_window_rows(width, buckets, groups, shared), _PACKED)
               .groupBy("key").applyInArrow(_settle(groups), _PACKED).select("key", "repeats"))
    packed = docs.mapInArrow(_pack_documents(groups, shared), "key int, rows binary")
    schema = T.StructType([*docs.schema.fields,
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_sha256", T.StringType()),
                           T.StructField("spans", T.ArrayType(T.StructType([
                               T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])))])
    fields = list(to_arrow_schema(schema))
    return packed.groupBy("key").cogroup(settled.groupBy("key")).applyInArrow(
        _rewrite(width, shared, fields, [f.name for f in fields]), schema)
