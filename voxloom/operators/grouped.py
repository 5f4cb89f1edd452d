"""Numpy work on whole groups of rows, many groups per call of a Python worker.

Rows meet by hash and are sorted by their group, so a task reads its groups one after the other in bounded pieces; a
task never holds more than a piece and the group that goes on beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxloom.support import spread

#: Rows read before whole groups are worked on, and rows of a batch handed back; so many bytes of a block count as a row.
READ, WRITE, ROW_BYTES = 1 << 16, 1 << 18, 64
KINDS = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(),
         T.BinaryType(): pa.binary(), T.StringType(): pa.string()}


def group_starts(table: pa.Table, by: Sequence[str]) -> np.ndarray:
    """First rows of the runs of equal ``by``; nulls are equal."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in by:
        column = table.column(name)
        if column.null_count or not pa.types.is_integer(column.type):
            column = pa.chunked_array([column.combine_chunks().dictionary_encode("encode").indices])
        values = column.to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _columns(table: pa.Table, names: Sequence[str]) -> dict:
    return {n: table.column(n).to_pylist() if pa.types.is_binary(table.schema.field(n).type) else table.column(n).to_numpy()
            for n in names}


def chosen(table: pa.Table, starts: np.ndarray, lists: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    """Rows repeated for each choice of one element per list, sorted by run and choice, and the first rows of equal ones."""
    columns = [table.column(c).combine_chunks() for c in lists]
    counts = np.stack([c.value_lengths().fill_null(0).to_numpy() for c in columns]).astype(np.int64)
    repeats = counts.prod(axis=0)
    index = np.repeat(np.arange(table.num_rows), repeats)
    rest = np.arange(len(index)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
    code = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))[index]
    picked = [rest] * len(lists)
    for k in reversed(range(len(lists))):
        firsts = np.cumsum(counts[k]) - counts[k]
        picked[k] = columns[k].flatten().to_numpy()[firsts[index] + rest % counts[k][index]]
        rest = rest // counts[k][index]
    for values in picked:
        low, high = values.min(initial=0), values.max(initial=0)
        code = code * (int(high) - int(low) + 1) + (values - low)
    # short codes are sorted by their digits
    order = np.argsort(code.astype(np.uint16) if code.max(initial=0) < 1 << 16 else code, kind="stable")
    code, found = code[order], table.drop_columns(list(lists)).take(pa.array(index[order]))
    for name, values in zip(lists, picked):
        found = found.append_column(name, pa.array(values[order]))
    return found, np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))


def map_groups(rows: DataFrame, by: Sequence[str], function: Callable, schema: T.StructType,
               read: Sequence[str] | None = None, runs: Sequence[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Rows of ``schema`` that ``function(first, part)`` makes of each group.

    ``first`` holds the group's ``by`` as scalars, ``part`` the columns ``read`` (all others, if none are given) as arrays.
    The answer is (index, columns): rows of the group from which the fields of ``schema`` that are not among the columns
    are copied, and the other columns, equally long.  None stands for no rows, an iterator for several answers, of which
    no more are held than a batch has.  With ``runs``, some of ``by``, rows are sorted by these only, and all that agree in
    them fit into a task.  A row with an array in one of ``by`` belongs to a group for each of its elements; rows that agree
    in the others of ``by`` meet, and are repeated in the task that works on them.  ``tasks`` is as for ``support.spread``.
    """
    lists = [c for c in by if isinstance(rows.schema[c].dataType, T.ArrayType)]
    by = list(by)
    meet = [c for c in by if c not in lists]
    runs = list(runs or meet)
    read = [c for c in rows.columns if c not in by] if read is None else list(read)
    kinds = {f.name: KINDS.get(f.dataType) for f in schema.fields}
    names = schema.names

    def batch_of(table: pa.Table, found: list) -> Iterator[pa.RecordBatch]:
        index = pa.array(np.concatenate([i for i, _ in found]))
        arrays = []
        for name in names:
            if name in found[0][1]:
                parts = [columns[name] for _, columns in found]
                values = [v for p in parts for v in p] if isinstance(parts[0], list) else np.concatenate(parts)
                arrays.append(pa.array(values, kinds[name]))
            else:
                arrays.append(table.column(name).take(index))
        yield from pa.table(arrays, names=names).combine_chunks().to_batches()

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if lists:
            table, starts = chosen(table, starts, lists)
            if not table.num_rows:
                return
        elif runs != by and len(group_starts(table, by)) > len(starts):
            table = table.sort_by([(c, "ascending") for c in by])
            starts = group_starts(table, by)
        firsts = table.select(by).take(pa.array(starts)).to_pydict()
        columns = _columns(table, read)
        found, size = [], 0
        for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows])):
            answers = function({c: v[k] for c, v in firsts.items()}, {c: v[a:b] for c, v in columns.items()})
            for answer in answers if isinstance(answers, Iterator) else (answers,):
                if answer is None or not len(answer[0]):
                    continue
                found.append((answer[0] + a, answer[1]))
                size += len(answer[0]) + sum(len(b or b"") for v in answer[1].values() if isinstance(v, list) for b in v) // ROW_BYTES
                if size >= WRITE:
                    yield from batch_of(table, found)
                    found, size = [], 0
        if found:
            yield from batch_of(table, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, READ
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < enough:
                continue
            table = pa.Table.from_batches(held)
            starts = group_starts(table, runs)
            if len(starts) > 1:
                yield from work(table.slice(0, int(starts[-1])), starts[:-1])
            rest = table.slice(int(starts[-1]))
            held, size = rest.to_batches(), rest.num_rows
            # a group that fills the piece is read on in doubling steps
            enough = max(READ, 2 * size)
        if size:
            table = pa.Table.from_batches(held)
            yield from work(table, group_starts(table, runs))

    # all of ``by``: a shuffle on the keys alone would be taken out after an aggregation on them, whose few tasks stay
    return spread(rows, *meet, tasks=tasks).sortWithinPartitions(*runs).mapInArrow(run, schema)
