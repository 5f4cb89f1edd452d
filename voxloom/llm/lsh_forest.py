"""Near duplicates over a MinHash forest: sorted signature orders, neighbours by common prefix, exact verification.

Every distinct shingle set has one signature of minima.  Tree t sorts all
signatures after rotating them by t prefixes, so each tree begins with other
minima.  In a sorted order, the sets that share the longest prefix with a set
stand beside it.  The depth is not fixed: a set, and later each component, first
takes its neighbour at the deepest level any tree offers and goes up only while
it finds links, down to ``LEAST_DEPTH`` minima.  Dense regions so close at deep
levels within a few rounds, with one pair per component and round.

What is left are sets of different components under one prefix of
``LEAST_DEPTH``.  Their signatures are compared in blocks; those that may be
linked are verified in cells of bounded size.  All links are confirmed on full
shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.ngram_join import ngram_sets
from voxloom.llm.words import U64, encode_text, mix, text_batches
from voxloom.operators.components import star_roots, union_labels
from voxloom.support import materialize

SHINGLE, PERCENT, TREES, LEAST_DEPTH, DEPTH = 4, 80, 32, 5, 8
#: Sets on each side of a cell; members of a node that one task compares at once; pairs of a bucket.
CELL, NODE, BUCKET = 256, 1024, 256
_SEED = 0x452821E638D01377


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text, its letters A-Z in lower case."""
    return ngram_sets([encode_text(t).lower().decode("utf-8", "surrogatepass") for t in texts], n)


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` 16-bit minwise values of each set, as rows."""
    rng = np.random.default_rng(_SEED)
    factors = rng.integers(1, 1 << 32, count, dtype=np.uint64) | U64(1)
    shifts = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.zeros((len(sets), count), dtype=np.uint16)
    with np.errstate(over="ignore"):
        for k, values in enumerate(sets):
            low = np.full(count, ~U64(0))
            for at in range(0, len(values), 256):
                part = values[at:at + 256, None] * factors
                part += shifts
                np.minimum(low, part.min(axis=0), out=low)
            out[k] = (low >> U64(24)).astype(np.uint16)
    return out


def sketch(docs: DataFrame, n: int, count: int) -> DataFrame:
    """uid, doc_id, digest (of the text), set_a and set_b (128-bit identity of the set), n_shingles, signature."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["uid", "doc_id", "digest", "set_a", "set_b", "n_shingles", "signature"]

    def run(batches):
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 40
        for batch, texts in text_batches(batches, "text", 1 << 20):
            sets = shingle_sets(texts, n)
            with np.errstate(over="ignore"):
                a = np.array([s.sum(dtype=U64) for s in sets], dtype=U64)
                b = np.array([mix(s + U64(_SEED)).sum(dtype=U64) for s in sets], dtype=U64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(uid, uid + len(sets))), batch.column(0), batch.column(2), pa.array(a.view(np.int64)),
                pa.array(b.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([row.tobytes() for row in minima(sets, count)], pa.binary())], names=names)
            uid += len(sets)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(
        run, f"uid long, doc_id {kind}, digest long, set_a long, set_b long, n_shingles long, signature binary")


def _entries(trees: int, least: int, depth: int):
    """(key, uid) per tree: the tree's number and the first ``depth`` minima of the rotated signature."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                raw = b"".join(batch.column(1).to_pylist())
                low = np.frombuffer(raw, np.uint16).reshape(batch.num_rows, -1)
                keys = np.empty((batch.num_rows, trees, 1 + 2 * depth), dtype=np.uint8)
                for t in range(trees):
                    keys[:, t, 0] = t
                    turned = np.take(low, np.arange(t * least, t * least + depth), axis=1, mode="wrap")
                    keys[:, t, 1:] = turned.astype(">u2").view(np.uint8).reshape(batch.num_rows, -1)
                offsets = np.arange(batch.num_rows * trees + 1, dtype=np.int32) * keys.shape[2]
                key = pa.Array.from_buffers(pa.binary(), batch.num_rows * trees,
                                            [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(keys.tobytes())])
                yield pa.RecordBatch.from_arrays([key, pa.array(np.repeat(np.asarray(batch.column(0)), trees))],
                                                 names=["key", "uid"])

    return run


def _neighbours(least: int, depth: int):
    """Members of runs that share ``least`` minima or more: (node, uid, previous, shared) from a sorted order."""
    width = 1 + 2 * depth

    def rows(keys, uids, shared, chosen):
        """``shared[i]``: minima that entry i shares with the one before."""
        with np.errstate(over="ignore"):
            node = keys[chosen, 0].astype(U64)
            for d in range(least):
                node = mix(node * U64(31) + keys[chosen, 1 + 2 * d].astype(U64) * U64(256) + keys[chosen, 2 + 2 * d])
        near = shared[chosen] >= least
        previous = np.where(chosen > 0, uids[chosen - 1], 0)
        return pa.RecordBatch.from_arrays([
            pa.array(node.view(np.int64)), pa.array(uids[chosen]), pa.array(previous, mask=~near),
            pa.array(shared[chosen].astype(np.int32))], names=["node", "uid", "previous", "shared"])

    def run(batches):
        keys, uids, begun = np.zeros((0, width), np.uint8), np.zeros(0, np.int64), False
        last = np.zeros(1, np.int64)  # what the carried entry shares with the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
            carried = len(uids)
            ids = np.concatenate([uids, np.asarray(batch.column(1))])
            keys = np.concatenate([keys, raw])
            same = keys[1:] == keys[:-1]
            pairs = same[:, 1::2] & same[:, 2::2] & same[:, :1]
            shared = np.concatenate([last if carried else [0], np.logical_and.accumulate(pairs, axis=1).sum(axis=1)])
            inside = shared >= least
            # the last entry waits for the next batch; the first of the partition may go on in another one
            wanted = inside[:-1] | inside[1:]
            if not begun and len(wanted):
                wanted[0] = True
                begun = True
            chosen = np.flatnonzero(wanted)
            if carried and len(chosen) and chosen[0] == 0 and inside[0]:
                # the carried entry was preceded by one that is gone from the arrays
                yield pa.RecordBatch.from_arrays([
                    rows(keys, ids, np.zeros(len(ids), np.int64), chosen[:1]).column(0), pa.array(ids[:1]),
                    pa.array([before]), pa.array(shared[:1].astype(np.int32))],
                    names=["node", "uid", "previous", "shared"])
                chosen = chosen[1:]
            if len(chosen):
                yield rows(keys, ids, shared, chosen)
            before = int(ids[-2]) if len(ids) > 1 else 0
            keys, uids, last = keys[-1:], ids[-1:], shared[-1:]
        if len(uids):
            near = int(last[0]) >= least
            yield pa.RecordBatch.from_arrays([
                rows(keys, uids, np.zeros(1, np.int64), np.array([0])).column(0), pa.array(uids),
                pa.array([before if near else None], pa.int64()), pa.array(last.astype(np.int32))],
                names=["node", "uid", "previous", "shared"])

    return run


def forest(classes: DataFrame, trees: int, least: int, depth: int) -> DataFrame:
    """(node, uid, previous, shared) of all sets that stand beside another one under a prefix of ``least`` minima.

    All trees are sorted in one exchange by range of (tree, signature, uid), so a prefix that very many sets share is
    spread over partitions.  Where a partition begins, the neighbour before it is unknown (``previous`` is null); the
    node still holds both.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = classes.select("uid", "signature").mapInArrow(_entries(trees, least, depth), "key binary, uid long")
    return (entries.repartitionByRange(parts, "key", "uid").sortWithinPartitions("key", "uid")
            .mapInArrow(_neighbours(least, depth), "node long, uid long, previous long, shared int"))


def _linked(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets of each pair are similar enough, exactly."""
    out = np.zeros(len(a), dtype=bool)
    for k, (x, y) in enumerate(zip(a, b)):
        n, m = len(sets[x]), len(sets[y])
        if 100 * min(n, m) >= percent * max(n, m):
            both = n + m - len(np.union1d(sets[x], sets[y]))
            out[k] = 100 * both >= percent * (n + m - both)
    return out


def _verify_pairs(n: int, percent: int):
    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        uid = np.asarray(texts.column("uid"))
        sets = shingle_sets(texts.column("text").to_pylist(), n)
        by = np.argsort(uid)
        place = [by[np.searchsorted(uid[by], np.asarray(pairs.column(c)))] for c in ("a", "b")]
        return (pairs.select(["a", "b", "ca", "cb"])
                .append_column("linked", pa.array(_linked(sets, *place, percent), pa.bool_())))

    return run


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, ca, cb, linked): each pair decided on whole sets, in buckets of about ``BUCKET`` pairs."""
    buckets = max(1, math.ceil(pairs.count() / BUCKET))
    bucket = F.pmod(F.xxhash64("a"), F.lit(buckets))
    ends = pairs.select(bucket.alias("lot"), F.explode(F.array("a", "b")).alias("uid")).distinct()
    dealt = pairs.select(bucket.alias("bucket"), "a", "b", "ca", "cb").groupBy("bucket")
    return (ends.join(texts, "uid").groupBy("lot").cogroup(dealt)
            .applyInArrow(_verify_pairs(n, percent), "a long, b long, ca long, cb long, linked boolean"))


def _relabel(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    return (rows.join(roots.select(F.col("node").alias(column), "root"), column, "left")
            .withColumn(column, F.coalesce("root", column)).drop("root"))


def _follow(labels: DataFrame, up: DataFrame) -> DataFrame:
    """``labels`` (node, root) with each root replaced by its own root in ``up``."""
    then = up.select(F.col("node").alias("middle"), "root")
    return (labels.select("node", F.col("root").alias("middle")).join(then, "middle", "left")
            .select("node", F.coalesce("root", "middle").alias("root")))


def _merge(found: DataFrame) -> DataFrame:
    """(node, root) for all components with a link: the smallest one within a few links.

    Where a chain of links is longer than that, its parts meet again later; ``components`` closes the rest.
    """
    both = found.select(F.col("ca").alias("node"), F.col("cb").alias("root")).unionByName(
        found.select(F.col("cb").alias("node"), F.col("ca").alias("root")))
    up = materialize(both.groupBy("node").agg(F.least("node", F.min("root")).alias("root")))
    twice = _follow(up, up)
    return materialize(_follow(twice, up))


def close_regions(members: DataFrame, texts: DataFrame, n: int, percent: int, worth: int = BUCKET,
                  ) -> tuple[list[DataFrame], DataFrame | None]:
    """Links along the sorted orders as staged tables of (a, b), and the labels (node, root) they lead to.

    In each round every component offers its pair with the longest common prefix; components that found a link go on
    with what they have become, others rest.  Sets of one label are connected by links that were verified.  A round
    of fewer than ``worth`` pairs is left to the cells of ``remaining_links``, which find the same links.
    """
    pair = [F.least("uid", "previous").alias("a"), F.greatest("uid", "previous").alias("b")]
    beside = members.where(F.col("previous").isNotNull()).groupBy(*pair).agg(F.max("shared").alias("shared"))
    edges = materialize(beside.select("a", "b", "shared", F.col("a").alias("ca"), F.col("b").alias("cb"),
                                      F.lit(True).alias("go_a"), F.lit(True).alias("go_b")))
    links, moves = [], []
    while True:
        columns = ["a", "b", "ca", "cb", "shared"]
        offers = edges.where("go_a").select(F.col("ca").alias("c"), *columns).unionByName(
            edges.where("go_b").select(F.col("cb").alias("c"), *columns))
        best = offers.groupBy("c").agg(F.max(F.struct("shared", "a", "b", "ca", "cb")).alias("p"))
        pairs = materialize(best.select("p.a", "p.b", "p.ca", "p.cb").distinct())
        if pairs.count() < worth:
            break
        tested = materialize(verify(pairs, texts, n, percent))
        up = _merge(tested.where("linked"))
        if up.isEmpty():
            break
        links.append(tested.where("linked").select("a", "b"))
        moves.append(up)
        left = edges.select(*columns).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        for side in "ab":
            new = up.select(F.col("node").alias(f"c{side}"), F.col("root").alias("to"))
            left = (left.join(new, f"c{side}", "left").withColumn(f"go_{side}", F.col("to").isNotNull())
                    .withColumn(f"c{side}", F.coalesce("to", f"c{side}")).drop("to"))
        edges = materialize(left.where("ca <> cb AND (go_a OR go_b)"))
    if not moves:
        return links, None
    labels = moves[0]
    for up in moves[1:]:
        labels = _follow(labels, up).unionByName(up.join(labels.select("node"), "node", "left_anti"))
    return links, materialize(labels)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])


def _alike(share: float):
    """Pairs of different components whose signatures agree in a share of ``share``, as a spanning forest per node."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        node, uid, comp = (np.asarray(table.column(c)) for c in ("node", "uid", "comp"))
        low = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(uid), -1)
        a, b = [], []
        by = np.argsort(node, kind="stable")
        for x, y in _runs(node[by]):
            at = by[x:y]
            left, right = [], []
            for k in range(1, len(at)):
                other = np.flatnonzero(comp[at[:k]] != comp[at[k]])
                near = other[(low[at[other]] == low[at[k]]).mean(axis=1) >= share]
                left.append(near)
                right.append(np.full(len(near), k))
            if left:
                root = union_labels(len(at), np.concatenate(left), np.concatenate(right))
                child = np.flatnonzero(root != np.arange(len(at)))
                a.append(uid[at[child]])
                b.append(uid[at[root[child]]])
        columns = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (a, b)]
        return pa.table(columns, schema=schema)

    return run


def _meet(part: Column, parts: Column) -> Column:
    """Every unordered pair of parts with ``part`` in it."""
    return F.transform(F.sequence(F.lit(0), parts - 1),
                       lambda k: F.struct(F.least(k, part).alias("i"), F.greatest(k, part).alias("j")))


def _in_cells(rows: DataFrame, size: int, key: str) -> DataFrame:
    """Rows of a key in parts of about ``size``, once for each cell (i, j) of two parts that holds two components."""
    many = rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias("parts"),
                                 F.min("comp").alias("least"), F.max("comp").alias("most"))
    cut = rows.join(materialize(many.where("least <> most").drop("least", "most")), key)
    part = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")
    cells = materialize(cut.withColumn("part", part).withColumn("cell", F.explode(_meet(F.col("part"), F.col("parts"))))
                        .select(key, "uid", "comp", "part", "cell.i", "cell.j"))
    mixed = cells.groupBy(key, "i", "j").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
    return cells.join(materialize(mixed.where("least <> most").select(key, "i", "j")), [key, "i", "j"])


def _verify_cell(n: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        uid, comp, part, i, j = (np.asarray(table.column(c)) for c in ("uid", "comp", "part", "i", "j"))
        sets = shingle_sets(table.column("text").to_pylist(), n)
        size = np.array([len(s) for s in sets], dtype=np.int64)
        value, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = np.flatnonzero(times > 1)
        column = np.full(len(value), -1)
        column[shared] = np.arange(len(shared))
        column = column[place]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, len(shared), 4096):
            hit = (column >= at) & (column < at + 4096)
            dense = np.zeros((len(sets), min(4096, len(shared) - at)), dtype=np.float32)
            dense[owner[hit], column[hit] - at] = 1
            both += dense @ dense.T
        both = both.astype(np.int64)
        linked = (100 * both >= percent * (size[:, None] + size[None] - both)) & (comp[:, None] != comp[None])
        if i[0] != j[0]:
            linked &= part[:, None] != part[None]  # pairs of one part meet in a cell of their own
        x, y = np.nonzero(np.triu(linked))
        root = union_labels(len(uid), x, y)
        child = np.flatnonzero(root != np.arange(len(uid)))
        return pa.table([pa.array(uid[child]), pa.array(uid[root[child]])], schema=schema)

    return run


def remaining_links(members: DataFrame, classes: DataFrame, texts: DataFrame, labels: DataFrame | None, n: int,
                    percent: int, count: int, cell: int = CELL, node: int = NODE) -> DataFrame:
    """Links between sets that share a node and that the rounds left with different labels: staged (a, b)."""
    def components(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("comp", F.col("uid"))
        return _relabel(rows, labels, "comp") if labels is not None else rows

    cells = materialize(_in_cells(materialize(components(members.select("node", "uid").distinct())), node, "node"))
    groups = max(1, cells.count() // 2000)
    # cells of small nodes share a call
    near = (cells.join(classes.select("uid", "signature"), "uid")
            .withColumn("many", F.when(F.col("j") > 0, F.col("node")).otherwise(F.pmod("node", F.lit(groups)))))
    sure = percent / 100
    share = sure - 6 * math.sqrt(sure * (1 - sure) / count)  # six standard deviations below the threshold
    ties = star_roots(materialize(near.groupBy("many", "i", "j").applyInArrow(_alike(share), "a long, b long")), [],
                      hubs=True)
    open_sets = (ties.select(F.col("node").alias("uid"), F.col("root").alias("tie"))
                 .unionByName(ties.select(F.col("root").alias("uid"), F.col("root").alias("tie"))).distinct())
    dealt = _in_cells(materialize(components(open_sets)), cell, "tie")
    return materialize(dealt.join(texts, "uid").groupBy("tie", "i", "j").applyInArrow(
        _verify_cell(n, percent), "a long, b long"))


def components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, least: int = LEAST_DEPTH,
               depth: int = DEPTH, cell: int = CELL, node: int = NODE, worth: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct ``n``-word shingles, letters A-Z in lower case; a text of fewer words is one
    shingle.  Documents are linked when 100 * intersection >= ``percent`` * union.  ``component_id`` is the smallest
    doc_id reachable over links, the document's own included; ``kept`` says whether it is the document's own.

    A null or empty text has no shingle and is linked with nothing.  Rows that share a doc_id keep rows of their own.
    Null ids take part: the smallest id is taken over those that are not null, and is null where a component has
    none, which keeps its rows.  Other columns are dropped; an empty table gives no rows.

    A pair at the threshold stands under one prefix of ``least`` minima in some tree with a chance of
    1 - (1 - 0.8**5)**32, that is all but 3e-6; similarities are exact over 64-bit hashes of shingles.
    """
    docs = docs.select("doc_id", "text")
    count = trees * least
    sketches = materialize(sketch(docs, n, count))
    key = ["set_a", "set_b"]
    sets = materialize(sketches.where("n_shingles > 0").groupBy(*key).agg(
        F.min("doc_id").alias("low"), F.min("uid").alias("uid")))
    classes = materialize(sketches.join(sets.select("uid", "low"), "uid")
                          .select("uid", "low", "doc_id", "digest", "signature"))
    members = materialize(forest(classes, trees, least, depth))
    # a class is read again by its first row's id and digest
    wanted = members.select("uid").distinct().join(classes.drop("signature"), "uid")
    rows = docs.withColumn("digest", F.xxhash64("text")).withColumnRenamed("doc_id", "_id").hint("merge")
    texts = materialize(rows.join(wanted.hint("merge"), (F.col("_id").eqNullSafe(F.col("doc_id")))
                                  & (rows.digest == wanted.digest)).select("uid", "text").dropDuplicates(["uid"]))
    links, labels = close_regions(members, texts, n, percent, worth)
    links.append(remaining_links(members, classes, texts, labels, n, percent, count, cell, node))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    placed = sets.withColumn("comp", F.col("uid"))
    if labels is not None:
        every = _relabel(_relabel(every, labels, "a"), labels, "b")
        placed = _relabel(placed, labels, "comp")
    roots = star_roots(materialize(every.where("a <> b")), [], hubs=True)
    placed = materialize(_relabel(placed, roots, "comp"))
    lowest = materialize(placed.groupBy("comp").agg(F.min("low").alias("component_id")))
    found = placed.join(lowest, "comp").select(*key, "component_id")
    out = sketches.select("doc_id", *key, "n_shingles").join(found, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      component.eqNullSafe(F.col("doc_id")).alias("kept"))
