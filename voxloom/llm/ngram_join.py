"""Near duplicates by word n-grams: banded MinHash LSH, then exact verification.

Texts with the same set of n-grams form a class at once.  Every class has one
signature per tree (band); classes with the same prefix in a tree are
neighbours.  The length of the prefix is fixed before the data is read: the
longest at which the chance of meeting a pair at the threshold in some tree
reaches the target recall.  No signature is sorted and no longer prefix is
tried first: pairs that share one share this one too.  Neighbours whose signatures agree well enough tie classes into
groups; groups are verified in cells of bounded size on their whole n-gram
sets, where links are counted and never written out as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.words import U64, Words, mix, rolling, text_batches
from voxloom.operators.components import star_roots, union_labels
from voxloom.support import materialize

NGRAM, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 24, 8, 0.9999
#: Classes on each side of a verification cell, and classes of a node that one task compares at once.
CELL, NODE = 256, 1024
_SEED = 0x243F6A8885A308D3


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest band, of at most ``depth`` values, at which a pair at the threshold is met with chance ``recall``."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; a shorter text is one n-gram, none without a word."""
    words = Words(texts)
    grams = rolling(words.hashes, n, 0x9FB21C651E98DF25)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            out.append(rolling(words.hashes[a:b], int(b - a), 0x9FB21C651E98DF25) ^ U64(b - a))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def _minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` 32-bit minwise values of each set (rows)."""
    rng = np.random.default_rng(_SEED)
    factors = rng.integers(1, 1 << 32, count, dtype=np.uint64) | U64(1)
    shifts = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.empty((len(sets), count), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k, values in enumerate(sets):
            low = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
            for at in range(0, len(values), 1024):
                part = ((values[at:at + 1024, None] * factors) + shifts) >> U64(32)
                np.minimum(low, part.min(axis=0).astype(np.uint32), out=low)
            out[k] = low
    return out


def sketch(docs: DataFrame, n: int, trees: int, depth: int, row: str | None = None) -> DataFrame:
    """uid, doc_id, set_a and set_b (128-bit identity of the n-gram set), n_grams, node keys and signature.

    The uid of a row is its value in column ``row``, where that is given.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["uid", "doc_id", "set_a", "set_b", "n_grams", "nodes", "signature"]

    def run(batches):
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 40
        for batch, texts in text_batches(batches, "text", 1 << 20):
            sets = ngram_sets(texts, n)
            low = _minima(sets, trees * depth)
            with np.errstate(over="ignore"):
                a = np.array([s.sum(dtype=U64) for s in sets], dtype=U64)
                b = np.array([mix(s + U64(_SEED)).sum(dtype=U64) for s in sets], dtype=U64)
                nodes = np.zeros((len(sets), trees), dtype=U64)
                for d in range(depth):
                    nodes = mix(nodes * U64(31) + low[:, d::depth].astype(U64) + U64(d))
                nodes = mix(nodes + np.arange(trees, dtype=U64))
            short = np.ascontiguousarray((low & 0xFFFF).astype(np.uint16))
            yield pa.RecordBatch.from_arrays([
                batch.column(2) if row else pa.array(np.arange(uid, uid + len(sets))), batch.column(0), pa.array(a.view(np.int64)),
                pa.array(b.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(list(nodes.view(np.int64)), pa.list_(pa.int64())),
                pa.array([r.tobytes() for r in short], pa.binary())], names=names)
            uid += len(sets)

    return docs.select("doc_id", "text", *([row] if row else [])).mapInArrow(
        run, f"uid long, doc_id {kind}, set_a long, set_b long, n_grams long, nodes array<long>, signature binary")


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])


def _ties(signatures: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose signatures agree in a share of ``least``, as a spanning forest."""
    left, right = [], []
    for k in range(1, len(signatures)):
        near = np.flatnonzero((signatures[:k] == signatures[k]).mean(axis=1) >= least)
        left.append(near)
        right.append(np.full(len(near), k))
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    root = union_labels(len(signatures), np.concatenate(left), np.concatenate(right))
    child = np.flatnonzero(root != np.arange(len(root)))
    return child, root[child]


def _tie_node(least: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        uid = np.asarray(table.column("uid"))
        raw = b"".join(table.column("signature").to_pylist())
        signatures = np.frombuffer(raw, dtype=np.uint16).reshape(len(uid), -1)
        node = np.asarray(table.column("node"))
        by = np.argsort(node, kind="stable")
        a, b = [], []
        for x, y in _runs(node[by]):
            child, root = _ties(signatures[by[x:y]], least)
            a.append(uid[by[x:y]][child])
            b.append(uid[by[x:y]][root])
        return pa.table([pa.array(np.concatenate(a) if a else []).cast(pa.int64()),
                         pa.array(np.concatenate(b) if b else []).cast(pa.int64())], schema=schema)

    return run


def _cells(index: Column, parts: Column) -> Column:
    """Every unordered pair of parts that holds ``index``: an array of (low part, high part)."""
    other = F.sequence(F.lit(0), parts - 1)
    return F.transform(other, lambda x: F.struct(F.least(x, index).alias("i"), F.greatest(x, index).alias("j")))


def candidate_groups(sketches: DataFrame, classes: DataFrame, least: float, node_size: int = NODE) -> DataFrame:
    """(node, root): classes tied through shared bands, by uid; classes without a neighbour are absent."""
    entries = (sketches.join(classes.select("uid"), "uid").where("n_grams > 0")
               .select("uid", F.explode("nodes").alias("node")))
    sizes = entries.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(entries.join(sizes, "node"))
    groups = max(1, members.count() // 2000)
    # a node of many classes is split, and every pair of its parts meets in a task of bounded size
    parts = F.ceil(F.col("size") / node_size).cast("int")
    part = F.pmod(F.xxhash64("uid"), parts).cast("int")
    placed = (members.withColumn("parts", parts).withColumn("part", part)
              .withColumn("cell", F.explode(_cells(F.col("part"), F.col("parts"))))
              .select("uid", "node", "cell.i", "cell.j",
                      # small nodes share a group, so that a group is worth a call
                      F.when(F.col("parts") == 1, F.pmod("node", F.lit(groups))).otherwise(F.col("node"))
                      .alias("group")))
    signed = placed.join(sketches.select("uid", "signature"), "uid")
    edges = signed.groupBy("group", "i", "j").applyInArrow(_tie_node(least), "a long, b long")
    return star_roots(materialize(edges), [], hubs=True)


def _verify(n: int, threshold: float):
    schema = pa.schema([("uid", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("texts", pa.int64())])

    def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(left), len(right)), dtype=np.float32)
        rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
        values = [np.concatenate(s) for s in (left, right)]
        shared = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
        for at in range(0, len(shared), 4096):
            part = shared[at:at + 4096]
            dense = []
            for r, v, s in zip(rows, values, (left, right)):
                k = np.searchsorted(part, v)
                k[k == len(part)] = 0
                hit = part[k] == v
                d = np.zeros((len(s), len(part)), dtype=np.float32)
                d[r[hit], k[hit]] = 1
                dense.append(d)
            out += dense[0] @ dense[1].T
        return out

    def run(table: pa.Table) -> pa.Table:
        uid, part, copies, i, j = (np.asarray(table.column(c)) for c in ("uid", "part", "copies", "i", "j"))
        # the same id may name several texts: the row counts whose n-grams are those of the class
        sets = ngram_sets(table.column("text").to_pylist(), n)
        wanted = zip(table.column("set_a").to_pylist(), table.column("set_b").to_pylist())
        own = [k for k, (s, w) in enumerate(zip(sets, wanted)) if _identity(s) == w]
        own = [k for k, first in zip(own, _firsts(uid[own])) if first]
        uid, part, copies, sets = uid[own], part[own], copies[own], [sets[k] for k in own]
        low, high = np.flatnonzero(part == i[0]), np.flatnonzero(part == j[0])
        if not len(low) or not len(high):
            return schema.empty_table()
        size = np.array([len(s) for s in sets], dtype=np.float64)
        both = intersections([sets[k] for k in low], [sets[k] for k in high]).astype(np.float64)
        union = size[low][:, None] + size[high][None] - both
        linked = (both >= threshold * union - 1e-9) & (uid[low][:, None] != uid[high][None])
        links, texts = np.zeros(len(uid), dtype=np.int64), np.zeros(len(uid), dtype=np.int64)
        np.add.at(links, low, linked @ copies[high])
        np.add.at(texts, low, linked.sum(axis=1))
        if i[0] != j[0]:
            np.add.at(links, high, linked.T @ copies[low])
            np.add.at(texts, high, linked.sum(axis=0))
        x, y = np.nonzero(linked)
        order = np.argsort(uid, kind="stable")
        place = np.argsort(order, kind="stable")
        root = uid[order][union_labels(len(uid), place[low[x]], place[high[y]])][place]
        some = texts > 0
        return pa.table([pa.array(c[some]) for c in (uid, root, links, texts)], schema=schema)

    return run


def _identity(values: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = values.sum(dtype=U64), mix(values + U64(_SEED)).sum(dtype=U64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _firsts(uid: np.ndarray) -> np.ndarray:
    out = np.zeros(len(uid), dtype=bool)
    out[np.unique(uid, return_index=True)[1]] = True
    return out


def join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
         recall: float = RECALL, cell: int = CELL, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_text_links, copies.

    Two documents are linked when the Jaccard similarity of their sets of word
    n-grams is at least ``threshold``.  ``class_id`` is the smallest doc_id
    reachable over links, ``n_links`` the number of other documents linked to
    this one, ``n_text_links`` the number of different n-gram sets among them
    apart from its own, ``copies`` the documents with its own set.

    A text of fewer than ``n`` words is one n-gram.  A null or empty text has
    none: it is linked to nothing and is its own class.  Null ids take part and
    count as smallest.  Rows that share a doc_id keep rows of their own.

    ``row`` names a column of distinct longs that are stored with the rows.  The
    result then also has ``uid``, the row's own, and ``class_uid``, that of the
    row with the smallest (doc_id, uid) reachable over links.

    Candidates share a band, so a link at the threshold is met with a chance of
    ``recall`` at least; similarities are exact over 64-bit hashes.
    """
    docs = docs.select("doc_id", "text", *([F.col(row).alias("__row")] if row else []))
    depth = prefix_depth(threshold, trees, depth, recall)
    sketches = materialize(sketch(docs, n, trees, depth, "__row" if row else None))
    some = sketches.where("n_grams > 0")
    key = ["set_a", "set_b"]
    classes = materialize(some.groupBy(*key).agg(
        F.min(F.struct("doc_id", "uid")).alias("first"), F.count("*").alias("copies"))
        .select(*key, "first.doc_id", "first.uid", "copies"))
    # six standard deviations below the threshold: the signature leaves out no pair that is linked
    count = trees * depth
    least = threshold - 6 * math.sqrt(threshold * (1 - threshold) / count)
    groups = candidate_groups(sketches, classes, least)
    groups = materialize(groups.select(F.col("node").alias("uid"), F.col("root").alias("group"))
                         .unionByName(groups.select(F.col("root").alias("uid"), F.col("root").alias("group")))
                         .distinct())
    parts = groups.groupBy("group").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts"))
    members = materialize(groups.join(parts, "group").join(classes, "uid").withColumn(
        "part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")))
    # the same plan at every size: texts are dealt out by id, never joined against a copied side
    members = members.withColumnRenamed("doc_id", "_id").hint("merge")
    same = F.col("__row") == F.col("uid") if row else F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = docs.join(members, same).drop("_id", "doc_id")
    cells = (texts.withColumn("c", F.explode(_cells(F.col("part"), F.col("parts"))))
             .select("group", "c.i", "c.j", "uid", "part", "copies", *key, "text"))
    found = materialize(cells.groupBy("group", "i", "j").applyInArrow(
        _verify(n, threshold), "uid long, root long, links long, texts long"))
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    roots = star_roots(found.where("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b")), [], hubs=True)
    roots = roots.select(F.col("node").alias("uid"), "root")
    linked = (classes.join(counts, "uid", "left").join(roots, "uid", "left")
              .withColumn("root", F.coalesce("root", "uid")))
    smallest = materialize(roots.select("root", "uid").unionByName(roots.select("root", F.col("root").alias("uid")))
                           .distinct().join(classes.select("uid", "doc_id"), "uid")
                           .groupBy("root").agg(F.min(F.struct("doc_id", "uid")).alias("low")))
    table = (linked.join(smallest, "root", "left")
             .select(*key, "copies", F.coalesce("low.uid", "uid").alias("class_uid"), F.coalesce("links", F.lit(0)).alias("links"),
                     F.coalesce("texts", F.lit(0)).alias("texts"),
                     F.when(F.col("low").isNotNull(), F.col("low.doc_id")).otherwise(F.col("doc_id")).alias("class_id")))
    out = sketches.select("uid", "doc_id", *key, "n_grams").join(table, key, "left")
    empty = F.col("n_grams") == 0
    rows = ["uid", F.when(empty, F.col("uid")).otherwise(F.col("class_uid")).alias("class_uid")] if row else []
    return out.select(
        *rows, "doc_id", F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(empty, F.lit(0)).otherwise(F.col("texts")).cast("long").alias("n_text_links"),
        F.when(empty, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("copies"))
