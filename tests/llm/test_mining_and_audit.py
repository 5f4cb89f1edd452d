"""Hard negatives, filter interactions and forest components against plain Python."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.llm import filter_audit, hard_negatives, lsh_forest


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# ---- hard negatives

@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 9), st.integers(1, 30), st.integers(0, 40), st.sampled_from([1, 1500]))
def test_products_are_exact(seed, bits, rows, width):
    rng = np.random.default_rng(seed)
    top = 1 << bits
    a, b = rng.integers(-top, top + 1, (7, width)), rng.integers(-top, top + 1, (rows, width))
    a[0], b[:1] = top, -top  # the largest products there are
    bound = math.sqrt(float((a.astype(float) ** 2).sum(1).max()) * float((b.astype(float) ** 2).sum(1).max(initial=0)))
    if bound * 1.01 >= 2 ** 62:
        with pytest.raises(OverflowError):
            hard_negatives.moduli(bound * 1.01)
        return
    mods = hard_negatives.moduli(bound * 1.01)
    got = hard_negatives.products(hard_negatives.residues(a, mods), hard_negatives.residues(b, mods), mods)
    assert np.array_equal(got, a.astype(np.int64) @ b.astype(np.int64).T)


def mined(rows, is_anchor, positives=5, negatives=5, low=80, high=100, scale=256):
    """(anchor, positive, rank, negative, scores) by comparing everything with everything."""
    good = [(i, label, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, label in rows
            if i is not None and label is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (anchor, label, v) in enumerate(good):
        if not is_anchor(anchor):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other == label) for j, (i, other, w) in enumerate(good) if j != k]
        scored.sort()
        for score, positive, _ in [s for s in scored if s[2]][:positives]:
            inside = [(-s, i) for s, i, same in scored if not same and low * -score <= 100 * -s <= high * -score]
            out += [(anchor, positive, r, i, -score, s) for r, (s, i) in enumerate(inside[:negatives], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, uid string, score string, k string, i int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, "u", "s", "k", 7) for i, v, label in rows], VECTORS).repartition(parts)


def test_hard_negatives_of_odd_rows(spark):
    rng = random.Random(4)
    # few different vectors, so ties are common; one label has a third of all rows
    pool = [[round(rng.uniform(-1, 1), 2) for _ in range(5)] for _ in range(12)]
    rows = [(i, rng.choice(pool), rng.choice([0, 0, 1, 2, 3])) for i in range(300)]
    rows += [(300, pool[0], None), (400, None, 1), (500, [0.1, None, 0.2, 0.1, 0.3], 1), (600, [float("nan")] * 5, 1),
             (700, [float("inf")] * 5, 1), (None, pool[1], 1), (800, [], 1), (900, [0.0] * 5, 2), (1000, pool[3][:3], 0),
             (1100, [-0.001] * 5, 3), (7, pool[5], 0), (7, pool[5], 0), (1200, [3e5, -2e5, 1e5, 0.5, 4e5], 1),
             (1201, [4e5, -2e5, 1e5, 0.5, 4e5], 1), (1202, [3.5e5, -2e5, 1e5, 0.5, 4e5], 2), (100, pool[2], 1),
             (100, pool[2], 1)]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows, lambda i: i % 100 == 0)
    assert want and sorted(map(tuple, got.collect())) == want
    some = hard_negatives.mine(frame(spark, rows), F.col("label") == 3, positives=2, negatives=3, low=50, high=90, scale=10)
    assert sorted(map(tuple, some.collect())) == mined(
        [r for r in rows if r[2] is not None], lambda i: i in {r[0] for r in rows if r[2] == 3}, 2, 3, 50, 90, 10)


def test_cells_do_not_change_the_negatives(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-0.4, 0.6) for _ in range(8)], rng.randrange(3)) for i in range(500)]
    want = mined(rows, lambda i: i % 10 == 0)
    for name, value in (("CELL_ROWS", 60), ("CELL_ANCHORS", 20), ("TILE_ROWS", 16), ("TILE_ANCHORS", 3), ("SLAB", 7)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert sorted(map(tuple, hard_negatives.mine(frame(spark, rows, 5), F.col("vec_id") % 10 == 0).collect())) == want


def test_hard_negatives_without_rows(spark):
    none = frame(spark, []).limit(0)
    assert hard_negatives.mine(none, F.col("vec_id") % 100 == 0).count() == 0
    only = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)]  # no other label
    assert hard_negatives.mine(frame(spark, only), F.col("vec_id") % 100 == 0).count() == 0


def test_components_outside_32_bits_are_an_error(spark):
    with pytest.raises(Exception, match="32 bits"):
        hard_negatives.mine(frame(spark, [(0, [1e20], 1)]), F.col("vec_id") == 0).collect()


# ---- filter interactions

def audited(docs, labels):
    """The rows of the audit by applying the filters one after the other in every order."""
    texts = [(i, t or "", lang or "") for i, t, lang in docs]
    smallest = {}
    for i, t, _ in texts:
        if i is not None:
            smallest[t] = min(smallest.get(t, i), i)
    flags = {k: {i for i, *f in labels if f[k] == 1 and i is not None} for k in (0, 1)}

    def fails(i, t):
        w = split(t)
        return {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and smallest[t] < i)) if bad}
    rows = [(i, lang, fails(i, t)) for i, t, lang in texts]
    out = {}
    for part in {lang for _, lang, _ in rows}:
        own = [(i, f) for i, lang, f in rows if lang == part]
        gained = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                gained[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == {letter} for _, f in own),
                    sum(i in flags[0] for i, _ in gone), sum(i in flags[1] for i, _ in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(gained[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_interactions_of_odd_rows(spark, odd):
    docs = odd.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "fr")
                          .otherwise(F.lit(None))).withColumns({c: F.lit(c) for c in ("mask", "part", "digest", "n")})
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (4, None, 1), (12, 1, 1), (14, 0, 0), (None, 1, 1), (99, 1, 1), (19, 1, 0)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(0))
    got = filter_audit.interactions(docs, told)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    found = list(map(tuple, got.collect()))
    assert len(found) == len(set(found)) == 3 * 600
    assert set(found) == audited(rows, labels)


def test_interactions_without_rows(none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(none, labels).count() == 0


def test_removal_step_is_the_first_failing_filter():
    orders = np.array(list(itertools.permutations(range(4))))
    steps = filter_audit.removal_steps(np.arange(16), np.argsort(orders, axis=1))
    for mask in range(16):
        for o, order in enumerate(orders):
            first = next((s for s, f in enumerate(order) if mask >> f & 1), 4)
            assert steps[mask, o] == first


# ---- forest components

def shingled(text, n=4):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in split(text)]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def grouped(rows, percent=80):
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[top(b)] = top(a)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(top(k), []).append(i)
    found = [min((i for i in low[top(k)] if i is not None), default=None) for k in range(len(rows))]
    return sorted(((i, len(s), c, c == i) for (i, _), s, c in zip(rows, sets, found)), key=str)


def components_of(frame, **options):
    return sorted(map(tuple, lsh_forest.components(frame, **options).collect()), key=str)


@pytest.fixture()
def few(spark):
    """The many small jobs of the rounds with few tasks each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_components_of_odd_rows(spark, few, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert components_of(odd) == grouped(rows)
    assert lsh_forest.components(none).count() == 0
    case = [(5, "One TWO three Four five"), (3, "one two THREE four five"), (9, "ÀB"), (8, "àb"), (7, "AB"), (6, "ab")]
    assert components_of(spark.createDataFrame(case, "doc_id long, text string")) == grouped(case)


@pytest.mark.parametrize("cell, node, worth", [(5, 7, 1), (256, 1024, 10 ** 6)])
def test_components_of_families(spark, few, cell, node, worth):
    """Families of near copies around the threshold, a chain and a boilerplate that unlinked texts share."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    texts = []
    for size, changes in ((40, 1), (25, 3), (30, 5), (30, 8)):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(changes + 1)):
                copy[rng.randrange(120)] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(100)]
    for _ in range(30):
        texts.append(" ".join(chain))
        chain = chain[5:] + [word() for _ in range(5)]
    plate = [word() for _ in range(90)]
    texts += [" ".join(plate + [word() for _ in range(14 + k % 9)]) for k in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert components_of(frame, cell=cell, node=node, worth=worth) == grouped(rows)


def test_sorted_orders_find_every_run(spark):
    """Every set beside another under a prefix is a member of its node, whatever partition or batch it is in."""
    rng = np.random.default_rng(3)
    low = rng.integers(0, 3, (200, 12)).astype(np.uint16)
    rows = [(int(k), bytearray(r.tobytes())) for k, r in enumerate(low)]
    frame = spark.createDataFrame(rows, "uid long, signature binary")
    members = lsh_forest.forest(frame, trees=4, least=3, depth=5).collect()
    wanted = Counter()
    for t in range(4):
        nodes = Counter(tuple(r[3 * t:3 * t + 3]) for r in low)
        wanted.update(k for k, r in enumerate(low) if nodes[tuple(r[3 * t:3 * t + 3])] > 1)
    found = Counter(m.uid for m in members)
    assert all(found[k] >= n for k, n in wanted.items())
    for m in members:
        if m.previous is not None:
            turned = [[np.roll(low[u], -3 * t)[:5].tolist() for t in range(4)] for u in (m.uid, m.previous)]
            assert any(a[:m.shared] == b[:m.shared] for a, b in zip(*turned)) and m.shared >= 3
