"""License scans against a plain scan of all starts."""

import random
import time

import pytest

from voxloom.llm import license_scan


def all_starts(words, template, coverage, deciding=frozenset()):
    need = max(1, -(-int(1000 * coverage) * len(template) // 1000))
    out, done = [], 0
    for first, word in enumerate(words):
        if first < done or word not in template:
            continue
        pairs = license_scan.align(words[first:first + 2 * len(template)], template)
        if len(pairs) >= need and pairs[0][0] == 0 and deciding <= {template[k] for _, k in pairs}:
            done = first + pairs[-1][0] + 1
            out.append((first, done, len(pairs)))
    return out


def damaged(rng, words, share):
    out = []
    for w in words:
        kind = rng.random()
        if kind < share:
            out += [] if kind < share / 3 else [rng.choice(words)] if kind < share / 1.5 else [w, f"w{rng.randrange(9)}"]
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("name, share", [("BSD-2-Clause-whole", 0.05), ("BSD-2-Clause-whole", 0.2), ("BSD-2-Clause-whole", 0.3),
                                         ("MIT-text", 0.1), ("Apache-2.0", 0.2)])
def test_every_start_counts(name, share):
    template = license_scan.words_of((license_scan.TEMPLATES | license_scan.whole_texts())[name])
    for seed in range(12 if len(template) > 100 else 60):
        rng = random.Random(seed)
        words = damaged(rng, template, share)
        around = [rng.choice(template) for _ in range(rng.randrange(40))]
        words = around + words + around[::-1] + (damaged(rng, template, share) if seed % 3 == 0 else [])
        assert license_scan.scan_words(words, template, 0.8) == all_starts(words, template, 0.8), seed


def test_random_words_of_few_kinds():
    rng = random.Random(7)
    for _ in range(300):
        template = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
        words = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 60))]
        assert license_scan.scan_words(words, template, 0.6) == all_starts(words, template, 0.6)


def test_common_length():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert license_scan.common_length(a, b) == table[-1][-1]


def test_overlaps():
    rng = random.Random(5)
    for _ in range(200):
        items = [(k, a, a + rng.randint(1, 9)) for k, a in enumerate(rng.randrange(60) for _ in range(12))]
        taken = []
        for item in items:
            if all(item[2] <= x or y <= item[1] for _, x, y in taken):
                taken.append(item)
        assert license_scan.apart(items) == taken


def test_a_very_long_text(spark):
    whole = license_scan.whole_texts()["GPL-2.0-whole"]
    rng = random.Random(2)
    filler = " ".join(rng.choice("of the river to light a paper stone in and or".split()) for _ in range(30_000))
    start = time.perf_counter()
    docs = spark.createDataFrame([(1, f"{filler} {whole} {filler}")], "doc_id long, text string")
    found = [(r.license, r.n_matched) for r in license_scan.scan(docs).collect()]
    assert ("GPL-2.0-whole", len(license_scan.words_of(whole))) in found and time.perf_counter() - start < 240
