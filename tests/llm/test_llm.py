"""Each operator against brute force, with awkward rows and an empty table."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from voxloom.llm import (binary_codes, byte_bpe, html_extract, license_scan, ngram_join, packing, quality_classifier,
                         rule_ledger, substring_dedup, token_counts)
from voxloom.llm.word_bpe import WordBpe
from voxloom.llm.words import Words, pack_arrays, unpack_arrays

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_and_windows():
    texts = ["a bb  ccc\n", None, "", "bb ccc a bb ccc", "é ü\x0bé"]
    words = Words(texts)
    assert [[w.decode() for w in words.words_of(i)] for i in range(5)] == [split(t) for t in texts]
    flat = [w for t in texts for w in split(t)]
    assert all((x == y) == (a == b) for x, a in zip(flat, words.hashes) for y, b in zip(flat, words.hashes))
    hashes, owner, start = words.windows(2)
    runs = [(i, s, tuple(split(t)[s:s + 2])) for i, t in enumerate(texts) for s in range(len(split(t)) - 1)]
    assert [(i, s) for i, s, _ in runs] == list(zip(owner, start))
    assert all((x[2] == y[2]) == (a == b) for x, a in zip(runs, hashes) for y, b in zip(runs, hashes))


def test_packed_arrays_round_trip():
    arrays = [np.arange(5), np.zeros(1000, np.uint16), np.random.default_rng(0).integers(0, 255, 99).astype(np.uint8)]
    assert all((a == b).all() for a, b in zip(arrays, unpack_arrays(pack_arrays(*arrays))))


# substring dedup

def removed(rows, width):
    first, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = split(text)
        cover = [False] * len(words)
        for s in range(len(words) - width + 1):
            k = tuple(words[s:s + width])
            if k in first:
                cover[s:s + width] = [True] * width
            first.setdefault(k, (i, s))
        kept = [w for w, c in zip(words, cover) if not c]
        out.append((i, len(words), sum(cover), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, *[x or 0 for x in r[:1]], *map(str, r[1:])))


@pytest.mark.parametrize("width", [3, 20])
def test_repeats_are_removed(odd, width):
    distinct = odd.dropDuplicates(["doc_id"])
    got = substring_dedup.remove_repeats(distinct, width, bucket_windows=5000, group_bytes=100_000)
    assert got.columns == [c for c in odd.columns if c != "n_words"] + ["n_words", "n_removed", "kept_sha256", "spans"]
    rows = [(r.doc_id, r.text) for r in distinct.select("doc_id", "text").collect()]
    found = [tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert by_id(found) == by_id(removed(rows, width))


def test_repeats_in_spans_and_untouched_texts(odd, none):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(odd.where("doc_id in (1, 2, 4, 6)")).collect()}
    assert got[1].n_removed == 0 and got[4].text is None and got[6].text == " \n\t "
    assert [tuple(s) for s in got[2].spans] == [(0, 120)] and got[2].text == ""
    assert substring_dedup.remove_repeats(none).count() == 0


def test_window_chunks_hold_few_copies():
    """A chunk of a million windows takes less than a hundred bytes a window."""
    rng = np.random.default_rng(7)
    batches = [pa.RecordBatch.from_arrays([
        pa.array(np.arange(k, k + 4)),
        pa.array([" ".join(map(str, rng.integers(10_000, 100_000, 16_000))) for _ in range(4)])], names=["doc_id", "text"])
        for k in range(0, 64, 4)]
    shared = np.packbits(np.zeros(substring_dedup.SHARED_BITS, dtype=bool))
    tracemalloc.start()
    out = list(substring_dedup._window_rows(20, 4, 4, shared)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    windows = sum(len(unpack_arrays(blob.as_py())[0]) for batch in out for blob in batch.column("windows"))
    assert windows == 64 * (16_000 - 19)
    assert peak < 100 * windows


def test_rows_that_share_an_id_lose_only_their_own_repeats(spark):
    a, b, c, d = (" ".join(f"{s}{k}" for k in range(60)) for s in "abcd")
    rows = [(7, a), (7, a), (8, b), (8, c + " " + b), (8, d), (None, d), (None, d), (None, c), (9, a), (9, b + " " + d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.remove_repeats(docs, 20, bucket_windows=50, group_bytes=500)
    texts = {(None, d): d, (None, c): c, (7, a): a, (8, b): b, (8, c + " " + b): "", (8, d): "", (9, a): "",
             (9, b + " " + d): ""}
    expected = sorted((str(i), texts[i, t], len(split(t))) for i, t in rows)
    assert sorted((str(r.doc_id), r.text, r.n_words) for r in got.collect()) == expected


# n-gram join

def grams(text, n=5):
    w = split(text)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def links(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    near = [[b for b in range(len(rows)) if a != b and sets[a] and sets[b]
             and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9] for a in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, bs in enumerate(near):
            for b in bs:
                low = min(label[a], label[b])
                if label[a] != low or label[b] != low:
                    label[a] = label[b] = low
                    changed = True
    smallest = {}
    order = lambda i: (i is not None, i or 0)
    for (i, _), k in zip(rows, label):
        smallest[k] = min((smallest.get(k, i), i), key=order)
    return by_id([(i, smallest[k], len(n)) for (i, _), k, n in zip(rows, label, near)])


def test_near_duplicates_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = by_id([(r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(odd).collect()])
    assert got == links(rows)
    assert ngram_join.join(none).count() == 0


def test_near_duplicates_of_one_large_group(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(90)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id([(r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(docs, cell=32).collect()])
    assert got == links(rows)


def test_prefix_is_shortened_to_the_recall():
    depth = ngram_join.prefix_depth(0.8, 24, 8, 0.9999)
    met = lambda d: 1 - (1 - 0.8 ** d) ** 24
    assert met(depth) >= 0.9999 > met(depth + 1)


# packing

def test_word_bpe_equals_the_library():
    library, own = Tokenizer.from_file(WORD_BPE), WordBpe(WORD_BPE)
    rng = random.Random(3)
    signs = "abcXYZ019 '.,!?-_#&\t\n\r\x0b\x85\xa0éèßñÇİıſµª²½٣日本한😀ǅΣς́\x1c\x00"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["it's we've <|endoftext|>x<|startoftext|>", "a" * 300, None, ""]
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):      # the second time from the cache
        assert [np.frombuffer(b, "<u2").tolist() for b in own.ids_of(texts)] == expected


def test_pieces_hold_every_id_once(odd, none):
    library = Tokenizer.from_file(WORD_BPE)
    ids = Counter()
    for r in odd.collect():
        ids[r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids + [2])] += 1
    pieces = packing.pack(odd, WORD_BPE, length=64, with_ids=True).collect()
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
    at = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    assert all(q * 64 + o + n == q2 * 64 + o2 for (q, o, n), (q2, o2, _) in zip(at, at[1:])) and at[0][:2] == (0, 0)
    stream, found = [], Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        if p.start == 0:
            stream.append((p.doc_id, []))
        assert len(stream[-1][1]) == p.start and stream[-1][0] == p.doc_id
        stream[-1][1].extend(p.ids)
    found.update((i, tuple(t)) for i, t in stream)
    assert found == ids
    sequences = packing.sequences(packing.pack(odd, WORD_BPE, length=64, with_ids=True)).collect()
    assert sum(len(s.ids) for s in sequences) == sum(p.length for p in pieces)
    assert packing.pack(none, WORD_BPE).count() == 0


@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


# nearest neighbours

def test_neighbours_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(24)]) for i in range(900)]
    rows += [(900, rows[3][1]), (901, rows[3][1]), (1000, rows[3][1]), (902, None), (903, [0.0] * 24), (904, [1.0]),
             (905, [float("nan")] * 24), (906, [None] * 24), (907, [float("inf")] * 24), (None, rows[1][1]), (5, rows[5][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = binary_codes.search(vectors, vectors.where("vec_id % 100 = 0")).collect()
    good = {i: np.array(v) for i, v in rows if i is not None and i < 902 or i == 1000}
    hits = total = 0
    for q in [i for i in good if i % 100 == 0]:
        near = sorted((np.linalg.norm(v - good[q]), i) for i, v in good.items() if i != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(np.isclose(s, np.linalg.norm(good[i] - good[q]), atol=1e-12) for _, i, s in mine)
        hits += len({i for _, i in near} & {m[1] for m in mine})
        total += 10
    assert hits / total >= 0.9
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1000][:3] == [
        (3, 0.0), (900, 0.0), (901, 0.0)]
    assert binary_codes.search(vectors.limit(0), vectors.limit(0)).count() == 0
    few = vectors.where("vec_id in (0, 1, 2)")
    assert binary_codes.search(few, few.where("vec_id = 0")).count() == 2


def test_repeated_near_ids_take_one_place(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(60)]
    near = [(100, [x + 1e-3 for x in rows[0][1]])] * 30
    hot = [(101, [x + 1e-3 * (k + 2) for x in rows[0][1]]) for k in range(30)]
    vectors = spark.createDataFrame(rows + near + hot, "vec_id long, embedding array<double>").coalesce(1)
    got = binary_codes.search(vectors, vectors.where("vec_id = 0")).collect()
    far = {}
    for i, v in rows[1:] + near + hot:
        d = np.linalg.norm(np.array(v) - rows[0][1])
        far[i] = min(d, far.get(i, d))
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == sorted(far, key=far.get)[:10]


# quality classifier

def test_quality_on_held_out_rows(spark, sf):
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in scored if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    # labels of held-out rows are never learned from
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 "
                               "THEN 1 - quality ELSE quality END AS quality")
    assert quality_classifier.fit(docs, turned) == quality_classifier.fit(docs, labels)


def test_quality_of_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.fit(odd, labels)
    rows = quality_classifier.score(odd, model).collect()
    assert len(rows) == odd.count() and all(r.score == 0.5 and r.predicted == 0 for r in rows)
    assert quality_classifier.score(none, model).count() == 0
    kept = quality_classifier.keep_good(odd, model, 0.4)
    assert kept.columns == odd.columns and kept.count() == odd.count()


# pages

@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<html><body><nav><a href='x'>Menu</a></nav><article><h1>T</h1><p>One&nbsp;  two<br>three <b>f</b>our</p>"
     "<div class='comments'><p>Nice!</p></div></article><footer>&copy; x</footer></body></html>",
     "T One two three four"),
    ("<article><p>a < b &lt;c&gt; &#233;&#x1F600;<!-- no --><script>var x='</p>';</script><style>p{}</style>z",
     "a < b <c> é😀z"),
    ("<article><p>cut off <b", "cut off"), ("<p>x<aside>side</aside>y<form>f</form>", "x y"),
    ("<nav><ul><li>menu<article><p>story</p></article><nav>more</nav>", "story"),
    ("<article><p title='a > b'>q</p><p hidden>secret</p></article>", "q"),
])
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_surge_and_dive_without_marks():
    menu = "".join(f"<li><a href='/{k}'>item {k}</a></li>" for k in range(8))
    body = "".join(f"<p>{'long sentence of the story ' * 5}{k}.</p>" for k in range(6))
    page = f"<ul>{menu}</ul><div>{body}</div><ul>{menu}</ul>"
    text = html_extract.main_text(page)
    assert "item" not in text and text.count("story") == 30 and text.endswith("5.")


def test_a_story_beside_marked_teasers():
    story = "".join(f"<p>{'long sentence of the story ' * 5}{k}.</p>" for k in range(12))
    menu = "".join(f"<li><a href='/{k}'>item {k}</a></li>" for k in range(8))
    teasers = "".join(f"<article class='card'><h3>Teaser {k}</h3></article>" for k in range(3))
    apart = html_extract.main_text(f"<div>{story}</div><ul>{menu}</ul>{teasers}")
    assert apart.count("story") == 60 and "Teaser" not in apart and "item" not in apart
    assert html_extract.main_text(f"<div>{story}</div>{teasers}").count("story") == 60
    posts = f"<article><p>One.</p></article><ul>{menu}</ul><article><p>Two.</p></article><p>&copy; x</p>"
    assert html_extract.main_text(posts) == "One. Two."


@pytest.mark.parametrize("page,text", [
    ("<div class='page has-sidebar'><article><p>story</p></article><div class='sidebar'>side</div></div>", "story"),
    ("<div id='main-no-sidebar'><main><p>story</p></main></div>", "story"),
    ("<article><div class='article-header'><h1>Head</h1></div><p>story</p><div class='share'>Share</div></article>",
     "Head story"),
    (f"<div class='content-with menu'><p>{'word ' * 40}end</p><div class='related'>Also</div></div>", "word " * 40 + "end"),
    (f"<p>{'word ' * 40}end</p><div class='comments'><p>{'talk ' * 30}</p></div>", "word " * 40 + "end"),
])
def test_classes_of_layout_and_of_boilerplate(page, text):
    assert html_extract.main_text(page) == text


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>Hi</p>", "x")],
                                  "page_id long, url string, html string, text string")
    rows = {(r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert rows == {(1, None, "", 0), (None, "u", "Hi", 2)}
    assert html_extract.extract(pages.limit(0)).count() == 0


# rules

def measured(text):
    words, text = split(text), text or ""
    runs = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = Counter(runs)
    cover = {k + i for k, r in enumerate(runs) if often[r] > 1 for i in range(3)}
    lines = [x for x in text.split("\n") if split(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines),
            len(lines) - len(set(lines)), len(cover))


def test_ledger_measures_and_policies(odd, none):
    entries = rule_ledger.ledger(odd)
    texts = sorted(measured(r.text) for r in odd.collect())
    rows = entries.collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words)
                  for r in rows) == texts
    for r in rows:
        assert bool(r.failed & rule_ledger.BASE) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = rule_ledger.apply_policies(entries).collect()
    for name, mask in rule_ledger.POLICIES.items():
        assert all(r[f"kept_{name}"] == (r.failed & mask == 0) for r in kept)
    mask = rule_ledger.POLICIES["v1"]
    for r in rule_ledger.ablation(entries, "v1").collect():
        bit = rule_ledger.BIT[r.rule]
        assert r.failed == sum(bool(x.failed & bit) for x in rows)
        assert r.kept == sum(x.failed & mask & ~bit == 0 for x in rows)
        assert r.alone == sum(x.failed & mask == bit for x in rows)
    assert rule_ledger.ledger(none).count() == 0


def test_ledger_runs_no_python(odd, spark, sf):
    plan = rule_ledger.ledger(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# tokens

def test_token_counts_equal_the_library(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = token_counts.count_tokens(odd, PIECES, limit=100, frequent=8).collect()
    expected = sorted((len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in odd.collect())
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == expected
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_units_never_cut_a_token():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("ab  \n\t.,é▁日1<s>\x00") for _ in range(rng.randint(0, 25)))
        assert sum(token_counts._lengths(PIECES, token_counts.units(text))) == len(library.encode(text)), repr(text)


def test_byte_bpe_round_trip(odd, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.decode(encoded, RANKS).collect()
    expected = sorted(library.encode_ordinary(r.text or "") for r in odd.collect())
    assert sorted(r.ids for r in rows) == expected
    assert sorted(bytes(r.bytes) for r in rows) == sorted((r.text or "").encode() for r in odd.collect())
    assert byte_bpe.decode(byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_an_unbroken_run_of_very_many_ids(spark):
    rng = random.Random(6)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, "two words")], "doc_id long, text string")
    rows = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    assert len(rows[1].ids) > 65_535 and bytes(rows[1].bytes) == text.encode() and bytes(rows[2].bytes) == b"two words"


def test_pre_tokens_equal_the_library():
    import regex
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    find = regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("ab 'sé\n\t\x0b\x1c\x85\xa0 1²½.!日😀") for _ in range(rng.randint(0, 20)))
        ids = [i for w in find(text) for i in library.encode_ordinary(w)]
        assert ids == library.encode_ordinary(text), repr(text)


# licenses

def test_notices_are_found(spark, none, odd):
    mit, apache = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["Apache-2.0"]
    rows = [(1, "Some text before. " + mit + ". And after."), (2, None), (3, ""), (4, "the mit of license"),
            (5, f"{apache}\nfiller words here\n{apache}"), (6, "Licensed under the Apache Licence, Version 2.0."),
            (None, mit.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.license, r.first_word, r.end_word, r.n_matched) for r in license_scan.scan(
        docs).collect())
    assert got == [(0, "MIT", 0, 5, 5), (1, "MIT", 3, 8, 5), (5, "Apache-2.0", 0, 7, 7), (5, "Apache-2.0", 10, 17, 7),
                   (6, "Apache-2.0", 0, 7, 6)]
    assert license_scan.scan(none).count() == 0 and license_scan.scan(odd).count() == 0


def test_deciding_words_and_whole_texts(spark):
    whole = license_scan.whole_texts()
    notices = [("Released under the BSD License", "BSD"), ("Licensed under CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
               ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
               ("Released under the GNU Lesser General Public License, version 3.0", "LGPL-3.0"),
               ("Licensed under the GNU Affero General Public License v3", "AGPL-3.0"),
               ("before it " + whole["GPL-2.0-whole"] + " after it", "GPL-2.0-whole"),
               (whole["BSD-2-Clause-whole"], "BSD-2-Clause-whole"), (whole["LGPL-2.1-whole"], "LGPL-2.1-whole")]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(notices)] + [(99, "Released under the XYZ License")],
                                 "doc_id long, text string")
    got = license_scan.scan(docs).collect()
    assert {r.doc_id for r in got} == set(range(len(notices)))
    for k, (_, name) in enumerate(notices):
        assert max((r.n_matched, r.license) for r in got if r.doc_id == k)[1].startswith(name), (k, name)


def test_alignment_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        text = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 20))]
        template = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 10))]
        pairs = license_scan.align(text, template)
        assert all(text[a] == template[b] for a, b in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    words = list("abcdefg")
    assert len(license_scan.align(words, words)) == 7
