"""License notices in texts by patience alignment.

Words that occur once in a stretch of text and once in the template anchor the
alignment; the longest increasing run of anchors stays, and the gaps between
anchors are aligned the same way.  Coverage is the share of template words so
matched.  Short notices and whole licence texts are aligned alike; the name and
version of a short notice must be among the matched words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.words import text_batches

COVERAGE = 0.8
#: Templates of so many words get a bound on what later starts can reach; it spares work and changes no result.
BOUNDED = 64
_WORD = re.compile(r"\w+(?:[.-]\w+)*")

#: Fixed: notices as they appear in files, by licence.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files, to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved",
}
#: The words of a short notice that must match besides the coverage: name and version.
DECIDING: dict[str, frozenset[str]] = {
    "MIT": frozenset(["mit"]), "Apache-2.0": frozenset(["apache", "2.0"]), "GPL-3.0": frozenset(["general", "3"]),
    "MPL-2.0": frozenset(["mozilla", "2.0"])}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _add(name: str, deciding: str, *notices: str) -> None:
    """Register every notice that is not a template yet; the first one under the plain name."""
    for notice in notices:
        known = [n for n, t in TEMPLATES.items() if t == notice]
        key = known[0] if known else name if name not in TEMPLATES else f"{name}-{len(TEMPLATES)}"
        TEMPLATES[key] = notice
        DECIDING[key] = frozenset(words_of(deciding))


for _full, _short, _versions in [("General", "GPL", "1 2 3"), ("Lesser General", "LGPL", "2.1 3"),
                                 ("Library General", "LGPL", "2"), ("Affero General", "AGPL", "3")]:
    for _v in _versions.split():
        for _w in [_v] if "." in _v else [_v, f"{_v}.0"]:
            _name = f"{_short}-{_v if '.' in _v else _v + '.0'}"
            for _tail in (f"version {_w}", f"v{_w}"):
                _add(_name, f"{_full} {_tail.split()[-1]}",
                     *(f"{_start} the GNU {_full} Public License, {_tail}" for _start in
                       ("This work is licensed under", "Licensed under", "Released under")))
            for _code in (f"{_short}-{_w}", f"{_short}v{_w}"):
                _add(_name, _code, *(f"{_start} the {_code}{_end}" for _start in ("Licensed under", "Released under")
                                     for _end in ("", " License")))
for _code, _words in [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                      ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                      ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]:
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _add(f"CC-{_code}-{_v}", f"{_code} {_v}", f"Licensed under CC {_code} {_v}")
        _add(f"CC-{_code}-{_v}", f"CC-{_code}-{_v}", f"Licensed under CC-{_code}-{_v}")
        _add(f"CC-{_code}-{_v}", f"{_words} {_v}",
             f"Licensed under a Creative Commons {_words} {_v} International License",
             f"Licensed under the Creative Commons {_words} {_v} License")
_add("CC0-1.0", "CC0 1.0", "Released under CC0 1.0")
_add("CC0-1.0", "CC0-1.0", "Licensed under CC0-1.0")
for _start in ("Released under", "Licensed under"):
    for _name, _code in [("MIT", "MIT"), ("BSD-notice", "BSD"), ("BSD-2-Clause", "BSD 2-Clause"), ("ISC-notice", "ISC"),
                         ("BSD-3-Clause", "BSD 3-Clause")]:
        _add(_name, _code, f"{_start} the {_code} License")
    _add("Apache-2.0", "Apache 2.0", f"{_start} the Apache License, Version 2.0", f"{_start} the Apache License 2.0")
    _add("MPL-2.0", "Mozilla 2.0", f"{_start} the Mozilla Public License, version 2.0")


def whole_texts() -> dict[str, str]:
    """Whole licence texts that come with the package, by name."""
    folder = Path(__file__).parent / "licenses"
    return {f"{path.stem}-whole": path.read_text("utf-8") for path in sorted(folder.glob("*.txt"))}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by their first number, whose second numbers increase."""
    tails: list[int] = []
    places: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        back.append(places[at - 1] if at else -1)
        if at == len(tails):
            tails.append(b)
            places.append(k)
        else:
            tails[at], places[at] = b, k
    out, k = [], places[-1] if places else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """Matched (text position, template position) pairs, both increasing."""
    found: list[tuple[int, int]] = []
    stack = [(0, len(text), 0, len(template))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        once = {w: k for k, w in enumerate(template[c:d], c) if there[w] == 1 and here[w] == 1}
        anchors = _increasing([(k, once[w]) for k, w in enumerate(text[a:b], a) if w in once])
        if not anchors:
            continue
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        stack += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:]) if q > p + 1 and s > r + 1]
    return sorted(found)


def common_length(text: Sequence[str], template: Sequence[str]) -> int:
    """Length of the longest common subsequence, all template positions at once in the bits of one number."""
    at: dict[str, int] = {}
    for k, word in enumerate(template):
        at[word] = at.get(word, 0) | 1 << k
    full = (1 << len(template)) - 1
    free = full
    for word in text:
        if word in at:
            met = free & at[word]
            free = ((free + met) | (free - met)) & full
    return len(template) - free.bit_count()


def scan_words(words: Sequence[str], template: Sequence[str], coverage: float,
               deciding: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    """(first word, end word, matched words) of every place where enough of the template aligns.

    Every template word is tried as a start: a stretch of twice the template's
    length is aligned from there, and counts if the first word, ``deciding``
    words and enough others are matched.  After a notice the search goes on
    behind it.  Starts are passed over only where no alignment can be long
    enough: where the stretch holds too few of the template's words, or where
    the longest common subsequence of an earlier stretch, plus the template
    words that came in since, stays below what is needed.
    """
    need = max(1, -(-int(1000 * coverage) * len(template) // 1000))
    wanted = Counter(template)
    hits = [k for k, w in enumerate(words) if w in wanted]
    out: list[tuple[int, int, int]] = []
    reach, last, done = 2 * len(template), 0, 0
    have: Counter[str] = Counter()
    enough = 0      # template words, with their number, that the stretch from `first` holds
    for first in hits:
        while last < len(hits) and hits[last] < first + reach:
            word = words[hits[last]]
            enough += have[word] < wanted[word]
            have[word] += 1
            last += 1
        if first >= done and enough >= need:
            stretch = words[first:first + reach]
            pairs = align(stretch, template)
            if len(pairs) >= need and pairs[0][0] == 0 and deciding <= {template[k] for _, k in pairs}:
                done = first + pairs[-1][0] + 1
                out.append((first, done, len(pairs)))
            elif len(pairs) < need and len(template) >= BOUNDED:
                missing = need - common_length(stretch, template)
                if missing > 0:     # so many template words must come in first
                    if last + missing > len(hits):
                        break
                    done = hits[last + missing - 1] - reach + 1
        word = words[first]
        have[word] -= 1
        enough -= have[word] < wanted[word]
    return out


def apart(found: list[tuple]) -> list[tuple]:
    """Of (..., first, end) in order of preference those that overlap none taken before."""
    taken: list[tuple[int, int]] = []
    out = []
    for item in found:
        first, end = item[-2:]
        k = bisect_left(taken, (end, -1))     # taken stretches are apart, so only the one before `end` can reach in
        if k == 0 or taken[k - 1][1] <= first:
            insort(taken, (first, end))
            out.append(item)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per notice found: doc_id, license, first_word, end_word, n_matched and coverage.

    Words are runs of letters and digits (joined by dots or hyphens), in lower
    case.  Of notices that overlap, the one with most matched words stays, then
    the higher coverage, then the name.  Null and empty texts have none; null
    ids and repeated rows pass through; an empty table gives an empty result.
    Texts of any length are scanned whole, a template at every word of it that
    occurs; other columns are dropped.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = {name: words_of(text) for name, text in (templates or TEMPLATES | whole_texts()).items()}
    deciding = {name: frozenset() if templates else DECIDING.get(name, frozenset()) for name in wanted}
    names = ["doc_id", "license", "first_word", "end_word", "n_matched", "coverage"]

    def run(batches):
        # a notice needs `coverage` of its words, so a text without enough of the distinct ones has none
        sets = {n: (set(t), len(set(t)) - int(len(t) * (1 - coverage) + 1e-9)) for n, t in wanted.items()}
        for batch, texts in text_batches(batches, "text", 4 << 20):
            at, rows = [], []
            for k, text in enumerate(texts):
                words = words_of(text) if text else []
                present = set(words)
                found = [(-m, -m / len(wanted[n]), n, a, b) for n, (some, least) in sets.items()
                         if len(words) >= coverage * len(wanted[n]) - 1
                         and deciding[n] <= present and len(some & present) >= least
                         for a, b, m in scan_words(words, wanted[n], coverage, deciding[n])]
                for m, share, name, a, b in apart(sorted(found)):
                    at.append(k)
                    rows.append((name, a, b, -m, -share))
            if rows:
                columns = zip(*rows)
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types))],
                    names=names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, license string, first_word long, end_word long, n_matched long, coverage double")
