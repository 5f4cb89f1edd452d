"""Token ids of a word-end BPE tokenizer file (tokenizers library), with a cache per worker.

White space never joins two tokens in this kind of tokenizer, so the ids of a
text are those of its runs between spaces and newlines.  Runs of plain Latin
letters, digits and marks go through tiktoken's merge loop over the same
vocabulary; every other run goes to the tokenizers library whole.  A test holds
both against the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

CACHE_RUNS, LONGEST_RUN = 120_000, 64
_SUFFIX = "</w>"
#: Never in a printable run; stands for the word end.
_END = b"\0"
#: Fixed: how the byte-level alphabet writes the bytes that have no printable character of their own.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _alphabet() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}


#: Printable Latin: lower case and composition of these depend on no neighbour, and no library splits them otherwise.
_PLAIN = re.compile("[\n!-~\xa1-\xac\xae-\u012f\u0131-\u024f]*")


class WordBpe:
    """Ids of texts as little-endian unsigned 16-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        vocabulary = spec["model"]["vocab"]
        self.size = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        if self.size > 1 << 16 or spec["model"].get("end_of_word_suffix") != _SUFFIX:
            raise ValueError("a BPE vocabulary with word ends and at most 65,536 ids is needed")
        to_byte = _alphabet()
        ranks = {}
        self.ends = np.zeros(self.size, dtype=bool)
        for token, rank in vocabulary.items():
            end = token.endswith(_SUFFIX) and token != _SUFFIX
            body = token[:-len(_SUFFIX)] if end else token
            ranks[bytes(to_byte[c] for c in body) + (_END if end else b"")] = rank
            self.ends[rank] = end
        self.merge = tiktoken.Encoding("word ends", pat_str=r"[^\x00\n]+\x00", mergeable_ranks=ranks,
                                       special_tokens={}).encode_ordinary
        self.mark = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).sub
        self.special = {t["content"][:2] for t in spec["added_tokens"]}
        self.recent: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _plain(self, run: str) -> bool:
        return _PLAIN.fullmatch(run) is not None and not any(m in run for m in self.special)

    def _encode(self, runs: list[str]) -> list[bytes]:
        """Ids of each run; all plain runs in one call, every word end marked."""
        out: dict[str, bytes] = {}
        plain = runs if self._plain("\n".join(runs)) else [r for r in runs if self._plain(r)]
        marked = self.mark("\\g<0>\0", "\n".join(plain).lower())
        ids = np.asarray(self.merge(marked), dtype="<u2")
        last = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]) * 2
        pieces = np.cumsum([line.count("\0") for line in marked.split("\n")]) if plain else []
        raw, at = ids.tobytes(), 0
        for run, end in zip(plain, last[pieces].tolist() if plain else []):
            out[run] = raw[at:end]
            at = end
        for run in runs if len(out) < len(runs) else ():
            if run not in out:
                found = self.tokenizer.encode(run, add_special_tokens=False).ids
                out[run] = np.asarray(found, dtype="<u2").tobytes()
        return list(map(out.__getitem__, runs))

    def ids_of(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text.  The cache has two generations of ``CACHE_RUNS``, so frequent runs stay."""
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        recent, older = self.recent, self.older
        fresh = set().union(*split) - recent.keys()
        known = fresh & older.keys()
        recent.update(zip(known, map(older.__getitem__, known)))
        wanted = list(fresh - known)
        recent.update(zip(wanted, self._encode(wanted)))
        out = [b"".join(map(recent.__getitem__, runs)) for runs in split]
        for run in [r for r in wanted if len(r) > LONGEST_RUN]:
            del recent[run]
        if len(recent) >= CACHE_RUNS:
            self.recent, self.older = {"": b""}, recent
        return out


@lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
