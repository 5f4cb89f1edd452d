"""Token counts by a two-tier lookup of pre-token lengths, without shuffling pre-tokens.

The vocabulary has no piece with a space mark after another character, so a
text's pieces never cross the gap before a run of spaces and its count is the
sum over such units.  Lengths of the most frequent units are broadcast; others
are encoded once per worker and kept in a bounded cache.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.words import text_batches

#: Entries of the broadcast table, longest unit kept in a table, and entries a task counts or a worker caches.
FREQUENT, LONGEST_UNIT, TASK_UNITS, CACHE_UNITS = 16_384, 48, 8_192, 200_000
_MARK = "▁"
_UNITS = re.compile(" +[^ ]*")


@lru_cache(maxsize=1)
def _processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def units(text: str) -> list[str]:
    """Units of a text, each without the space before it; an empty unit is a lone space at the end."""
    text = text.replace(_MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [u[1:] for u in _UNITS.findall(" " + text)]
    return text.split(" ")


def _lengths(model: str, some: list[str]) -> list[int]:
    found = _processor(model).encode(some, num_threads=1)
    return [len(ids) if unit else 1 for unit, ids in zip(some, found)]


def frequent_units(docs: DataFrame, size: int = FREQUENT) -> list[str]:
    """About the ``size`` most frequent units: every task reports at most ``TASK_UNITS`` of its own counts.

    The choice affects speed only, never a count of tokens.
    """
    def run(batches):
        seen: Counter = Counter()
        for _, texts in text_batches(batches, "text", 4 << 20):
            for text in texts:
                if text:
                    seen.update(units(text))
            if len(seen) > 16 * TASK_UNITS:
                seen = Counter(dict(seen.most_common(4 * TASK_UNITS)))
        top = [(u, n) for u, n in seen.most_common(TASK_UNITS) if len(u) <= LONGEST_UNIT]
        yield pa.RecordBatch.from_pydict({"unit": pa.array([u for u, _ in top], pa.string()),
                                          "n": pa.array([n for _, n in top], pa.int64())})

    counts = docs.select("text").mapInArrow(run, "unit string, n long")
    top = counts.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(size)
    return [r.unit for r in top.collect()]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``) of every text.

    ``model`` is the path of a sentencepiece BPE model with an identity
    normaliser and a dummy prefix, present on every worker.  Null and empty
    texts have no bytes and no tokens; null ids and repeated rows pass through.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    top = frequent_units(docs, frequent)
    # at most `frequent` units of at most LONGEST_UNIT characters
    table = spark.sparkContext.broadcast(dict(zip(top, _lengths(model, top))) if top else {})

    def run(batches):
        known = dict(table.value)
        for batch, texts in text_batches(batches, "text", 2 << 20):
            split = [units(t) if t else [] for t in texts]
            fresh = list({u for us in split for u in us if u not in known})
            found = dict(zip(fresh, _lengths(model, fresh))) if fresh else {}
            known.update(found)
            tokens = [sum(map(known.__getitem__, us)) for us in split]
            if len(known) > CACHE_UNITS:
                known = dict(table.value)
            else:
                for unit in found:
                    if len(unit) > LONGEST_UNIT:
                        del known[unit]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
