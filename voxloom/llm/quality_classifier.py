"""Quality by compression: a text is cheaper to store with the dictionary of its own kind.

One zstandard dictionary is built from good labelled texts and one from bad
ones.  Texts are compressed in blocks, so that a dictionary counts throughout
a long text; the normalised difference of the sizes, and the sizes against
the plain length, become a probability by logistic calibration.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.words import encode_text, text_batches

#: Bounds of the fit: labelled texts of each class, and bytes of a text that may serve as a sample.
SAMPLE_TEXTS, SAMPLE_BYTES = 3_000, 20_000
DICTIONARY_BYTES, BLOCK, LEVEL = 96 << 10, 1024, 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=4)
def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    words = zstandard.ZstdCompressionDict(data, dict_type=kind)
    words.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=parameters)


def _sizes(text: str | None, good: bytes, bad: bytes) -> tuple[int, int, int]:
    """(bytes, bytes with the good dictionary, bytes with the bad one) of a whole text, block by block."""
    raw = encode_text(text)
    blocks = [raw[k:k + BLOCK] for k in range(0, len(raw), BLOCK)]
    first, second = _compressor(good).compress, _compressor(bad).compress
    return len(raw), sum(len(first(b)) for b in blocks), sum(len(second(b)) for b in blocks)


def _features(sizes: np.ndarray) -> np.ndarray:
    raw, good, bad = np.maximum(sizes.T.astype(float), 1)
    difference = (bad - good) / np.maximum(bad, good)
    ratio = good / raw
    return np.stack([difference, difference ** 2, ratio, ratio ** 2, difference * ratio, np.log(raw)], axis=1)


def _standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features in standard deviations; very short texts are not extrapolated beyond four."""
    return np.clip((x - centre) / scale, -4, 4)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - 1e-2 * beta
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _dictionary(texts: list[bytes]) -> bytes:
    samples = [t[k:k + BLOCK] for t in texts for k in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the texts themselves serve
        return b"".join(samples)[-DICTIONARY_BYTES:] or b" "


def fit(docs: DataFrame, labels: DataFrame, sample_texts: int = SAMPLE_TEXTS,
        sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Dictionaries from one half of a bounded labelled sample, calibration from the other.

    The sample holds at most ``sample_texts`` rows of each class, the first by a
    hash of the id, without held-out rows and without texts over
    ``sample_bytes``; classes are weighted by their true counts.  Without labels
    of both classes the model answers the share of label 1 (or 0.5).
    """
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .select("doc_id", "quality").distinct())
    totals = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    mixed = F.xxhash64("doc_id")
    picked = [known.where(F.col("quality") == q).orderBy(mixed, "doc_id").limit(sample_texts) for q in (0, 1)]
    # at most 2 * sample_texts ids
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    # one text for each id, the smallest: repeated rows of an id do not add to what reaches the driver
    rows = (docs.where(F.octet_length("text").between(1, sample_bytes)).select("doc_id", "text")
            .join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect())
    rows.sort(key=lambda r: (r.quality, r.doc_id, r.text))
    halves: dict[tuple[int, int], list[str]] = {(q, h): [] for q in (0, 1) for h in (0, 1)}
    for k, r in enumerate(rows):
        halves[r.quality, k % 2].append(r.text)
    width = _features(np.ones((1, 3))).shape[1]
    if not all(halves.values()):
        odds = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return Model(b" ", b" ", (*[0.0] * width, float(odds)), (0.0,) * width, (1.0,) * width)
    good, bad = (_dictionary([encode_text(t) for t in halves[q, 0]]) for q in (1, 0))
    texts = [(q, t) for q in (0, 1) for t in halves[q, 1]]
    x = _features(np.array([_sizes(t, good, bad) for _, t in texts]))
    y = np.array([q for q, _ in texts], dtype=float)
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    beta = _logistic(_standard(x, centre, scale), y, weight)
    return Model(good, bad, tuple(beta), tuple(centre), tuple(scale))


def _scores(texts: list[str | None], model: Model) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    x = _features(np.array([_sizes(t, model.good, model.bad) for t in texts]))
    x = _standard(x, np.array(model.centre), np.array(model.scale))
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights[:-1]) + model.weights[-1], -30, 30)))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on) of every whole text.

    Null texts count as empty; an empty text gets the calibrated score of no
    bytes.  Null ids (never held out) and repeated rows pass through.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # two dictionaries of at most DICTIONARY_BYTES
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in text_batches(batches, "text", 4 << 20):
            values = _scores(texts, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values)],
                                             names=["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in text_batches(batches, "text", 4 << 20):
            yield batch.filter(pa.array(_scores(texts, shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
