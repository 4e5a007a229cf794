"""Quality by compression: zstandard dictionaries of good and of bad text, and how much better a text fits one than the other.

Both dictionaries are built from pieces of labelled documents. A text is compressed piece by piece with each of
them, so that every part of a long text meets the dictionary and not only the text before it. The difference of the
compressed sizes per byte of text is turned into a probability on labelled documents kept apart from the dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .quality import fit_scale

PIECE_BYTES = 1024
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
MAX_PER_CLASS = 3000     # expected labelled documents of each class that the model is fitted on
MAX_PIECES = 8000        # expected pieces of each class that its dictionary is built from
APART = 3                # one of so many sampled documents calibrates instead
MIN_PER_CLASS = 5        # with fewer documents of a class on either side there is no model
GOOD_AT = 0.3
SMOOTHING = 32           # bytes added to the length, so that a few letters prove little
PLACES = 1 << 20


def fold_of(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 5


def pieces(data: bytes) -> list[bytes]:
    """The whole text in pieces of at most ``PIECE_BYTES``."""
    return [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of at most ``DICTIONARY_BYTES``; with too little text to choose from, the text itself."""
    whole = sum(map(len, samples))
    if len(samples) >= 16 and whole >= 1 << 14:
        size = max(1024, min(DICTIONARY_BYTES, whole // 4))
        return zstandard.train_dictionary(size, samples, k=200, d=8, threads=0, level=LEVEL).as_bytes()
    return b"".join(samples)[-DICTIONARY_BYTES:]


class Sizes:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for content in (good, bad):
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        """Bytes that the bad dictionary needs more than the good one, per byte of text; 0 for empty texts."""
        data = encoded(text)
        good, bad = (sum(len(c.compress(p)) for p in pieces(data)) for c in self.compressors)
        return (bad - good) / (len(data) + SMOOTHING)


@dataclass(frozen=True)
class Model:
    """Dictionaries and the calibration p(good) = 1 / (1 + exp(-(scale * difference + shift)))."""

    good: bytes
    bad: bytes
    scale: float
    shift: float

    def probability(self, difference: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.scale * difference + self.shift, -50, 50))))


def _differences(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """(is_good, difference) of labelled texts."""
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))  # twice DICTIONARY_BYTES

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*shared.value)
        for batch in batches:
            values = [sizes.difference(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("is_good"), pa.array(values, pa.float64())], names=["is_good", "difference"])

    return docs.select("is_good", "text").mapInArrow(measure, "is_good boolean, difference double")


def train(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS, max_pieces: int = MAX_PIECES) -> Model | None:
    """Fit on labelled documents outside fold 0 (crc32 of doc_id as text, modulo 5).

    A bounded sample: about ``per_class`` documents of each class, chosen by a hash of doc_id, and of those that build
    the dictionaries about ``max_pieces`` pieces. Null labels, ids and texts are left out; a document with several
    labels is good when all say so; repeated rows count as often as they stand. None when a class is too small.
    """
    known = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(fold_of(F.col("doc_id")) != 0)
             .groupBy("doc_id").agg((F.min("quality") == 1).alias("is_good")))
    sizes = {r["is_good"]: r["n"] for r in known.groupBy("is_good").agg(F.count("*").alias("n")).collect()}  # two rows
    if set(sizes) != {True, False}:
        return None
    share = {k: min(1.0, per_class / n) for k, n in sizes.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))
    limit = F.when(F.col("is_good"), int(share[True] * PLACES)).otherwise(int(share[False] * PLACES))
    sample = known.where(place < limit).withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(APART)) == 0)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # about 2 * per_class ids

    counts = {(r["is_good"], r["apart"]): (r["n"], r["pieces"]) for r in rows.groupBy("is_good", "apart").agg(
        F.count("*").alias("n"), F.sum(F.ceil(F.octet_length("text") / PIECE_BYTES)).alias("pieces")).collect()}  # four rows
    if any(counts.get((k, a), (0, 0))[0] < MIN_PER_CLASS for k in (True, False) for a in (True, False)):
        return None
    kept = {k: min(1.0, max_pieces / max(1, counts[k, False][1])) for k in (True, False)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, good, text in zip(*(batch.column(c) for c in ("doc_id", "is_good", "text"))):
                all_pieces, good = pieces(encoded(text.as_py())), good.as_py()
                rng = np.random.default_rng(abs(int(number.as_py())))
                chosen = [p for p, u in zip(all_pieces, rng.random(len(all_pieces))) if u < kept[good]]
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()] * len(chosen), pa.int64()), pa.array([good] * len(chosen), pa.bool_()),
                                                  pa.array(range(len(chosen)), pa.int32()), pa.array(chosen, pa.binary())], names=["doc_id", "is_good", "place", "piece"])

    build = rows.where("NOT apart").withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "is_good", "text")
    got = build.mapInArrow(cut, "doc_id long, is_good boolean, place int, piece binary").toArrow()  # about 2 * max_pieces * PIECE_BYTES
    got = got.sort_by([("doc_id", "ascending"), ("place", "ascending"), ("piece", "ascending")])
    held = {k: [p for p, g in zip(got["piece"].to_pylist(), got["is_good"].to_pylist()) if g == k] for k in (True, False)}
    if not all(held.values()):
        return None
    good, bad = build_dictionary(held[True]), build_dictionary(held[False])

    apart = _differences(rows.where("apart"), good, bad).toArrow().sort_by([("difference", "ascending"), ("is_good", "ascending")])  # numbers of the sample
    scale, shift = fit_scale(apart["difference"].to_numpy(), apart["is_good"].to_numpy(zero_copy_only=False))
    return Model(good, bad, scale, shift + float(np.log(share[False] / share[True])))  # from the sample's odds to those of all labels


def score(docs: DataFrame, model: Model | None, good_at: float = GOOD_AT) -> DataFrame:
    """(doc_id, score, predicted) of every row: the probability of good quality, and 1 where it reaches ``good_at``.

    A null or empty text has difference 0 and gets the score of that; without a model every score is 0.5. Each row is
    scored by itself, whole, so repeated rows and ties agree; texts of any length pass in pieces; further columns are
    ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # twice DICTIONARY_BYTES
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        sizes = Sizes(fitted.good, fitted.bad) if fitted else None
        for batch in batches:
            scores = [fitted.probability(sizes.difference(t.as_py())) if fitted else 0.5 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= good_at) for s in scores], pa.int32())],
                                             names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
