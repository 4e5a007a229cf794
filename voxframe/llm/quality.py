"""Quality rules: hashed word and character n-gram logistic regression on labelled rows.

The model is fitted on a bounded sample of labelled rows or, in shards, on all of them; its scores are turned into probabilities on rows
kept apart from the fit, and whole tables are scored in Arrow batches against fixed thresholds. Beside the
model stand plain counts of words, symbols, repeated lines and repeated word windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

BITS = 16                  # hash space of each of the four n-gram families
CHAR_SIZES = (3, 4)        # in bytes
MAX_LABELLED = 3000        # expected rows of the sample that the model is fitted on
HELD_APART = 3             # every third sampled row calibrates instead
EPOCHS = 6
SHARD = 2000               # rows that one task learns from where all labelled rows are used
MIN_PER_CLASS = 5          # with fewer labelled rows of a class there is no model, and it rejects nothing
REJECT_AT = 0.8            # calibrated probability of low quality
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
FAMILIES = len(CHAR_SIZES) + 2


class _Numbers(dict):
    """Words numbered as they come, with a hash of each."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word):
        self[word] = number = len(self)
        if number == len(self.hashes):
            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
        self.hashes[number] = zlib.crc32(word) | zlib.adler32(word) << 32
        return number


def _scatter(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (values >> np.uint64(64 - BITS)).astype(np.int64)


def hashed_ngrams(data: bytes, words: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of a text by family: characters (as bytes) by size, words, word pairs. ``words`` are word hashes."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = []
    for size in CHAR_SIZES:
        grams = np.zeros(max(0, len(codes) - size + 1), np.uint64)
        for k in range(size):
            grams = grams * np.uint64(257) + codes[k:k + len(grams)] + np.uint64(1)
        out.append(_scatter(grams * np.uint64(0x9E3779B97F4A7C15)))
    out.append(_scatter(words * np.uint64(0x9E3779B97F4A7C15)))
    out.append(_scatter((words[:-1] * np.uint64(0x94D049BB133111EB) + words[1:]) * np.uint64(0x9E3779B97F4A7C15)))
    return [family + (number << BITS) for number, family in enumerate(out)]


@dataclass(frozen=True)
class TextFacts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words


def repeated_words(numbers: np.ndarray) -> int:
    """Words in three-word windows that the text holds at least twice."""
    if len(numbers) < 4:
        return 0
    _, numbers = np.unique(numbers, return_inverse=True)
    pairs = numbers[:-1] * (int(numbers.max()) + 1) + numbers[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, window, uses = np.unique(pairs[:-1] * (int(numbers.max()) + 1) + numbers[2:], return_inverse=True, return_counts=True)
    again = uses[window] > 1
    covered = np.zeros(len(numbers), bool)
    for k in range(3):
        covered[k:len(numbers) - 2 + k] |= again
    return int(covered.sum())


def text_facts(text: str, data: bytes, words: list[bytes], numbers: np.ndarray) -> TextFacts:
    seen: set[bytes] = set()
    duplicates = 0
    for line in data.split(b"\n"):
        if line.strip():
            duplicates += line in seen
            seen.add(line)
    count = data.count
    return TextFacts(len(words), len(text) - sum(count(bytes([c])) for c in SPACES), sum(count(bytes([c])) for c in SYMBOLS), duplicates, repeated_words(numbers))


class Reader:
    """Facts and features of texts; a bounded number of words keep their numbers from text to text."""

    def __init__(self, most: int = 400_000):
        self.most, self.numbers = most, _Numbers()

    def read(self, text: str) -> tuple[TextFacts, list[np.ndarray]]:
        if len(self.numbers) > self.most:
            self.numbers = _Numbers()
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return text_facts(text, data, words, numbers), hashed_ngrams(data, self.numbers.hashes[numbers])


@dataclass(frozen=True)
class Model:
    """Weights of all families in one array, and the calibration p = 1 / (1 + exp(-(scale * margin + shift)))."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def margin(self, families: list[np.ndarray]) -> float:
        return self.bias + sum(float(self.weights[f].mean()) for f in families if len(f))

    def probability(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.scale * margin + self.shift, -50, 50))))


def fit_scale(margins: np.ndarray, low: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through (margin, label), with the labels drawn in a little for small samples."""
    n1, n0 = int(low.sum()), int((~low).sum())
    target = np.where(low, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = float(margins.std()) or 1.0
    x = margins / spread
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        slope, w = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(slope * x).sum() + 1e-3 * a, slope.sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0) / spread), float(b)


def fit_scale_of(rows: DataFrame, margin: str, label: str) -> tuple[float, float] | None:
    """``fit_scale`` by sums over stored rows, however many; None without rows."""
    first = rows.agg(F.count_if(label).alias("n1"), F.count_if(~F.col(label)).alias("n0"), F.stddev_pop(margin).alias("spread")).first()
    if not first.n1 + first.n0:
        return None
    spread = first.spread or 1.0
    x, target = F.col(margin) / spread, F.when(F.col(label), (first.n1 + 1) / (first.n1 + 2)).otherwise(1 / (first.n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.least(a * x + b, F.lit(50.0)), F.lit(-50.0))))
        w = F.greatest(p * (1 - p), F.lit(1e-9))
        sums = rows.select(x.alias("x"), (p - target).alias("s"), w.alias("w")).agg(*[F.sum(F.expr(e)) for e in ("s * x", "s", "w * x * x", "w * x", "w")]).first()
        step = np.linalg.solve(np.array([[sums[2] + 1e-3, sums[3]], [sums[3], sums[4] + 1e-6]]), np.array([sums[0] + 1e-3 * a, sums[1]]))
        a, b = float(a - np.clip(step[0], -2, 2)), float(b - np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return round(max(a, 0.0) / spread, 9), round(b, 9)  # the order of summation is left to chance


def learn(train: list[tuple[bool, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Weights and bias by adaptive gradient steps, row by row in the given order."""
    weights, squares = np.zeros(FAMILIES << BITS), np.full(FAMILIES << BITS, 1e-8)
    bias, bias_square = 0.0, 1e-8
    for epoch in range(EPOCHS):
        for low, index, value in train:
            index, value = index.astype(np.int64), value.astype(float)  # one row at a time; the rows are kept as they came
            p = 1 / (1 + np.exp(-np.clip(weights[index] @ value + bias, -50, 50)))
            slope = p - low
            step = slope * value
            squares[index] += step * step
            weights[index] -= 2.0 * step / np.sqrt(squares[index]) * (np.abs(slope) > 1e-4)
            bias_square += slope * slope
            bias -= 0.2 * slope / np.sqrt(bias_square)
    return weights, bias


def fit(rows: list[tuple[bool, np.ndarray, np.ndarray]]) -> Model | None:
    """``rows``: (low quality, feature numbers, values). Adaptive gradient steps, row by row in the given order."""
    train = [r for i, r in enumerate(rows) if i % HELD_APART]
    apart = [r for i, r in enumerate(rows) if i % HELD_APART == 0]
    if min(sum(r[0] for r in part) for part in (train, apart)) < MIN_PER_CLASS or min(sum(not r[0] for r in part) for part in (train, apart)) < MIN_PER_CLASS:
        return None
    weights, bias = learn(train)
    margins = np.array([weights[index] @ value.astype(float) + bias for _, index, value in apart])
    return Model(weights, bias, *fit_scale(margins, np.array([r[0] for r in apart])))


def text_features(reader: Reader, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a text and their shares of their family."""
    parts = [np.unique(f, return_counts=True) for f in reader.read(text)[1] if len(f)]
    return (np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)]).astype("<u4"),
            np.concatenate([p[1] / p[1].sum() for p in parts] or [np.zeros(0)]).astype("<f4"))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, low); a document with several labels counts as low when one of them says so."""
    return labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("low"))


def train_all(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on all labelled rows, null labels, ids and texts left out: a third calibrates, the others are split by a hash of doc_id
    to shards of about ``SHARD`` rows. Every shard is learnt from by a task of its own and the weights are averaged."""
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(labelled(labels), "doc_id").withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_APART)) == 0)
    sizes = {r.apart: r for r in rows.groupBy("apart").agg(F.count_if("low").alias("low"), F.count_if(~F.col("low")).alias("high")).collect()}
    if len(sizes) < 2 or min(n for r in sizes.values() for n in (r.low, r.high)) < MIN_PER_CLASS:
        return None
    shards = max(1, round((sizes[False].low + sizes[False].high) / SHARD))

    def shard_weights(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        reader, got = Reader(), []
        for low, text in zip(table["low"].to_pylist(), table["text"]):
            got.append((low, *text_features(reader, text.as_py())))
        weights, bias = learn([got[i] for i in np.random.default_rng(7).permutation(len(got))])
        parts = [*np.split(weights, FAMILIES), np.array([bias])]
        return pa.table({"shard": table["shard"].slice(0, 1).take(pa.array([0] * len(parts))), "part": pa.array(range(len(parts)), pa.int64()), "value": pa.array([p.astype("<f8").tobytes() for p in parts], pa.binary())})

    def average(table: pa.Table) -> pa.Table:
        total = 0.0
        for value in table.sort_by("shard")["value"]:
            total = total + np.frombuffer(value.as_buffer(), "<f8")
        return pa.table({"part": table["part"].slice(0, 1), "value": pa.array([(total / table.num_rows).tobytes()], pa.binary())})

    split = rows.where("NOT apart").select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "doc_id", "text", "low")
    parts = split.groupBy("shard").applyInArrow(shard_weights, "shard long, part long, value binary")
    means = parts.groupBy("part").applyInArrow(average, "part long, value binary").toArrow().sort_by("part")["value"]  # a fixed number of weights
    means = [np.frombuffer(v.as_buffer(), "<f8") for v in means]
    model = Model(np.concatenate(means[:-1]), float(means[-1][0]), 1.0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            found = [shared.value.margin(reader.read(text.as_py())[1]) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["low", "margin"])

    seen = cut_lineage(rows.where("apart").select("low", "text").mapInArrow(margins, "low boolean, margin double"))
    return replace(model, **dict(zip(("scale", "shift"), fit_scale_of(seen, "margin", "low"))))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model | None:
    """Fit on about ``most`` labelled rows (a bounded sample, chosen by a hash of doc_id). Null labels, ids and texts are left out;
    a document with several labels counts as low when one of them says so."""
    known = labelled(labels)
    share = min(1.0, most / max(1, known.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sample = known.where(place < int(share * (1 << 20)))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # about ``most`` ids

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            index, values = [], []
            for text in batch.column("text"):
                found, shares = text_features(reader, text.as_py())
                index.append(found.tobytes())
                values.append(shares.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("low"), pa.array(index, pa.binary()), pa.array(values, pa.binary())],
                                             names=["doc_id", "low", "index", "value"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, low boolean, index binary, value binary"
    got = rows.select("doc_id", "low", "text").mapInArrow(features, schema).toArrow().sort_by([("doc_id", "ascending"), ("index", "ascending")])
    table = [(bool(low), np.frombuffer(i.as_buffer(), "<u4"), np.frombuffer(v.as_buffer(), "<f4"))
             for low, i, v in zip(got["low"].to_pylist(), got["index"], got["value"])]
    order = np.random.default_rng(7).permutation(len(table))
    return fit([table[i] for i in order])


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def judge(docs: DataFrame, model: Model | None, reject_at: float = REJECT_AT) -> DataFrame:
    """All columns of ``docs`` (those of the same names, in either case, replaced) with the counts, base_failed, p_low and kept.

    A null text has no words, so it fails like an empty one. Without a model p_low is 0. Every row is judged
    by itself, so repeated rows agree; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_low", "kept"]
    held = [c for c in docs.columns if c.lower() not in added]
    names = [f"c{i}" for i in range(len(held))]
    body = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(held, names)])
    text = held.index("text")
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(held, names)) + f", {COUNTS}, base_failed boolean, p_low double, kept boolean"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, fitted = Reader(), shared.value
        for batch in batches:
            facts, chances = [], []
            for cell in batch.column(text):
                found, families = reader.read(cell.as_py() or "")
                facts.append(found)
                chances.append(fitted.probability(fitted.margin(families)) if fitted else 0.0)
            failed = [f.failed for f in facts]
            counts = [pa.array([getattr(f, n) for f in facts], pa.int64()) for n in added[:5]]
            kept = [not f and c < reject_at for f, c in zip(failed, chances)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts, pa.array(failed, pa.bool_()), pa.array(chances, pa.float64()), pa.array(kept, pa.bool_())],
                                             names=[*names, *added])

    return body.mapInArrow(score, schema).toDF(*held, *added)
