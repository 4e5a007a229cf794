"""Language identification by character language models with interpolated Kneser-Ney smoothing.

Words between boundary marks are the sentences of the models. Model tables are sorted arrays of 64-bit gram
hashes with one column per language. A text gets the language of the lowest cross-entropy per character; the
margin to the second is calibrated to a probability, and texts that no model explains are rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .quality import fit_scale_of

ORDER = 5
DISCOUNT = 0.75
MAX_PER_LANGUAGE = 1000    # expected documents per language that the models are fitted on, unless told otherwise
UNKNOWN = "und"
MIN_SCORE = 0.5            # below: rejected
START, END = 1, 2          # marks around a word; no letters
_LETTERS = re.compile(r"[^\W\d_]+")
SLACK = 1.5                # nats per character above the highest cross-entropy seen while calibrating


def letters(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return [w if w.isalpha() else "".join(c for c in w if c.isalpha()) or w[:0] for w in _LETTERS.findall((text or "").lower())]


def gram_hashes(words: list[str], order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of all characters of the marked words: owner (word), hash of the last 1 to ``order`` characters, number of characters before it."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    flat = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    before = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    hashes, current = [], np.zeros(len(flat), np.uint64)
    for m in range(1, order + 1):
        shifted = np.zeros(len(flat), np.uint64)
        shifted[m - 1:] = flat[:max(0, len(flat) - m + 1)]
        current = (current ^ (shifted + np.uint64(m << 40))) * np.uint64(0x9E3779B97F4A7C15)
        current = current ^ (current >> np.uint64(31))
        hashes.append(current.view(np.int64).copy())
    return owner, hashes, before


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)      # by order: sorted hashes
    logs: list[np.ndarray] = field(default_factory=list)       # by order: interpolated log probability per language
    contexts: list[np.ndarray] = field(default_factory=list)   # by length from 1: sorted hashes
    backoff: list[np.ndarray] = field(default_factory=list)    # by length: log weight of the shorter context
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0
    shift: float = 0.0
    highest: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word per language, and its number of predicted characters."""
        owner, hashes, before = gram_hashes(words)
        use = np.flatnonzero(before > 0)
        total = np.zeros((len(use), len(self.languages)), np.float32)
        open_ = np.ones(len(use), bool)
        for m in range(ORDER, 0, -1):
            rows = np.flatnonzero(open_ & (before[use] >= m - 1))
            at, hit = _find(self.grams[m - 1], hashes[m - 1][use[rows]])
            total[rows[hit]] += self.logs[m - 1][at[hit]]
            open_[rows[hit]] = False
            rest = rows[~hit]
            if m > 1:
                at, hit = _find(self.contexts[m - 2], hashes[m - 2][use[rest] - 1])
                total[rest[hit]] += self.backoff[m - 2][at[hit]]
        total[open_] += self.floor
        sizes = np.bincount(owner[use], minlength=len(words))
        sums = np.add.reduceat(total, np.concatenate(([0], np.cumsum(sizes)[:-1]))) if len(words) else total
        return sums, sizes


GRAMS = "size int, lang string, key long, shorter long, context long, begin long, total long"
WORDS_AT_ONCE = 100_000


def gram_rows(words: list[str], language: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """By order: one row per gram and language with the hashes of the gram without its first and its last character, and how
    often it begins a word and occurs at all."""
    owner, hashes, before = gram_hashes(words)
    language, weight = language[owner], weight[owner]
    for m in range(1, ORDER + 1):
        rows = np.flatnonzero((before >= m - 1) & (before > 0))
        rows = rows[np.lexsort((language[rows], hashes[m - 1][rows]))]
        key, lang = hashes[m - 1][rows], language[rows]
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (lang[1:] != lang[:-1]))))[:len(rows)]
        first = rows[starts]
        none = np.zeros(len(first), np.int64)
        shorter, context = (hashes[m - 2][first], hashes[m - 2][first - 1]) if m > 1 else (none, none)
        sums = [np.add.reduceat(w, starts) if len(rows) else none for w in (weight[rows] * (before[rows] == m - 1), weight[rows])]
        yield m, [lang[starts], key[starts], shorter, context, *sums]


def build(words: list[tuple[str, str, int]], languages: list[str]) -> Model:
    """``words``: (language, word, count), every word of a language once."""
    number = {name: i for i, name in enumerate(languages)}
    rows = gram_rows([w for _, w, _ in words], np.array([number[name] for name, _, _ in words], np.int32), np.array([n for _, _, n in words], np.int64))
    return assemble(languages, [table for _, table in rows])


def assemble(languages: list[str], grams: list[list[np.ndarray]]) -> Model:
    """The model of the rows of ``gram_rows`` by order, every gram and language once. Its size is that of the different grams."""
    model, width = Model(languages), len(languages)
    # per order: keys, counts per language, hashes of context and shorter gram. Below the highest order a gram counts the
    # different characters before it, unless it begins a word, where nothing can stand before it.
    tables = []
    for m, (language, key, shorter, context, begin, total) in enumerate(grams, 1):
        keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        counts = np.bincount(inverse * width + language, weights=total if m == ORDER else begin, minlength=len(keys) * width)
        if m < ORDER:
            counts = counts + np.bincount(np.searchsorted(keys, grams[m][2]) * width + grams[m][0], minlength=len(keys) * width)
        tables.append((keys, counts.reshape(len(keys), width), shorter[first], context[first]))
    alphabet = len(tables[0][0]) + 1
    previous = np.full((1, width), 1 / alphabet)
    for m in range(1, ORDER + 1):
        keys, counts, without_first, without_last = tables[m - 1]
        if m == 1:
            contexts, inside = np.zeros(1, np.int64), np.zeros(len(keys), np.int64)
            shorter = np.zeros(len(keys), np.int64)
        else:
            contexts, inside = np.unique(without_last, return_inverse=True)
            shorter, _ = _find(tables[m - 2][0], without_first)
        totals, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
        np.add.at(totals, inside, counts)
        np.add.at(kinds, inside, counts > 0)
        share = np.where(totals > 0, DISCOUNT * kinds / np.maximum(totals, 1), 1.0)
        chance = np.where(totals[inside] > 0, np.maximum(counts - DISCOUNT, 0) / np.maximum(totals[inside], 1), 0.0) + share[inside] * previous[shorter]
        model.grams.append(keys)
        model.logs.append(np.log(chance).astype(np.float32))
        if m == 1:
            model.floor = np.log(share[0] / alphabet).astype(np.float32)
        else:
            model.contexts.append(contexts)
            model.backoff.append(np.log(share).astype(np.float32))
        previous = chance
    return model


def entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy (nats per character) of every text per language, and the characters it was taken over."""
    numbers: dict[str, int] = {}
    bags = []
    for text in texts:
        bag = Counter(letters(text))
        bag.pop("", None)
        for word in bag:
            numbers.setdefault(word, len(numbers))
        bags.append(bag)
    sums, sizes = model.score_words(list(numbers)) if numbers else (np.zeros((0, len(model.languages))), np.zeros(0))
    out, chars = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for row, bag in enumerate(bags):
        if bag:
            used = np.fromiter(map(numbers.__getitem__, bag), np.int64, len(bag))
            many = np.fromiter(bag.values(), np.float64, len(bag))
            chars[row] = int((sizes[used] * many).sum())
            out[row] = -(sums[used] * many[:, None]).sum(0) / chars[row]
    return out, chars


def _margin(entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """How clearly the best language leads, in nats over the square root of the length."""
    if entropy.shape[1] < 2:
        return np.sqrt(chars)
    two = np.sort(entropy, axis=1)[:, :2]
    return (two[:, 1] - two[:, 0]) * np.sqrt(chars)


def count_grams(words: DataFrame) -> DataFrame:
    """``GRAMS`` of distinct words (lang, word, n), summed up before and after the shuffle."""
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(table: pa.Table):
            lang = table["lang"].combine_chunks().dictionary_encode()
            for m, (language, *columns) in gram_rows(table["word"].to_pylist(), lang.indices.to_numpy(), table["n"].to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(language), m, np.int32)), lang.dictionary.take(pa.array(language)),
                                                  *(pa.array(c, pa.int64()) for c in columns)], names=[part.split()[0] for part in GRAMS.split(", ")])

        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= WORDS_AT_ONCE:
                yield from summed(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from summed(pa.Table.from_batches(held))

    rows = words.select("lang", "word", "n").mapInArrow(grams, GRAMS)
    return rows.groupBy("size", "lang", "key").agg(F.min("shorter").alias("shorter"), F.min("context").alias("context"), F.sum("begin").alias("begin"), F.sum("total").alias("total"))


def train(docs: DataFrame, most: int | None = MAX_PER_LANGUAGE) -> Model:
    """Models of all non-null ``lang`` values, from rows whose crc32(doc_id) mod 5 is not 0.

    About ``most`` documents per language are used, chosen by a hash of doc_id, or all with None: those whose crc32 leads to
    remainder 1 calibrate, the others are counted. Null texts, languages and ids are left out. Words and grams are
    counted by Spark; the driver gets the different grams of at most ``ORDER`` letters.
    """
    spark = docs.sparkSession
    usable = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").withColumn("fold", fold_of("doc_id")).where("fold <> 0")
    chosen = usable.select("lang", "fold", "text")
    if most is not None:
        counts = usable.groupBy("lang").agg(F.count("*").alias("n")).withColumn("limit", (F.least(F.lit(1.0), most / F.col("n")) * (1 << 20)).cast("long"))
        few = counts.count() <= 10_000  # one row per language
        chosen = (usable.join(F.broadcast(counts) if few else counts, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("limit")).select("lang", "fold", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags: dict[str, Counter] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                bags.setdefault(language, Counter()).update(letters(text.as_py()))
            rows = [(language, w, n) for language, bag in bags.items() for w, n in bag.items() if w]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                              pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    bags = chosen.where("fold <> 1").select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    grams = count_grams(bags.groupBy("lang", "word").agg(F.sum("n").alias("n"))).toArrow().sort_by([("size", "ascending"), ("key", "ascending"), ("lang", "ascending")])
    languages = sorted(grams["lang"].unique().to_pylist())
    if not languages:
        return Model([])
    sizes, language = grams["size"].to_numpy(), pc.index_in(grams["lang"], pa.array(languages)).to_numpy()
    columns = [language, *(grams[c].to_numpy() for c in ("key", "shorter", "context", "begin", "total"))]
    ends = np.searchsorted(sizes, np.arange(1, ORDER + 2))
    model = assemble(languages, [[c[low:high] for c in columns] for low, high in zip(ends, ends[1:])])
    del grams, columns
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                some = batch.slice(low, 1024)
                entropy, chars = entropies(shared.value, some.column(1).to_pylist())
                best = entropy.argmin(1)
                right = [shared.value.languages[b] == name for b, name in zip(best, some.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(right, pa.bool_()), pa.array(best, pa.int64()), pa.array(entropy.min(1)), pa.array(_margin(entropy, chars)),
                                                  pa.array(chars, pa.int64())], names=["right", "best", "entropy", "margin", "chars"])

    seen = cut_lineage(chosen.where("fold = 1").select("lang", "text").mapInArrow(measure, "right boolean, best long, entropy double, margin double, chars long").where("chars > 0"))
    model.highest = np.full(len(languages), np.inf)
    fitted = fit_scale_of(seen, "margin", "right")
    if fitted:
        model.scale, model.shift = fitted
        for r in seen.where("right").groupBy("best").agg(F.max("entropy").alias("own")).collect():  # one row per language
            model.highest[r.best] = r.own + SLACK
    return model


def fold_of(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` (those of the same names, in either case, replaced) with lang_pred, score and rejected.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, as is everything when nothing
    could be learned. Only the text decides, so repeated rows agree; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # as large as the different grams of five letters make it
    added = ["lang_pred", "score", "rejected"]
    held = [c for c in docs.columns if c.lower() not in added]
    names = [f"c{i}" for i in range(len(held))]
    body = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(held, names)])
    text = held.index("text")
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(held, names)) + ", lang_pred string, score double, rejected boolean"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                some = batch.slice(low, 1024)
                n = some.num_rows
                names_, scores, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
                if fitted.languages:
                    entropy, chars = entropies(fitted, some.column(text).to_pylist())
                    best, there = entropy.argmin(1), chars > 0
                    names_ = [fitted.languages[b] if t else UNKNOWN for b, t in zip(best, there)]
                    chance = 1 / (1 + np.exp(-np.clip(fitted.scale * _margin(entropy, chars) + fitted.shift, -50, 50)))
                    scores = np.where(there, chance, 0.0)
                    rejected = ~there | (scores < MIN_SCORE) | (entropy.min(1) > fitted.highest[best])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(names_, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                                                 names=[*names, *added])

    return body.mapInArrow(predict, schema).toDF(*held, *added)
