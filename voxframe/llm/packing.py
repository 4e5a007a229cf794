"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so pieces of one length are interchangeable. The plan is
made from the number of pieces per length (at most ``capacity`` rows, whatever the corpus holds): a
segment tree over remaining capacities finds the tightest open bins for a length in logarithmic time,
and equal bins are kept as one range of bin numbers. Spark then gives every piece its place by its
number among the pieces of its length. The result is that of one best-fit-decreasing run over all pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .ranks import number_rows

CAPACITY = 2048
END_ID = 0
CACHED_WORDS = 250_000  # in each of two generations
ROWS_AT_ONCE = 1024


class TightestBins:
    """Open bins by remaining capacity; a segment tree tells the smallest capacity of at least ``need`` in use."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.size)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, remaining: int, first: int, count: int) -> None:
        if count and remaining:
            self.ranges.setdefault(remaining, []).append((first, count))
            node = remaining + self.size
            while node and not self.used[node]:
                self.used[node] = True
                node >>= 1

    def take(self, need: int) -> tuple[int, int, int] | None:
        """Remove and return (remaining, first bin, number of bins) of the tightest bins for ``need``."""
        node = need + self.size
        while not self.used[node]:
            while node & 1:          # a right child: everything to the right lies above its parent
                node >>= 1
            if node == 0:
                return None
            node += 1                # the sibling to the right
        while node < self.size:
            node = 2 * node if self.used[2 * node] else 2 * node + 1
        remaining = node - self.size
        held = self.ranges[remaining]
        first, count = held.pop()
        if not held:
            node_up = node
            self.used[node_up] = False
            while node_up > 1:
                node_up >>= 1
                self.used[node_up] = self.used[2 * node_up] or self.used[2 * node_up + 1]
        return remaining, first, count


@dataclass(frozen=True)
class Run:
    """Pieces ``from_rank`` up to ``to_rank`` of a length: ``per_bin`` in each bin from ``first_bin`` on, from ``base`` on."""

    length: int
    from_rank: int
    to_rank: int
    first_bin: int
    per_bin: int
    base: int


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Best-fit decreasing over ``counts`` (length -> pieces): the runs and the number of bins."""
    bins, runs, opened = TightestBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        rank, last = 0, counts[length]
        while rank < last:
            found = bins.take(length)
            if found is None:
                remaining, first = capacity, opened
                count = -(-(last - rank) // (capacity // length))
                opened += count
            else:
                remaining, first, count = found
            per_bin = remaining // length
            placed = min(last - rank, count * per_bin)
            runs.append(Run(length, rank, rank + placed, first, per_bin, capacity - remaining))
            full, rest = divmod(placed, per_bin)
            bins.add(remaining - per_bin * length, first, full)
            if rest:
                bins.add(remaining - rest * length, first + full, 1)
            untouched = full + bool(rest)
            bins.add(remaining, first + untouched, count - untouched)
            rank += placed
    return runs, opened


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself where it prints, else the next free one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in prints]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


class Chunks:
    """Ids of white-space separated chunks. Each is encoded once; the least recently seen are forgotten beyond a bound.

    White space ends every token of this vocabulary and composes with nothing, so the ids of a text are those of
    its chunks. A run of small letters before a run of ASCII punctuation is one token group of its own, and normalising
    leaves small Latin-1 letters as they are, so such a run goes to the merges directly. A text that holds a special
    string of the vocabulary is encoded as a whole, for such a string is found before white space counts.
    """

    MARK = "\x7f"      # stands between chunks that are encoded together
    PARTS = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,:;!?#*$%&|<>()]*)")

    def __init__(self, path: str, most: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.merge, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.most, self.known, self.older = most, {}, {}
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if self.MARK not in c]
        for at in range(0, len(plain), 1024):
            some = plain[at:at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)] if len(self.mark) == 1 else []
            if len(ends) != len(some):
                self.known.update((c, self._whole(c)) for c in some)
                continue
            data = ids.tobytes()
            self.known.update((chunk, data[low:4 * high]) for chunk, low, high in zip(some, [0, *[4 * e + 4 for e in ends[:-1]]], ends))
        self.known.update((c, self._whole(c)) for c in chunks if self.MARK in c)

    def _merged(self, word: str) -> bytes:
        """Ids of small Latin-1 letters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(word)])

    def _learn(self, chunks: list[str]) -> None:
        """Make every chunk known."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older, whole, split, parts = self.known, self.older, [], [], self.PARTS.fullmatch
        for chunk in chunks:
            if chunk in known:
                continue
            if chunk in older:
                known[chunk] = older[chunk]
            elif found := parts(chunk):
                word, signs = found.groups()
                if signs:
                    split.append((chunk, word, signs))
                else:
                    known[chunk] = self._merged(chunk)
            else:
                whole.append(chunk)
        self._encode([*whole, *{signs for _, _, signs in split}.difference(known, whole)])
        for chunk, word, signs in split:
            known[chunk] = (known.get(word) or self._merged(word)) + known[signs]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text, little-endian unsigned 32-bit; a null text has none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.special) if self.special else pa.array([False] * len(texts))
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(odd, "", texts)))
        named = words.flatten().dictionary_encode()
        chunks = named.dictionary.to_pylist()
        self._learn(chunks)
        coded = list(map(self.known.__getitem__, chunks))
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        starts = np.cumsum(lengths) - lengths
        table, place = np.frombuffer(b"".join(coded), "<u4"), named.indices.to_numpy()
        many = lengths[place]
        ends = np.concatenate(([0], np.cumsum(many)))
        flat = table[np.repeat(starts[place] - ends[:-1], many) + np.arange(ends[-1])]
        bounds = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        out = [flat[low:high] for low, high in zip(bounds, bounds[1:])]
        for row in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[row] = np.frombuffer(self._whole(texts[row].as_py()), "<u4")
        return out


_CHUNKS: dict[str, Chunks] = {}


def _encode_texts(path: str, texts: pa.Array) -> list[np.ndarray]:
    """``Chunks`` of a task's process, which remembers across tasks."""
    if path not in _CHUNKS:
        _CHUNKS[path] = Chunks(path)
    return _CHUNKS[path].encode(texts)


def piece_rows(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, part): every document's ids and the end id, cut every ``capacity`` ids."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(low, ROWS_AT_ONCE)
                source, numbers, starts, lengths, ids = [], [], [], [], []
                for row, coded in enumerate(_encode_texts(tokenizer, some.column(1))):
                    coded = np.concatenate((coded, end))
                    for number, at in enumerate(range(0, len(coded), capacity)):
                        piece = coded[at:at + capacity]
                        source.append(row)
                        numbers.append(number)
                        starts.append(at)
                        lengths.append(len(piece))
                        ids.append(piece.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(source, pa.int32())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` (1 to ``capacity``) and the portion ``part`` they were written in.

    Rows are told apart by their place only, so repeated rows are packed like others. No rows give no
    sequences. ``pieces`` has to be materialised.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = plan_bins(counts, capacity)
    names = ["length", "from_rank", "to_rank", "first_bin", "per_bin", "base"]
    # as an Arrow table: rows of Python objects would go through workers of another kind, which stay beside those of the queries
    plan = spark.createDataFrame(pa.table({name: pa.array([getattr(r, name) for r in runs], pa.int64()) for name in names}))
    order = [c for c in ("doc_id", "piece") if c in pieces.columns]
    numbered = number_rows(pieces, ["length"], "part", order)
    # the plan has a few runs for each length, however many pieces there are
    placed = numbered.join(F.broadcast(plan), ["length"]).where("rank >= from_rank AND rank < to_rank")
    nth = F.col("rank") - F.col("from_rank")
    return placed.select(*pieces.columns, (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
                         (F.col("base") + nth % F.col("per_bin") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. A null doc_id, repeated rows and ids are kept like others;
    further columns are ignored; an empty table gives no rows.
    """
    digest = F.call_function("crc32", "ids").alias("ids_crc32")
    pieces = piece_rows(docs, tokenizer, capacity).select("doc_id", "piece", "start", "length", digest, F.spark_partition_id().alias("part"))
    return pack(cut_lineage(pieces), capacity).drop("part")
