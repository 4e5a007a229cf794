"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens in blocks of bounded size: the positions of a block, and its distinct words in
messages by bucket of their hash. All messages of a bucket meet in one place, where every distinct word of the
corpus is encoded once; the answers return to their blocks, whose texts are put together again by position.
Decoding joins ids with the token-byte table.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

BLOCK_CHARS = 16 << 20
SHORT, MIDDLE = 1 << 7, 1 << 14  # numbers below take one byte, and two
STEP = 1 << 20  # numbers or bytes that are turned at once
BUCKETS = 512  # words with one remainder of their hash travel together
#: White space as the Unicode property; Python's own class also has the separators U+001C to U+001F.
SPACE = r"\p{White_Space}"


def pretoken_pattern(pattern: str) -> str:
    """``pattern`` with its white space classes written as the Unicode property."""
    return pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\S", f"[^{SPACE}]").replace(r"\s", SPACE)


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes (7 bits each, low first) of numbers below 2^35, and the length of each."""
    values = values.astype(np.uint64)
    lengths = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        lengths += values >= (1 << bits)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    for k in range(5):
        some = lengths > k
        more = (lengths[some] > k + 1).astype(np.uint8) << 7
        out[starts[some] + k] = ((values[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, lengths


def unpack_numbers(data: np.ndarray, dtype=np.int64, step: int = STEP) -> np.ndarray:
    """The numbers of ``pack_numbers``; besides the result only about ``step`` bytes are held in wide form."""
    out, filled, at = np.empty(np.count_nonzero(data < 128), dtype), 0, 0
    while at < len(data):
        some = data[at:at + step]
        ends = np.flatnonzero(some < 128)
        if not len(ends):
            raise ValueError("a number does not end")
        some = some[:ends[-1] + 1]                     # the rest belongs to a number that ends later
        starts = np.concatenate(([0], ends[:-1] + 1))
        lengths = ends - starts + 1
        values = np.zeros(len(ends), np.int64)
        for k in range(int(lengths.max())):
            long = lengths > k
            values[long] |= (some[starts[long] + k].astype(np.int64) & 127) << (7 * k)
        out[filled:filled + len(values)] = values
        filled, at = filled + len(values), at + len(some)
    return out


def pack_strings(items: list[bytes]) -> bytes:
    lengths, _ = pack_numbers(np.fromiter(map(len, items), np.int64, len(items)))
    return np.array([len(items)], "<u4").tobytes() + lengths.tobytes() + b"".join(items)


def unpack_strings(data: bytes) -> list[bytes]:
    count = int(np.frombuffer(data, "<u4", 1)[0])
    flat = np.frombuffer(data, np.uint8, offset=4)
    head = int(np.flatnonzero(flat < 128)[count - 1]) + 1 if count else 0
    ends = np.cumsum(unpack_numbers(flat[:head])).tolist()
    body = data[4 + head:]
    return [body[low:high] for low, high in zip([0, *ends[:-1]], ends)]


def word_numbers(width: np.ndarray) -> np.ndarray:
    """Numbers of a block's words in bucket order: first those of width class 0, then 1, then 2."""
    number = np.empty(len(width), np.int64)
    number[np.argsort(width, kind="stable")] = np.arange(len(width))
    return number


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class _Block:
    """Distinct words of consecutive rows and the word at each position."""

    def __init__(self, find):
        self.find, self.words, self.places, self.counts, self.ids, self.size = find, {}, [], [], [], 0

    def add(self, doc_id, text: str) -> None:
        words, found = self.words, self.find(text)
        for word in found:
            if word not in words:
                words[word] = len(words)
        self.places.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
        self.counts.append(len(found))
        self.ids.append(doc_id)
        self.size += len(text)

    def rows(self, block: int) -> pa.RecordBatch:
        """The documents with their positions (bucket -1), and the words of every bucket."""
        place = np.concatenate(self.places)
        uses = np.bincount(place, minlength=len(self.words))
        words = [w.encode("utf-8", "surrogatepass") for w in self.words]
        bucket = np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words))
        width = np.full(len(words), 2, np.uint8)       # frequent words get the short numbers
        common = np.argsort(-uses, kind="stable")
        width[common[:SHORT]], width[common[SHORT:MIDDLE]] = 0, 1
        order = np.argsort(bucket, kind="stable")      # words by bucket, in which the ids will come back
        number = np.empty(len(words), np.int64)
        number[order] = word_numbers(width[order])
        positions = (pack_numbers(number[place[low:low + STEP]])[0].tobytes() for low in range(0, len(place), STEP))
        head = [np.array([len(words)], "<u8").tobytes(), width[order].tobytes(), *positions]
        present, starts = np.unique(bucket[order], return_index=True)
        stops = [*starts[1:].tolist(), len(order)]
        blobs = [squeeze(pack_strings([words[i] for i in order[low:high]])) for low, high in zip(starts.tolist(), stops)]
        n = len(blobs) + 1
        empty = [None] * len(blobs)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.array([-1, *present.tolist()], pa.int32()), pa.array([squeeze(b"".join(head), 6), *blobs], pa.binary()),
             pa.array([self.ids, *empty], pa.list_(pa.int64())), pa.array([self.counts, *empty], pa.list_(pa.int64()))],
            names=["block", "bucket", "data", "doc_ids", "counts"])


MESSAGE = "block long, bucket int, data binary, doc_ids array<long>, counts array<long>"


def explode_words(docs: DataFrame, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per block one row with its documents and positions, and one row per bucket with its distinct words."""
    pattern = pretoken_pattern(pattern)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, number, base = regex.compile(pattern).findall, 0, TaskContext.get().partitionId() << 24
        block = _Block(find)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc_id, text.as_py() or "")
                if block.size >= block_chars:
                    yield block.rows(base + number)
                    block, number = _Block(find), number + 1
        if block.ids:
            yield block.rows(base + number)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, MESSAGE)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})
    return _ENCODERS[path]


_PACKED: dict[str, dict[int, bytes]] = {}


def _packed_ids(path: str) -> dict[int, bytes]:
    """The variable-length bytes of every id of the vocabulary."""
    if path not in _PACKED:
        ids = sorted(read_ranks(path).values())
        data, lengths = pack_numbers(np.array(ids, np.int64))
        ends, flat = np.cumsum(lengths).tolist(), data.tobytes()
        _PACKED[path] = {i: flat[low:high] for i, low, high in zip(ids, [0, *ends], ends)}
    return _PACKED[path]


class TokenBytes:
    """The token-byte table, sorted by id; its size is fixed by the ranks file."""

    def __init__(self, path: str):
        table = read_ranks(path)
        tokens = sorted(table, key=table.__getitem__)
        self.numbers = np.array([table[t] for t in tokens], np.int64)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.blob, self.starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.lengths) - self.lengths

    def join(self, ids: bytes | None, step: int = STEP) -> bytes | None:
        """The bytes of the tokens of ``ids`` in their order; an id without a token is an error."""
        if ids is None:
            return None
        every, parts = np.frombuffer(ids, "<u4"), []
        for at in range(0, len(every), step):
            wanted = every[at:at + step]
            row = np.minimum(np.searchsorted(self.numbers, wanted), len(self.numbers) - 1)
            if (self.numbers[row] != wanted).any():
                raise ValueError("an id is not in the token table")
            many = self.lengths[row]
            parts.append(self.blob[np.repeat(self.starts[row] - (np.cumsum(many) - many), many) + np.arange(many.sum())].tobytes())
        return b"".join(parts)


_TOKENS: dict[str, TokenBytes] = {}


def _token_bytes(path: str) -> TokenBytes:
    if path not in _TOKENS:
        _TOKENS[path] = TokenBytes(path)
    return _TOKENS[path]


def encode(docs: DataFrame, ranks: str, pattern: str, block_chars: int = BLOCK_CHARS, decoded: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every row; a null text is empty.

    ``decoded`` names a further column with the bytes of the ids, joined where they are put together, as ``decode``
    would add it in another Python process.

    ``docs`` has an integer doc_id (may be null or repeated) and text; other columns are ignored. One row
    comes out for each row, in any order; empty tables give none.
    """

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, bucket, known = _encoder(ranks)._encode_single_piece, None, {}
        packed = _packed_ids(ranks)
        for batch in batches:
            coded = []
            for number, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if number < 0:
                    coded.append(data)
                    continue
                if number != bucket:                   # the rows of a bucket stand together
                    bucket, known = number, {}
                ids = []
                for word in unpack_strings(expand(data)):
                    found = known.get(word)
                    if found is None:
                        found = known[word] = b"".join([packed[i] for i in single(word)])
                    ids.append(found)
                coded.append(squeeze(pack_strings(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(coded, pa.binary()), batch.column(3), batch.column(4)], names=batch.schema.names)

    # documents travel by block, words by bucket: equal words of all blocks meet in one bucket
    key = F.when(F.col("bucket") < 0, F.xxhash64("block")).otherwise(F.xxhash64(F.col("bucket").cast("string")))
    messages = explode_words(docs, pattern, block_chars).repartition(key).sortWithinPartitions("bucket")
    answers = messages.mapInArrow(encode_words, MESSAGE)

    def assemble(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(rows).sort_by("bucket")
        data = held.column("data")
        told = expand(data[0].as_py())
        size = int(np.frombuffer(told, "<u8", 1)[0])
        order = word_numbers(np.frombuffer(told, np.uint8, size, 8))
        place = unpack_numbers(np.frombuffer(told, np.uint8, offset=8 + size), np.int32)
        doc_ids, counts = held.column("doc_ids")[0].values, np.asarray(held.column("counts")[0].values, np.int64)
        coded = [ids for one in data[1:] for ids in unpack_strings(expand(one.as_py()))]
        del told, data, held
        flat = np.frombuffer(b"".join(coded), np.uint8)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        del coded
        lengths, from_ = np.empty(len(sizes), np.int32), np.empty(len(sizes), np.int32)
        if len(sizes):
            many = np.add.reduceat(flat < 128, np.cumsum(sizes) - sizes, dtype=np.int64)
            lengths[order], from_[order] = many, np.cumsum(many) - many
        table = unpack_numbers(flat, "<u4")

        def ids_of(low: int, high: int) -> bytes:
            parts = []
            for at in range(low, high, STEP):
                used = place[at:min(at + STEP, high)]
                many = lengths[used].astype(np.int64)
                parts.append(table[np.repeat(from_[used] - (np.cumsum(many) - many), many) + np.arange(many.sum())].tobytes())
            return b"".join(parts)

        # documents leave in batches of a bounded number of words
        bounds = np.concatenate(([0], np.cumsum(counts)))
        row = 0
        while row < len(counts):
            last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + STEP // 4, "right")) - 1)
            ids = [ids_of(int(low), int(high)) for low, high in zip(bounds[row:last], bounds[row + 1:last + 1])]
            columns = [doc_ids.slice(row, last - row), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(map(_token_bytes(ranks).join, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)
            row = last

    names = ["doc_id", "n_tokens", "ids", *([decoded] if decoded else [])]
    return answers.groupBy("block").applyInArrow(assemble, ", ".join(f"`{n}` {t}" for n, t in zip(names, ("long", "long", "binary", "binary"))))


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the bytes of every row's ids: a join with the token-byte table, done as array look-ups in Arrow batches.

    The table has one row per token of the vocabulary, so its size is fixed by the ranks file. Null ids stay null.
    """

    @F.pandas_udf(T.BinaryType())
    def token_bytes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(_token_bytes(ranks).join)

    return encoded.withColumn(into, token_bytes(ids))


def bpe_digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
