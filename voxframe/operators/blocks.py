"""Work on blocks of a grid: voxels meet the requests of their block in one sorted pass.

Voxels go to the cube of ``SIDE``³ cells they lie in, and to the next ones where a neighbourhood reaches over the
border. A task meets one block after the other, its voxels before its requests; it holds the voxels of one block and one
batch of requests, however many of these there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SIDE = 32
PLACE = ["bi", "bj", "bk"]


def placed(voxels: DataFrame, index: Sequence[str], first: int, last: int, side: int = SIDE) -> DataFrame:
    """One row per block with a cell from ``index + first`` to ``index + last`` on every axis."""
    block = lambda c, shift: F.floor((F.col(c) + shift) / side).cast("long")
    for place, c in zip(PLACE, index):
        voxels = voxels.withColumn(place, block(c, first) if first == last else F.explode(F.sequence(block(c, first), block(c, last))))
    return voxels.dropna(subset=PLACE)


def on_blocks(voxels: DataFrame, requests: DataFrame, keys: Sequence[str], prepare: Callable, answer: Callable, schema: str,
              side: int = SIDE) -> DataFrame:
    """``answer(corner, state, requests)`` for every batch of requests of a block, where ``state = prepare(corner, voxels)``.

    Both tables have ``keys`` and the block; ``corner`` is the first cell of the block. ``voxels`` is an Arrow table and
    ``requests`` a batch; ``state`` is None for a block without voxels. ``answer`` yields batches of ``schema``.
    """
    group = [*keys, *PLACE]
    rows = (voxels.dropna(subset=list(keys)).withColumn("_request", F.lit(False))
            .unionByName(requests.withColumn("_request", F.lit(True)), allowMissingColumns=True))
    asked = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, state = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)) for c in [*group, "_request"]]
            turn = np.zeros(batch.num_rows - 1, dtype=bool)
            for c in columns:
                turn |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)), True).to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(turn) + 1).tolist(), batch.num_rows]
            for begin, end in zip(ends, ends[1:]):
                *block, request = [c[begin].as_py() for c in columns]
                if block != here:
                    here, held, state = block, [], None
                part = batch.slice(begin, end - begin)
                if not request:
                    held.append(part)
                    continue
                corner = tuple(side * b for b in block[len(keys):])
                if held:
                    state, held = prepare(corner, pa.Table.from_batches(held)), []
                yield from answer(corner, state, part.select(asked))

    return rows.repartition(*group).sortWithinPartitions(*group, "_request").mapInArrow(run, schema)


def slots(table: pa.Table, index: Sequence[str], corner: Sequence[int], reach: int, before: int = 0, side: int = SIDE) -> np.ndarray:
    """Row number of every cell of a block, -1 where it has none; ``before`` cells ahead of the block and ``reach`` in all beyond its side."""
    place = np.full((side + reach,) * 3, -1, dtype=np.int32)
    at = [table[c].to_numpy() - (first - before) for c, first in zip(index, corner)]
    place[at[0], at[1], at[2]] = np.arange(table.num_rows, dtype=np.int32)
    return place
