"""Work on whole grid lines: a voxel travels once per axis, as one row, however far its neighbourhood reaches.

Rows are partitioned by line and sorted along it, so a task meets one line after the other. Lines are taken in batches
of whole ones; what a task holds is a batch and, at most, one line of the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Columns = dict[str, np.ndarray]


def along_lines(df: DataFrame, axis: str, work: Callable[[Columns, np.ndarray], Columns], schema: str, also: Sequence[str] = ()) -> DataFrame:
    """``work(columns, line)`` for batches of whole lines along ``axis``.

    ``columns`` are those of ``df`` (with ``volume_id, i, j, k``, all numeric; a null double is NaN), ordered by line and
    position; ``line`` numbers the line of each row. It returns the columns of ``schema``; NaN becomes null. ``also`` names
    further key columns, for several images of a volume.
    """
    keys = ["volume_id", *also, *[c for c in "ijk" if c != axis]]
    names, results = df.columns, [part.split()[0] for part in schema.split(",")]

    def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        columns = {n: whole[n].to_numpy() for n in names}
        line = np.concatenate(([0], np.cumsum(np.any([np.diff(columns[k]) != 0 for k in keys], axis=0))))
        out = work(columns, line)
        return pa.RecordBatch.from_arrays([pa.array(out[n], from_pandas=True) for n in results], names=results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.array([batch.column(names.index(k)).to_numpy() for k in keys])
            turns = np.flatnonzero(np.any(np.diff(key, axis=1) != 0, axis=0)) + 1
            last = held and any(held[-1].column(names.index(k))[-1].as_py() != batch.column(names.index(k))[0].as_py() for k in keys)
            cut = int(turns[-1]) if len(turns) else 0       # the last line of the batch may go on in the next one
            if cut or last:
                yield finish([*held, batch.slice(0, cut)] if cut else held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield finish(held)

    return df.repartition(*keys).sortWithinPartitions(*keys, axis).mapInArrow(run, schema)


# --- distances -----------------------------------------------------------------------------------

def _ragged(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and value of the ranges ``first .. first + count - 1``, and where each range begins."""
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), count)
    return owner, first[owner] + np.arange(len(owner)) - begin[owner], begin


def lowest_parabolas(position: np.ndarray, height: np.ndarray, run: np.ndarray) -> np.ndarray:
    """``min over q of (p - q)² + height[q]`` for every row ``p``, over the rows ``q`` of its run; infinite heights don't count.

    The best ``q`` never moves back while ``p`` advances, so positions are settled from coarse to fine, each between
    the best ones of its settled neighbours: every level costs as many comparisons as there are rows.
    """
    out = np.full(len(position), np.inf)
    solid = np.isfinite(height)
    if not solid.any():
        return out
    at, low = position[solid], height[solid]
    sites = np.bincount(run[solid], minlength=run[-1] + 1)
    first = (np.cumsum(sites) - sites)[run]                      # sites of the row's run: first .. end - 1
    end = first + sites[run]
    start = np.flatnonzero(np.concatenate(([True], np.diff(run) != 0)))
    place = np.arange(len(run)) - start[run]                     # within the run
    left_in = np.bincount(run)[run] - place                      # rows from here to the end of the run
    best = np.zeros(len(run), np.int64)

    def settle(rows: np.ndarray, lowest: np.ndarray, highest: np.ndarray) -> None:
        owner, site, begin = _ragged(lowest, highest - lowest + 1)
        cost = (position[rows][owner] - at[site]) ** 2 + low[site]
        out[rows] = np.minimum.reduceat(cost, begin)
        hits = np.flatnonzero(cost == out[rows][owner])
        best[rows] = site[hits[np.unique(owner[hits], return_index=True)[1]]]

    usable = end > first
    rows = np.flatnonzero(usable & (place == 0))
    settle(rows, first[rows], end[rows] - 1)
    step = 1 << max(0, int(place.max()).bit_length() - 1)
    while step:
        rows = np.flatnonzero(usable & (place % (2 * step) == step))
        if len(rows):
            right = np.where(left_in[rows] > step, best[np.minimum(rows + step, len(run) - 1)], end[rows] - 1)
            settle(rows, best[rows - step], right)
        step >>= 1
    return out


def distance_pass(axis: str) -> Callable[[Columns, np.ndarray], Columns]:
    """One axis of the squared distance to the nearest voxel of another label or none inside the grid (``n`` voxels along the axis)."""

    def work(c: Columns, line: np.ndarray) -> Columns:
        p = c[axis].astype(float)
        opens = np.concatenate(([True], (np.diff(line) != 0) | (np.diff(p) != 1) | (np.diff(c["label"]) != 0)))
        run = np.cumsum(opens) - 1
        start, stop = np.flatnonzero(opens), np.append(np.flatnonzero(opens)[1:], len(p)) - 1
        before = np.where(p[start] > 0, p[start] - 1, -np.inf)[run]
        behind = np.where(p[stop] < c["n"][stop] - 1, p[stop] + 1, np.inf)[run]
        steps = np.minimum(p - before, behind - p)
        known = np.where(np.isnan(c["d2"]), np.inf, c["d2"])
        d2 = np.minimum(steps * steps, lowest_parabolas(p, known, run))
        return {**{k: c[k] for k in ("volume_id", "i", "j", "k", "label")}, "d2": np.where(np.isinf(d2), np.nan, d2)}

    return work


# --- convolution ---------------------------------------------------------------------------------

class Stretches:
    """The rows of a batch of lines laid out on a dense strip, with mirrored borders and ``radius`` free cells around each stretch."""

    def __init__(self, position: np.ndarray, line: np.ndarray, n: np.ndarray, radius: int):
        images = [(line, position, np.arange(len(position)))]
        for m in range(-(-(-radius // (2 * int(n.min())))) - 1, radius // (2 * int(n.min())) + 2):
            for x in (2 * m * n + position, 2 * m * n - 1 - position):
                near = np.flatnonzero((x >= -radius) & (x < n + radius) & ((x < 0) | (x >= n)))
                images.append((line[near], x[near], near))
        line, x, source = (np.concatenate(part) for part in zip(*images))
        order = np.lexsort((x, line))
        line, x, self.source = line[order], x[order], source[order]
        opens = np.concatenate(([True], (np.diff(line) != 0) | (np.diff(x) > 2 * radius + 1)))
        start = np.flatnonzero(opens)
        stretch = np.cumsum(opens) - 1
        width = x[np.append(start[1:], len(x)) - 1] - x[start] + 1 + 2 * radius
        offset = np.cumsum(width) - width
        self.cell = offset[stretch] + radius + x - x[start][stretch]
        self.size = int(width.sum())
        owner = np.repeat(np.arange(len(start)), width)
        self.x = x[start][owner] - radius + np.arange(self.size) - offset[owner]
        self.row = self.source[start][owner]                     # some row of the same line
        reached = np.convolve(self.lay(None), np.ones(2 * radius + 1), "same") > 0.5
        self.kept = np.flatnonzero(reached & (self.x >= 0) & (self.x < n[self.row]))

    def lay(self, values: np.ndarray | None) -> np.ndarray:
        return np.bincount(self.cell, None if values is None else values[self.source], self.size).astype(float)

    def convolve(self, values: np.ndarray, weights: Sequence[float]) -> np.ndarray:
        """At the kept cells."""
        return np.convolve(self.lay(np.nan_to_num(values)), np.asarray(weights), "same")[self.kept]

    def highest_beside(self, values: np.ndarray) -> np.ndarray:
        """The greatest of each kept cell and its two neighbours, where those are kept; ``values`` are at the kept cells."""
        strip = np.full(self.size + 2, -np.inf)
        strip[self.kept + 1] = values
        return np.maximum(np.maximum(strip[:-2], strip[2:]), strip[1:-1])[self.kept]

    def columns(self, c: Columns, axis: str) -> Columns:
        rows = self.row[self.kept]
        return {k: self.x[self.kept] if k == axis else c[k][rows] for k in ("volume_id", "i", "j", "k")}


def convolution(axis: str, weights: Sequence[float]) -> Callable[[Columns, np.ndarray], Columns]:
    """A symmetric kernel along one axis of ``value``; rows appear where a present voxel is within reach."""

    def work(c: Columns, line: np.ndarray) -> Columns:
        strip = Stretches(c[axis], line, c["n"], len(weights) // 2)
        return {**strip.columns(c, axis), "value": strip.convolve(c["value"], weights)}

    return work


def varied_convolution(axis: str, kernel: Callable[[float], Sequence[float]], also: Sequence[str]) -> Callable[[Columns, np.ndarray], Columns]:
    """The same with the kernel of each line's ``sigma``."""

    def work(c: Columns, line: np.ndarray) -> Columns:
        parts = []
        for sigma in np.unique(c["sigma"]):
            rows = np.flatnonzero(c["sigma"] == sigma)
            here, weights = {k: v[rows] for k, v in c.items()}, kernel(float(sigma))
            strip = Stretches(here[axis], line[rows], here["n"], len(weights) // 2)
            kept = strip.row[strip.kept]
            parts.append({**strip.columns(here, axis), **{k: here[k][kept] for k in (*also, "sigma")}, "value": strip.convolve(here["value"], weights)})
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    return work


# --- Laplacian of Gaussian over many scales ------------------------------------------------------

def scale_names(name: str, count: int) -> list[str]:
    return [f"{name}{n}" for n in range(count)]


def log_first(flat: Sequence[Sequence[float]], curved: Sequence[Sequence[float]]) -> Callable[[Columns, np.ndarray], Columns]:
    """Along ``i``: ``value`` under the flat and the curved kernel of every scale."""

    def work(c: Columns, line: np.ndarray) -> Columns:
        strip = Stretches(c["i"], line, c["n"], max(map(len, flat)) // 2)
        out = strip.columns(c, "i")
        for n in range(len(flat)):
            out[f"flat{n}"], out[f"curved{n}"] = (strip.convolve(c["value"], kernels[n]) for kernels in (flat, curved))
        return out

    return work


def log_second(flat: Sequence[Sequence[float]], curved: Sequence[Sequence[float]], strength: Sequence[float]) -> Callable[[Columns, np.ndarray], Columns]:
    """Along ``j``: the response ``v`` of every scale, and the highest ``m`` of the three positions times three scales around it."""

    def work(c: Columns, line: np.ndarray) -> Columns:
        strip = Stretches(c["j"], line, c["n"], max(map(len, flat)) // 2)
        out = strip.columns(c, "j")
        responses = [s * (strip.convolve(c[f"flat{n}"], curved[n]) + strip.convolve(c[f"curved{n}"], flat[n])) for n, s in enumerate(strength)]
        beside = [strip.highest_beside(v) for v in responses]
        for n, v in enumerate(responses):
            out[f"v{n}"], out[f"m{n}"] = v, np.max(beside[max(0, n - 1):n + 2], axis=0)
        return out

    return work


def log_peaks(count: int, threshold: float) -> Callable[[Columns, np.ndarray], Columns]:
    """Along ``i``: (volume_id, i, j, k = scale, value) of the responses above the threshold that nothing around exceeds."""

    def work(c: Columns, line: np.ndarray) -> Columns:
        joined = np.concatenate(([False], (np.diff(line) == 0) & (np.diff(c["i"]) == 1)))
        found = []
        for n in range(count):
            v, m = c[f"v{n}"], c[f"m{n}"]
            before = np.where(joined, np.concatenate(([-np.inf], m[:-1])), -np.inf)
            behind = np.where(np.append(joined[1:], False), np.append(m[1:], -np.inf), -np.inf)
            rows = np.flatnonzero((v > threshold) & (v >= np.maximum(np.maximum(before, behind), m)))
            found.append((rows, np.full(len(rows), n), v[rows]))
        rows, scale, value = (np.concatenate(part) for part in zip(*found))
        return {"volume_id": c["volume_id"][rows], "i": c["i"][rows], "j": c["j"][rows], "k": scale, "value": value}

    return work
