"""Starting centres of k-means|| for many (k, seed) in shared passes over packed rows (``blocks.packed``).

They are those of ``pyspark.ml.clustering.KMeans`` for the same rows, partitions, k and seed: the draws are those of Spark's generators, worked
out here block by block (``Draws``), so that all fits share five passes and keep nothing beside the rows.  What comes to the
driver is one count a partition and, for each fit, the candidates (4 k or so) and how many rows are nearest to each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from cohort.operators.blocks import Blocks, block_sums, matrices, nearest_of, pieces, scored, square_distances, stacked
from cohort.session import ship

STEPS = 2
_MASK = (1 << 64) - 1
FOUND = "task int, part int, place long, x array<double>"


# --------------------------------------------------------------------------- Spark's and Java's generators

def _murmur(data: bytes, seed: int) -> int:
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _hashed(seed: int) -> int:
    """State that Spark's XORShiftRandom takes from a seed."""
    data = (seed & _MASK).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _shifted(state):
    """The state after; of one state or of an array."""
    if isinstance(state, int):
        state ^= state << 21 & _MASK
        state ^= state >> 35
        return state ^ (state << 4 & _MASK)
    state = state ^ (state << np.uint64(21))
    state ^= state >> np.uint64(35)
    return state ^ (state << np.uint64(4))


def _signed(value: int) -> int:
    return value - (1 << 32) if value >> 31 else value


def first_int(seed: int) -> int:
    """The first nextInt() of Spark's XORShiftRandom."""
    return _signed(_shifted(_hashed(seed)) & 0xFFFFFFFF)


@lru_cache(maxsize=1)
def _jumps() -> list[np.ndarray]:
    """Tables of 2**i steps at once, i = 0..12: a step is linear in the bits, so that its table has 256 entries for each byte of a state."""
    columns, out = _shifted(np.uint64(1) << np.arange(64, dtype=np.uint64)), []
    for _ in range(13):
        table = np.zeros((8, 256), np.uint64)
        for bit in range(8):
            high = (np.arange(256) >> bit & 1).astype(bool)
            table[:, high] ^= columns.reshape(8, 8)[:, bit][:, None]
        out.append(table)
        columns = _jumped(columns, table)
    return out


def _jumped(states: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for byte in range(8):
        out ^= table[byte][(states >> np.uint64(8 * byte) & np.uint64(255)).astype(np.intp)]
    return out


class Draws:
    """nextDouble() of Spark's XORShiftRandom, many at a time."""

    def __init__(self, seed: int) -> None:
        self.state = _hashed(seed)

    def take(self, n: int) -> np.ndarray:
        out = [self._few(min(n - i, 4096)) for i in range(0, n, 4096)]
        return np.concatenate(out) if out else np.empty(0)

    def _few(self, n: int) -> np.ndarray:
        states = np.array([_shifted(self.state)], np.uint64)
        for table in _jumps():
            if len(states) >= 2 * n:
                break
            states = np.concatenate([states, _jumped(states[:2 * n - len(states)], table)])
        self.state = int(states[-1])
        a, b = states[::2] & np.uint64((1 << 26) - 1), states[1::2] & np.uint64((1 << 27) - 1)
        return ((a << np.uint64(27)) + b).astype("float64") * 2.0**-53


class JavaRandom:
    """java.util.Random."""

    def __init__(self, seed: int) -> None:
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def bits(self, n: int) -> int:
        self.state = self.state * 0x5DEECE66D + 0xB & (1 << 48) - 1
        return self.state >> 48 - n

    def int(self) -> int:
        return _signed(self.bits(32))

    def long(self) -> int:
        return (self.int() << 32) + self.int()

    def below(self, bound: int) -> int:
        if bound & bound - 1 == 0:
            return bound * self.bits(31) >> 31
        while True:
            drawn = self.bits(31)
            if drawn - drawn % bound + bound - 1 < 1 << 31:
                return drawn % bound

    def double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0**-53


# --------------------------------------------------------------------------- k-means||

def _sampled(fraction: float, seed: int, n: int) -> list[int]:
    """Places of n rows that Spark's sampler takes."""
    if fraction >= 1.0 or not n:
        return list(range(n))
    draws = Draws(seed)
    if fraction > 0.4:
        return np.flatnonzero(draws.take(n) <= fraction).tolist()
    out, at = [], -1
    while True:  # gaps between the rows that are taken
        at += 1 + int(math.log(max(float(draws.take(1)[0]), 5e-11)) / math.log1p(-fraction))
        if at >= n:
            return out
        out.append(at)


def first_place(seed: int, counts: list[int]) -> tuple[int, int]:
    """(partition, place) of the row that takeSample(false, 1, seed) gives; counts: rows of each partition."""
    n, rand = sum(counts), JavaRandom(seed)
    if not n:
        raise ValueError("no rows to take centres from")
    gamma = -math.log(1e-4) / n
    fraction = min(1.0, max(1e-10, 1.0 / n + gamma + math.sqrt(gamma * gamma + 2.0 * gamma / n))) if n > 1 else 1.0
    found: list[tuple[int, int]] = [(p, 0) for p, rows in enumerate(counts) if rows] if n == 1 else []
    while not found:
        seeds = JavaRandom(rand.int())
        found = [(p, i) for p, rows in enumerate(counts) for i in _sampled(fraction, seeds.long(), rows)]
    for i in range(len(found) - 1, 0, -1):
        j = rand.below(i + 1)
        found[i], found[j] = found[j], found[i]
    return found[0]


def _found(rows: Blocks, pick: Callable[[int], Callable[[np.ndarray, int], Iterator[tuple[int, np.ndarray]]]], parts: list[int] | None = None) -> list[tuple]:
    """(task, partition, place, vector) of the rows that ``pick(partition)(matrix, place of its first row)`` names as (task, places in the matrix), in this order.

    ``parts``: the partitions to look at, if not all.
    """
    def named(part: int, blocks: Iterator[np.ndarray]) -> Iterator[tuple]:
        look, at = pick(part), 0
        for x in blocks:
            for task, places in look(x, at):
                if len(places):
                    yield task, at + places, x[places]
            at += len(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for task, places, x in named(part, (x for batch in batches for x in matrices(batch))):
            same = [pa.array(np.full(len(places), v), pa.int32()) for v in (task, part)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(places, pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["task", "part", "place", "x"])

    if rows.here is not None:
        found = [(task, part, place, v) for part, own in groupby(rows.here, key=lambda b: b[0]) for task, places, x in named(part, (x for _, x in own)) for place, v in zip(places, x, strict=True)]
    else:
        ship(rows.rows.sparkSession)
        asked = rows.rows.where(F.spark_partition_id().isin(parts)) if parts else rows.rows
        found = [(r["task"], r["part"], r["place"], np.array(r["x"])) for r in asked.mapInArrow(run, FOUND).collect()]
    return sorted(found, key=lambda r: r[:3])


def _costs(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (tasks x rows) to the nearest centre of each task; what may be nothing but rounding is summed by differences."""
    out = np.empty((len(centres), len(x)))
    for piece in pieces(x, centres.shape[0] * centres.shape[1]):
        y = x[piece]
        square = (y * y).sum(axis=1)
        near = scored(y, centres).min(axis=1) + square
        t, i = np.nonzero(near <= 1e-9 * square)
        for task in np.unique(t):
            own, c = i[t == task], centres[task]
            near[task, own] = square_distances(y[own], c[np.isfinite(c[:, 0])]).min(axis=0)
        out[:, piece] = near
    return out


def starts(rows: Blocks, tasks: list[tuple[int, int]]) -> list[np.ndarray]:
    """Centres for every (k, seed); fewer than k for too few different points."""
    drawn = {seed: first_int(seed) for _, seed in tasks}
    at = {seed: first_place(value, rows.counts) for seed, value in drawn.items()}

    def first(part: int):
        wanted = [(t, at[seed][1]) for t, (_, seed) in enumerate(tasks) if at[seed][0] == part]
        return lambda x, begin: ((t, np.array([place - begin])) for t, place in wanted if begin <= place < begin + len(x))

    chosen = [[x] for *_, x in _found(rows, first, sorted({p for p, _ in at.values()}))]
    for step in range(STEPS):
        centres = stacked([np.array(c) for c in chosen])

        def total(x: np.ndarray):
            yield slice(None), len(x), _costs(x, centres).sum(axis=1)[:, None]

        sums = block_sums(rows, len(tasks), 1, total)[1][:, 0]

        def draw(part: int):
            draws = {s: Draws(value ^ step << 16 ^ part) for s, value in drawn.items()}

            def look(x: np.ndarray, begin: int):
                own = {s: d.take(len(x)) for s, d in draws.items()}
                costs = _costs(x, centres)
                for t, (k, seed) in enumerate(tasks):
                    if sums[t] > 0:
                        yield t, np.flatnonzero(own[seed] < 2.0 * costs[t] * k / sums[t])

            return look

        for t, _, _, x in _found(rows, draw):
            chosen[t].append(x)
    different = [np.array(list({c.tobytes(): c for c in own}.values())) for own in chosen]
    many = [t for t, (k, _) in enumerate(tasks) if len(different[t]) > k]
    if many:
        centres = stacked([different[t] for t in many])
        width = centres.shape[1]

        def weigh(x: np.ndarray):
            for piece in pieces(x, width * len(many)):
                y = x[piece]
                d2 = scored(y, centres)
                near, best = d2.argmin(axis=1), d2.min(axis=1)
                close = np.count_nonzero(d2 <= best[:, None] + 1e-9 * (np.abs(best) + (y * y).sum(axis=1))[:, None], axis=1) > 1
                for j, t in enumerate(many):  # as good as equally near: by differences, the first on ties
                    rest = np.flatnonzero(close[j])
                    if len(rest):
                        near[j, rest] = nearest_of(square_distances(y[rest], different[t]))[0]
                spots = near + width * np.arange(len(many))[:, None]
                yield slice(None), np.bincount(spots.ravel(), minlength=width * len(many)), 0.0

        weights = block_sums(rows, width * len(many), 1, weigh)[0].reshape(len(many), width)
        for j, t in enumerate(many):
            different[t] = plus_plus(different[t], weights[j, :len(different[t])].astype("float64"), tasks[t][0])
    return different


def plus_plus(points: np.ndarray, weights: np.ndarray, k: int, max_iter: int = 30) -> np.ndarray:
    """k-means++ over weighted points and up to ``max_iter`` moves, as Spark's LocalKMeans does with seed 0."""
    rand = JavaRandom(0)

    def passed(shares: np.ndarray, limit: float) -> int:
        """How many shares are added until their sum reaches the limit."""
        return min(int(np.searchsorted(np.cumsum(shares), limit, "left")) + 1, len(shares)) if limit > 0 else 0

    centres = [points[passed(weights, rand.double() * weights.sum()) - 1]]
    cost = square_distances(points, np.array(centres))[0]
    for _ in range(1, k):
        shares = weights * cost
        j = passed(shares, rand.double() * shares.sum())
        centres.append(points[max(j - 1, 0)])
        cost = np.minimum(cost, square_distances(points, points[max(j - 1, 0)][None])[0])
    found, before = np.array(centres), np.full(len(points), -1)
    for _ in range(max_iter):
        near = nearest_of(square_distances(points, found))[0]
        for j in range(k):
            mine = near == j
            if weights[mine].sum() > 0:
                found[j] = (points[mine] * weights[mine][:, None]).sum(axis=0) / weights[mine].sum()
            else:
                found[j] = points[rand.below(len(points))]
        if (near == before).all():
            break
        before = near
    return found
