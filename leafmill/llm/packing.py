"""Best-fit packing of documents into fixed token sequences by a grouping genetic algorithm.

Pieces of equal length are interchangeable, so the algorithm works on counts by length (at most
``capacity`` numbers, whatever the corpus). A solution is a list of bin patterns, each with how
many bins it fills. Crossover injects whole well-filled bins of one parent into the other,
removes bins of the other whose pieces are then taken twice, and best-fits the displaced pieces
into the bins that are open, then into new ones. Islands evolve in parallel tasks until nothing
gets better or a lower bound is met, and pass their best solutions on in a ring. The best plan is
then dealt to the pieces by their rank among pieces of the same length, in a distributed pass.
"""

from __future__ import annotations

import bisect
import pickle
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, slices, written
from leafmill.llm.tokens import encoder

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first
Plan = list[tuple[Pattern, int]]


# ---- the genetic algorithm on counts by length ----


class Supply:
    """What is left to pack: counts by length, with a look-up of the longest that fits."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            del self.lengths[bisect.bisect_left(self.lengths, length)]

    def fit(self, room: int, used: dict[int, int], skip: float, rng: random.Random) -> int:
        """The longest length of at most ``room`` that is still there; sometimes one further down."""
        at = bisect.bisect_right(self.lengths, room) - 1
        while at >= 0:
            s = self.lengths[at]
            if self.counts[s] > used.get(s, 0) and (not skip or rng.random() >= skip or at == 0):
                return s
            at -= 1
        return 0


def best_fit(counts: dict[int, int], capacity: int, rng: random.Random, skip: float = 0.0) -> Plan:
    """Best-fit decreasing: the longest piece first, then always the longest that still fits."""
    supply, plan = Supply(counts), []
    while supply.lengths:
        first = supply.lengths[-1]
        used, room = {first: 1}, capacity - first
        while room > 0 and (s := supply.fit(room, used, skip, rng)):
            used[s] = used.get(s, 0) + 1
            room -= s
        if room and len(used) + 1 <= capacity:
            room = exchange(supply, used, room)
        times = min(supply.counts[s] // k for s, k in used.items())
        for s, k in used.items():
            supply.take(s, k * times)
        plan.append((tuple(sorted(used.items(), reverse=True)), times))
    return plan


def exchange(supply: Supply, used: dict[int, int], room: int) -> int:
    """Fill a gap by putting a longer piece, or a pair of pieces, in the place of one (not the longest)."""
    for s in sorted(used)[:-1]:
        other = s + room
        if supply.counts.get(other, 0) > used.get(other, 0):
            swap(used, s, (other,))
            return 0
        for a in supply.lengths:
            if 2 * a > other:
                break
            b = other - a
            if supply.counts.get(a, 0) > used.get(a, 0) + (a == b) and supply.counts.get(b, 0) > used.get(b, 0) + (a == b) - 0 and s not in (a, b):
                swap(used, s, (a, b))
                return 0
    return room


def swap(used: dict[int, int], old: int, new: tuple[int, ...]) -> None:
    used[old] -= 1
    if not used[old]:
        del used[old]
    for s in new:
        used[s] = used.get(s, 0) + 1


def filled(pattern: Pattern) -> int:
    return sum(s * k for s, k in pattern)


def cost(plan: Plan, capacity: int) -> tuple[int, float]:
    """Bins, then how unevenly they are filled (full bins and one nearly empty one are best)."""
    return sum(m for _, m in plan), -sum(m * (filled(p) / capacity) ** 2 for p, m in plan)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: long pieces need bins of their own, and what is left beside them has to fit.

    For each k: pieces over ``capacity - k`` stand alone, those over half may take pieces of k or
    more beside them, and these are shared out over the room that there is."""
    lengths = sorted(s for s, n in counts.items() if n > 0)
    best = -(-sum(s * counts[s] for s in lengths) // capacity)
    for k in [0, *(s for s in lengths if 2 * s <= capacity)]:
        alone = sum(counts[s] for s in lengths if s > capacity - k)
        long = [s for s in lengths if 2 * s > capacity and s <= capacity - k]
        room = sum((capacity - s) * counts[s] for s in long)
        rest = sum(s * counts[s] for s in lengths if k <= s and 2 * s <= capacity)
        best = max(best, alone + sum(counts[s] for s in long) + max(0, -(-(rest - room) // capacity)))
    return best


def top_up(plan: Plan, left: dict[int, int], capacity: int) -> Plan:
    """``plan`` with the pieces of ``left`` put into its open bins, the longest first and each where
    the least room is that it fits in. Takes them out of ``left``."""
    by_room: dict[int, dict[Pattern, int]] = {}
    full: Plan = []

    def add(pattern: Pattern, times: int) -> None:
        room = capacity - filled(pattern)
        if not room:
            full.append((pattern, times))
            return
        if room not in by_room:
            bisect.insort(rooms, room)
        own = by_room.setdefault(room, {})
        own[pattern] = own.get(pattern, 0) + times

    rooms: list[int] = []
    for pattern, times in plan:
        add(pattern, times)
    for s in sorted((s for s, n in left.items() if n > 0), reverse=True):
        while left[s] and (at := bisect.bisect_left(rooms, s)) < len(rooms):
            own = by_room[rooms[at]]
            pattern, times = own.popitem()
            if not own:
                del by_room[rooms.pop(at)]
            now = min(times, left[s])
            left[s] -= now
            held = dict(pattern)
            held[s] = held.get(s, 0) + 1
            add(tuple(sorted(held.items(), reverse=True)), now)
            if times > now:
                add(pattern, times - now)
    return full + [(pattern, times) for own in by_room.values() for pattern, times in own.items()]


def crossover(base: Plan, donor: Plan, counts: dict[int, int], capacity: int, rng: random.Random) -> Plan:
    """Inject well-filled bins of ``donor``; keep the bins of ``base`` without pieces taken twice; best-fit the rest."""
    left = dict(counts)
    child: Plan = []

    def put(pattern: Pattern, times: int) -> None:
        for s, k in pattern:
            times = min(times, left.get(s, 0) // k)
        if times > 0:
            for s, k in pattern:
                left[s] -= k * times
            child.append((pattern, times))

    good = sorted(donor, key=lambda x: -filled(x[0]))
    share = rng.uniform(0.3, 0.9)
    for pattern, times in good[: max(1, int(len(good) * share))]:
        if filled(pattern) >= 0.97 * capacity:
            put(pattern, times if rng.random() < 0.8 else max(1, times // 2))
    for pattern, times in sorted(base, key=lambda x: -filled(x[0])):
        if filled(pattern) == capacity or rng.random() < 0.7:
            put(pattern, times)
    # open bins take displaced pieces first, best fit; what is left makes new bins
    child = top_up(child, left, capacity) if rng.random() < 0.5 else child
    return merged(child + best_fit(left, capacity, rng, rng.choice((0.0, 0.0, 0.1, 0.3))))


def mutate(plan: Plan, counts: dict[int, int], capacity: int, rng: random.Random) -> Plan:
    """Empty the worst bins and some others, and pack their pieces anew."""
    left, kept = dict(counts), []
    for pattern, times in plan:
        if filled(pattern) == capacity and rng.random() < 0.85:
            kept.append((pattern, times))
            for s, k in pattern:
                left[s] -= k * times
    return merged(kept + best_fit(left, capacity, rng, rng.choice((0.0, 0.05, 0.2))))


def merged(plan: Plan) -> Plan:
    out: dict[Pattern, int] = {}
    for pattern, times in plan:
        out[pattern] = out.get(pattern, 0) + times
    return list(out.items())


def evolve(population: list[Plan], counts: dict[int, int], capacity: int, generations: int, size: int, rng: random.Random, patience: int = 80) -> list[Plan]:
    """``size`` plans after at most ``generations``, fewer if the bound is met or the best one has
    not become better for ``patience`` of them."""
    bound = least_bins(counts, capacity)
    while len(population) < size:
        population.append(best_fit(counts, capacity, rng, 0.0 if not population else rng.uniform(0.02, 0.3)))
        if cost(population[-1], capacity)[0] <= bound:
            return [population[-1]]
    ranked = sorted(((cost(p, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    still = 0
    for turn in range(generations):
        if ranked[0][0][0] <= bound or still >= patience:
            break
        (_, _, a), (_, _, b) = rng.sample(ranked, 2)
        child = crossover(a, b, counts, capacity, rng) if rng.random() < 0.7 else mutate(a, counts, capacity, rng)
        before = ranked[0][0]
        known = {x[0] for x in ranked}
        of_child = cost(child, capacity)
        if of_child not in known:  # copies would crowd out other plans
            ranked = sorted([*ranked, (of_child, size + turn, child)], key=lambda x: x[:2])[:size]
        still = 0 if ranked[0][0] < before else still + 1
    return [p for _, _, p in ranked]


def plan_bins(spark, counts: dict[int, int], capacity: int, *, islands: int = 4, rounds: int = 3, generations: int = 300, population: int = 6, seed: int = 7) -> Plan:
    """The best plan of ``islands`` populations after ``rounds`` with migration of the elite.

    What passes through the driver is bounded: each plan has a few patterns a length at most. A plan
    that meets the lower bound is taken at once."""
    bound = least_bins(counts, capacity)
    best = best_fit(counts, capacity, random.Random(seed))
    if cost(best, capacity)[0] <= bound:
        return best
    state = [(i, pickle.dumps([best])) for i in range(islands)]
    for turn in range(rounds):

        def run(frames, turn=turn):
            for frame in frames:
                for i, blob in zip(frame["island"], frame["state"]):
                    rng = random.Random(seed * 1_000_003 + int(i) * 101 + turn)
                    got = evolve(pickle.loads(blob), counts, capacity, generations, population, rng)
                    yield pd.DataFrame({"island": [i], "state": [pickle.dumps(got)]})

        frame = spark.createDataFrame(state, "island int, state binary").repartition(islands)
        grown = {r["island"]: pickle.loads(bytes(r["state"])) for r in frame.mapInPandas(run, "island int, state binary").collect()}
        before = cost(best, capacity)
        best = min((p for ps in grown.values() for p in ps), key=lambda p: cost(p, capacity))
        if cost(best, capacity)[0] <= bound or cost(best, capacity) == before:
            break
        elite = [min(grown[i], key=lambda p: cost(p, capacity)) for i in range(islands)]
        state = [(i, pickle.dumps([*grown[i][: population - 1], elite[(i - 1) % islands]])) for i in range(islands)]
    return best


# ---- pieces and their places ----

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, at long"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches):
        told = encoder(path)
        part_id = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                ids, borders = told.encode(part.column(1))
                n = part.num_rows
                ids = np.insert(ids, borders[1:], end_id).astype("<u4")
                borders = borders + np.arange(n + 1)
                sizes = np.diff(borders)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(n), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = sizes - (pieces - 1) * capacity
                start = np.where(number == 0, 0, head[row] + (number - 1) * capacity)
                length = np.where(number == 0, head[row], capacity)
                first = borders[row] + start
                crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(first, first + length)), np.int64, len(row))
                # the place among pieces of this length in this partition
                order = np.argsort(length, kind="stable")
                by = length[order]
                fresh = np.flatnonzero(np.diff(by, prepend=-1))
                at = np.empty(len(row), np.int64)
                at[order] = np.arange(len(row)) - np.repeat(fresh, np.diff(np.append(fresh, len(row)))) + seen[by]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(row), part_id, np.int32)), pa.array(at)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"],
                )

    return run


def _places(plan: Plan, capacity: int):
    """Ranges of ranks by length: (key of the first rank, rank, sequence, pieces a bin, offset)."""
    rows, taken, base = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for s, k in pattern:
            rank = taken.get(s, 0)
            rows.append((s, rank, base, k, offset))
            taken[s] = rank + k * times
            offset += s * k
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)

    def run(batches):
        first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.empty(len(rank), np.int64)
            for s in np.unique(length):
                own = length == s
                lo, hi = first[s], first[s + 1]
                at[own] = lo + np.searchsorted(table[lo:hi, 1], rank[own], "right") - 1
            _, lowest, sequence, k, offset = table[at].T
            inside = rank - lowest
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence + inside // k), pa.array(offset + inside % k * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, islands: int = 4, rounds: int = 3, generations: int = 300) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into as few sequences of ``capacity`` tokens as can be found.

    A document is its ids and ``end_id``; a longer one is cut into pieces of ``capacity``, the
    first piece taking what is over. Null text is an empty one; whole texts count, however long.
    Repeated rows are packed each; null ids are kept; other columns are left out; no documents make
    no rows.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = written(rows.mapInArrow(_cut(tokenizer_path, end_id, capacity), PIECES), "pieces")
    groups = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows come to the driver
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_bins(spark, counts, capacity, islands=islands, rounds=rounds, generations=generations) if counts else []
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(groups, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_places(plan, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
