"""Operator 1, best-fit packing of documents into sequences.

Documents become ids and an end id; only those longer than a sequence are cut, into full sequences and a rest. How many
pieces there are of each length is all that packing needs, and that histogram has at most `capacity` bins whatever the
size of the corpus. On it stands the configuration linear program: choose how often to use each configuration (a
multiset of lengths that fits a sequence) so that every piece is covered by as few sequences as possible.

    solve      multiplicative weights: each round prices lengths by how far they still are from being covered, finds
               the best configuration for these prices by a knapsack dynamic program, and uses it for a step. Lengths
               are grouped into `grid` classes for this, each standing for its largest length. Where the class width does
               not divide the capacity, the last class reaches up to it: such a piece stands alone in the program.
    round_up   takes whole multiples of the configurations, largest fill first, puts the longest remaining lengths into
               their slots, fills what is left of each sequence by best fit, and packs the remainder by the same rule.

The result, (configuration, how often) pairs, is at most a few times `capacity` rows. Pieces are then placed without
any shuffle of texts: each has its rank among the pieces of its length (a local rank, and an offset from the counts of
earlier partitions), and its rank and length name its sequence and offset.

Cases: a null or empty text is one piece that holds the end id alone; rows are packed one by one, repeated or sharing an
identifier or not; pieces of equal length are interchangeable, so ties change no sequence's fill; a very long text is cut
into full sequences and a rest; a null identifier is carried; an empty table gives no rows. Extra columns, whatever their
names, do not take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, sized, staged, table
from .tokens import forget, tokenizer_path, word_encoder

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END_ID = 4096, 1
GRID, ROUNDS = 128, 3000

Packed = list[tuple[tuple[tuple[int, int], ...], int]]


def knapsack(prices: np.ndarray) -> np.ndarray:
    """How often to take each size 1..n for the highest total price within n, by dynamic programming."""
    n = len(prices)
    best, pick = np.zeros(n + 1), np.zeros(n + 1, int)
    for room in range(1, n + 1):
        gains = best[room - 1 :: -1][:room] + prices[:room]
        k = int(gains.argmax())
        best[room], pick[room] = gains[k], k + 1
        if best[room - 1] >= best[room]:
            best[room], pick[room] = best[room - 1], 0
    out, room = np.zeros(n, int), n
    while room > 0:
        if pick[room]:
            out[pick[room] - 1] += 1
            room -= pick[room]
        else:
            room -= 1
    return out


def solve(demand: np.ndarray, rounds: int = ROUNDS, rate: float = 0.15) -> dict[tuple[int, ...], float]:
    """Fractional configuration counts that cover `demand` (of sizes 1..n within n), by multiplicative weights."""
    n, wanted = len(demand), demand > 0
    if not wanted.any():
        return {}
    need = np.where(wanted, demand, 1).astype(float)
    covered, used = np.zeros(n), {}
    for _ in range(rounds):
        gap = covered - covered[wanted].min()
        prices = np.where(wanted, np.exp(-gap / rate) / need, 0)
        # a little of the size's own volume settles ties between configurations in favour of full ones
        prices += np.where(wanted, 1e-3 * prices.max() * np.arange(1, n + 1) / n, 0)
        config = np.minimum(knapsack(prices), np.where(wanted, np.ceil(demand), 0).astype(int))
        if not config.any():
            break
        step = rate * (need[config > 0] / config[config > 0]).min()
        used[key] = used.get(key := tuple(config.tolist()), 0) + step
        covered += step * config / need
        if covered[wanted].min() >= 40 * rate:
            break
    least = covered[wanted].min()
    if least <= 0:  # sizes not reached in time get configurations of their own
        for size in np.flatnonzero(wanted & (covered <= 0)):
            own = np.zeros(n, int)
            own[size] = max(1, n // (size + 1))
            used[tuple(own.tolist())] = need[size] / own[size]
        least = covered[wanted & (covered > 0)].min() if (covered[wanted] > 0).any() else 1.0
    return {c: x / max(least, 1.0) if least < 1 else x / least for c, x in used.items()}


class Stock:
    """Pieces that are still to be placed: how many of each length."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.copy()

    def longest(self, most: int, least: int = 1) -> int:
        """The longest remaining length within the bounds, or 0."""
        found = np.flatnonzero(self.counts[least : most + 1])
        return int(found[-1]) + least if len(found) else 0

    def fill(self, items: dict[int, int], room: int) -> int:
        """Adds the longest lengths that fit, again and again; returns how often the whole can be made."""
        while room > 0 and (size := self.longest(room)):
            n = min(room // size, int(self.counts[size]) - items.get(size, 0))
            if n <= 0:
                free = [s for s in range(room, 0, -1) if self.counts[s] > items.get(s, 0)]
                if not free:
                    break
                size = free[0]
                n = min(room // size, int(self.counts[size]) - items.get(size, 0))
            items[size] = items.get(size, 0) + n
            room -= n * size
        return min(int(self.counts[s]) // n for s, n in items.items())

    def take(self, items: dict[int, int], times: int) -> None:
        for size, n in items.items():
            self.counts[size] -= n * times


def round_up(counts: np.ndarray, configs: dict[tuple[int, ...], float], unit: int) -> Packed:
    """Whole configurations that place every piece once. counts: by length, from 0 to the capacity."""
    capacity, stock, out = len(counts) - 1, Stock(counts), []

    def make(items: dict[int, int], most: int) -> int:
        times = min(most, stock.fill(items, capacity - sum(s * n for s, n in items.items())))
        stock.take(items, times)
        out.append((tuple(sorted(items.items(), reverse=True)), times))
        return times

    fullest = sorted(configs.items(), key=lambda c: (-sum(n * (k + 1) for k, n in enumerate(c[0])), c[0]))
    for config, x in fullest:
        left = int(x)
        while left > 0:
            items: dict[int, int] = {}
            for k in np.flatnonzero(config)[::-1].tolist():
                need, top = config[k], capacity if k == len(config) - 1 else (k + 1) * unit
                while need and (size := stock.longest(top, k * unit + 1)):
                    n = min(need, int(stock.counts[size]))
                    items[size], need, top = n, need - n, size - 1
                if need:
                    break
            else:
                left -= make(items, left)
                continue
            break
    while size := stock.longest(capacity):
        make({size: 1}, int(stock.counts[size]))
    return out


def pack_lengths(counts: np.ndarray, grid: int = GRID, rounds: int = ROUNDS) -> Packed:
    """counts: pieces by length, from 0 to the capacity. Returns (((length, how many), ...), how often) rows."""
    capacity = len(counts) - 1
    unit = -(-capacity // grid)
    demand = np.zeros(capacity // unit)  # classes must not promise more than fits
    np.add.at(demand, np.minimum((np.arange(1, capacity + 1) - 1) // unit, len(demand) - 1), counts[1:])
    return round_up(counts, solve(demand, rounds), unit)


def places(packed: Packed) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces a sequence, first sequence, offset), ascending by rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for items, times in packed:
        offset = 0
        for size, n in items:
            out.setdefault(size, []).append((ranks.get(size, 0), n, sequence, offset))
            ranks[size] = ranks.get(size, 0) + n * times
            offset += size * n
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """part, doc_id, piece, start, length, ids_crc32, local_rank (among the part's pieces of this length, from 0)."""
    end = np.array([end_id], "<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ranks, encoder = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), word_encoder(path)
        for b in sized(batches, 1, size=6 << 20):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode_array(b.column(1)), strict=True):
                ids = np.concatenate([ids, end])
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    n = len(own)
                    rows.append((part, doc_id, piece, at, n, zlib.crc32(own.tobytes()), int(ranks[n])))
                    ranks[n] += 1
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "doc_id", "piece", "start", "length", "ids_crc32", "local_rank"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "part int, doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long")


def pack_documents(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    bound_batches(spark)
    cut = staged(pieces(docs, path or tokenizer_path(VOCABULARY), capacity, end_id), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    where = places(pack_lengths(histogram))
    earlier = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = cut.join(earlier, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))
    table_ = spark.sparkContext.broadcast(where)  # a few times `capacity` rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # encoding is over
        known = table_.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                here, rows = np.flatnonzero(length == size), known[int(size)]
                hit = rows[np.searchsorted(rows[:, 0], rank[here], side="right") - 1]
                k = rank[here] - hit[:, 0]
                sequence[here], offset[here] = hit[:, 2] + k // hit[:, 1], hit[:, 3] + k % hit[:, 1] * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
