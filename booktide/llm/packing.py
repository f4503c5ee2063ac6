"""Packing documents into sequences: dominance reduction (Martello and Toth 1990), then best fit, over the counts of lengths.

Pieces of one length are alike, so an instance is its counts of lengths: as many numbers as a sequence has tokens, whatever the corpus. The
plan made from them says how many sequences have which lengths; pieces then take their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mapped, ranked

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0

#: A plan: (how often, ((length, how many of it side by side), ...)).
Plan = list[tuple[int, tuple[tuple[int, int], ...]]]


def reduce(counts: Counter, capacity: int) -> Plan:
    """Take from counts the sequences that some best packing has, by dominance, and return them.

    For the longest piece j: if nothing fits beside it, it stays alone. If one piece at most fits beside it, it takes the longest that
    fits. If a piece fills the rest exactly, that pair dominates any other set with j. If two at most fit beside it and the longest single
    piece is no shorter than the best pair, that pair of j and the single piece dominates. Equal cases are settled together, as often as
    the counts allow. A j for which nothing is proved is passed over.
    """
    plan: Plan = []
    lengths = sorted(counts)
    for j in reversed(lengths):
        while counts[j]:
            free = capacity - j
            fits = [x for x in lengths if x <= free and counts[x] - (x == j) > 0]
            if not fits:
                plan.append((counts[j], ((j, 1),)))
                counts[j] = 0
                break
            best = fits[-1]
            small = [x for x in fits[:3] for _ in range(min(3, counts[x] - (x == j)))][:3]
            if best < free:
                if len(small) > 1 and small[0] + small[1] <= free:
                    if len(small) > 2 and sum(small) <= free:
                        break
                    pair = max((x + y for x in fits if (y := _most(fits, free - x, x if counts[x] - (x == j) < 2 else 0))), default=0)
                    if best < pair:
                        break
            times = counts[j] // 2 if best == j else min(counts[j], counts[best])
            plan.append((times, ((j, 2),) if best == j else ((j, 1), (best, 1))))
            counts[j] -= times
            counts[best] -= times
    return plan


def _most(fits: list[int], free: int, but: int) -> int:
    """The largest of fits up to free that is not ``but``; 0 if there is none."""
    at = int(np.searchsorted(fits, free, side="right")) - 1
    while at >= 0 and fits[at] == but:
        at -= 1
    return fits[at] if at >= 0 else 0


def best_fit(counts: Counter, capacity: int) -> Plan:
    """Best fit of what is left, the longest first, each into the fullest sequence that still has room."""
    rooms: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(x for x in rooms if x >= length):
            each = room // length
            waiting = rooms.pop(room) if left else []
            while waiting and left:
                times, content = waiting.pop()
                full = min(times, left // each)
                if full:
                    rooms[room - each * length].append((full, (*content, (length, each))))
                    times, left = times - full, left - full * each
                if times and left:  # fewer than each are left: they go into one more
                    rooms[room - left * length].append((1, (*content, (length, left))))
                    times, left = times - 1, 0
                if times:
                    waiting.append((times, content))
            if waiting:
                rooms[room] += waiting
            if not left:
                break
        each = capacity // length
        for times, n in ((left // each, each), (1, left % each)):
            if times and n:
                rooms[capacity - n * length].append((times, ((length, n),)))
    return [x for group in rooms.values() for x in group]


def plan_of(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan that places each piece once; no sequence exceeds the capacity."""
    left = Counter({x: n for x, n in counts.items() if n > 0})
    if any(not 0 < x <= capacity for x in left):
        raise ValueError("a piece is empty or too long")
    return reduce(left, capacity) + best_fit(+left, capacity)


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, plan: Plan):
        runs, used, base = defaultdict(list), Counter(), 0
        for times, content in plan:
            offset = 0
            for length, n in content:
                runs[length].append((used[length], n, base, offset))
                used[length] += times * n
                offset += length * n
            base += times
        self.runs = {x: np.array(v, np.int64) for x, v in runs.items()}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            start, n, base, first = self.runs[int(x)][np.searchsorted(self.runs[int(x)][:, 0], rank[at], side="right") - 1].T
            sequence[at] = base + (rank[at] - start) // n
            offset[at] = first + x * ((rank[at] - start) % n)
        return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and row (a number for each row of docs) of each piece. tokenizer: path of its file, on all machines."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode = encoder(tokenizer)
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                rows = []
                own = batch.slice(part, 1000)
                for doc, text, row in zip(*(own.column(c).to_pylist() for c in ("doc_id", "text", "row")), strict=True):
                    raw = encode(text or "") + END.to_bytes(4, "little")
                    step = 4 * capacity
                    rows += [(doc, k, at // 4, min(step, len(raw) - at) // 4, zlib.crc32(raw[at : at + step]), row) for k, at in enumerate(range(0, len(raw), step))]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return mapped(numbered, cut, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Place each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row for each piece.

    A document is its tokens and the end id; only a longer one is cut, every capacity tokens. A null text is empty: the end id alone. A
    repeated row is packed again. sequence_id is dense from 0; the pieces of a sequence follow one another from offset 0 without gaps.
    The driver holds the counts of lengths and the plan, whose sizes depend on the capacity, not on the corpus.
    """
    cut = kept(pieces(docs, tokenizer, capacity))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    places = docs.sparkSession.sparkContext.broadcast(Places(plan_of(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    placed = ranked(cut, ["length"], ["doc_id", "row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return mapped(placed, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
