"""Best-fit packing of documents into sequences, with a certified lower bound.

Null texts count as empty (one end id). Rows that repeat a ``doc_id`` are
packed separately. Other columns of the input are ignored, whatever their
names are. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, staged
from .tokens import encoding, tokenizer_path

CAPACITY = 2048
PART_ITEMS = 20_000
NUMBER = "piece_no"


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(capacity: int, with_ids: bool = False):
    """Batches of pieces from batches of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = lists.values.to_numpy(zero_copy_only=False)
            data = memoryview(values.astype("<u4")).cast("B")
            ends = lists.offsets.to_numpy().astype(np.int64)
            n = np.diff(ends)
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = (n - (pieces - 1) * capacity)[doc]
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            lo = (ends[:-1][doc] + start).tolist()
            sums = [zlib.crc32(data[4 * a : 4 * (a + b)]) for a, b in zip(lo, length.tolist())]
            out = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                   pa.array(length), pa.array(sums, pa.int64())]
            if with_ids:
                cuts = np.concatenate([[0], np.cumsum(length)]) + (ends[0] if len(ends) else 0)
                out.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), lists.values))
            yield pa.RecordBatch.from_arrays(
                out, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            )

    return run


def cut_pieces(ids: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of documents (columns ``doc_id n_tokens ids``): only longer ones are cut.

    The first piece takes what is left over, all others are full. Gives
    ``doc_id piece start length ids_crc32`` and, if asked, ``ids``.
    """
    return ids.select("doc_id", "ids").mapInArrow(_cut(capacity, with_ids), PIECES + ", ids array<int>" * with_ids)


def least_bins(counts: np.ndarray, capacity: int, enough: int | None = None) -> int:
    """Lower bound on the bins for ``counts[length]`` items of each length; stops early at ``enough``.

    The largest over four families of dual feasible functions: the size
    itself, the cut at a threshold (long items whole, middle ones by size,
    short ones free), the rounding to multiples of 1/k, and steps with a ramp
    before each (an item of u counts 1/k where k items of u, but no more, fit),
    which sees that bins of k items must be made of short ones.
    """
    sizes = np.arange(len(counts), dtype=np.int64)
    best = -(-int(counts @ sizes) // capacity)
    below = np.concatenate([[0], np.cumsum(counts * sizes)])
    number = np.concatenate([[0], np.cumsum(counts)])
    total = int(counts.sum())
    for t in range(1, capacity // 2 + 1):
        long_items = total - int(number[capacity - t + 1])
        middle = int(below[capacity - t + 1] - below[t])
        best = max(best, long_items + -(-middle // capacity))
    lengths = np.flatnonzero(counts)
    n = counts[lengths].astype(np.int64)
    for k in range(1, 50):
        scaled = lengths * (k + 1)
        whole = scaled % capacity == 0
        value = np.where(whole, lengths * k, (scaled // capacity) * capacity)  # times 1 / (k * capacity)
        best = max(best, -(-int(n @ value) // (k * capacity)))
    for u in range(capacity, max(capacity // 50, 1), -1):
        if enough is not None and best >= enough:
            break
        best = max(best, _ramp_bound(lengths, n, capacity, u))
    return best


def _ramp_bound(lengths: np.ndarray, n: np.ndarray, capacity: int, u: int) -> int:
    """Bound by the steps of width ``u``, for ``n`` items of each of ``lengths``."""
    k, flat = divmod(capacity, u)
    value = (lengths // u) * (u - flat) + np.maximum(lengths % u - flat, 0)  # times 1 / (k * (u - flat))
    return -(-int(n @ value) // (k * (u - flat)))


def best_fit(
    lengths: np.ndarray, capacity: int, order: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, by decreasing length unless an order is given: bin and offset of each item, each bin's free room.

    Bins are kept by free room; one integer marks which rooms exist, so the
    tightest bin that fits is its lowest bit from the item's length on.
    """
    if order is None:
        order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    marks = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = marks >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                marks &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        free[b] = left
        if left:
            rooms[left].append(b)
            marks |= 1 << left
    return bins, offsets, np.array(free, dtype=np.int64)


def _orders(lengths: np.ndarray, capacity: int, seed: tuple[int, int]) -> Iterator[np.ndarray | None]:
    """Orders a part is tried in: by decreasing length; one bin after the other, filled by chance, all items or
    only those up to the step that gives the highest bound (longer ones go first, by decreasing length)."""
    yield None
    kinds, n = np.unique(lengths, return_counts=True)
    steps = range(capacity // 2, max(capacity // 50, 1), -1)
    step = max(steps, key=lambda u: _ramp_bound(kinds, n, capacity, u), default=capacity)
    rng = np.random.default_rng(seed)
    for most in (step, capacity):
        order = np.argsort(-lengths, kind="stable")
        first = int((lengths > most).sum())
        yield np.concatenate([order[:first], _filled_by_chance(lengths, order[first:], capacity, rng)])


def _filled_by_chance(lengths: np.ndarray, items: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """An order of ``items``: drawn by chance for a bin until only one more fits, then the longest that does."""
    left = items[np.argsort(lengths[items], kind="stable")].tolist()
    sizes = lengths[left].tolist()
    out: list[int] = []
    room = capacity
    while left:
        if len(sizes) > 1 and sizes[0] + sizes[1] <= room:
            at = int(rng.random() * len(sizes))
            if sizes[at] + sizes[0] > room:
                at = bisect_right(sizes, room) - 1
        else:
            at = bisect_right(sizes, room) - 1
        if at < 0:
            room = capacity
            continue
        room -= sizes.pop(at)
        out.append(left.pop(at))
    return np.array(out, dtype=np.int64)


def _packer(columns: list[str], capacity: int, r: int):
    """Packs one part in round ``r``; keeps rows in an order of their own, so a repeated task agrees."""

    def pack(dealt_to: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(NUMBER, ignore_index=True)
        lengths = group["length"].to_numpy()
        counts = np.bincount(lengths, minlength=capacity + 1)
        found, bound = None, 0
        for order in _orders(lengths, capacity, (r, int(dealt_to[0]))):
            tried = best_fit(lengths, capacity, order)
            if found is None or len(tried[2]) < len(found[2]):
                found = tried
                bound = max(bound, least_bins(counts, capacity, len(found[2])))
            if len(found[2]) == bound:
                break
        bins, offsets, free = found
        proven = len(free) == bound
        out = group[columns].copy()
        out["sequence_id"] = (r << 54) + (int(dealt_to[0]) << 24) + bins
        out["offset"] = offsets
        out["proven"] = proven
        out["open"] = (bins == int(free.argmax())) & (free[bins] > 0) if proven else free[bins] > 0
        return out

    return pack


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces written with a number of their own (``piece_no``), so that rows alike in all else stay apart."""
    if NUMBER in pieces.columns:
        return staged(pieces, "pieces")
    return staged(pieces.withColumn(NUMBER, F.monotonically_increasing_id()), "pieces")


def place(
    pieces: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, rounds: int | None = None,
) -> DataFrame:
    """Give each piece a ``sequence_id`` and an ``offset``; ``proven`` tells whether its part met its lower bound.

    Pieces get numbers when they are written and are dealt by them into parts
    of about ``part_items``, however alike they are. A part whose number of
    bins equals its lower bound is proven best. Full bins stay, and so do those
    of a proven part but for the one with most room; the pieces of all other
    bins are exchanged: they are dealt anew into fewer parts and packed again.
    A round that saves no bin is dropped, the places before it stay, and the work
    ends; it also ends when the pool was one part. ``rounds`` may end it sooner. Only lengths
    and keys move, never ids. ``length`` must lie between 1 and ``capacity``.
    """
    columns = pieces.columns
    rows = numbered(pieces)
    columns = columns if NUMBER in columns else [*columns, NUMBER]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema += ", sequence_id long, offset long, proven boolean, open boolean"
    begins = F.col("offset") == 0  # once in each bin
    done: list[DataFrame] = []
    pool: DataFrame | None = None
    left, before, r = rows.count(), None, 0
    while left:
        parts = -(-left // part_items)
        dealt = rows.withColumn("__part", F.pmod(F.xxhash64(NUMBER, F.lit(r)), F.lit(parts)).cast("int"))
        packed = staged(dealt.groupBy("__part").applyInPandas(_packer(columns, capacity, r), schema), f"packed{r}")
        after = packed.where(begins).count()
        if before is not None and after >= before:
            break
        r += 1
        if parts == 1 or r == rounds:
            pool = packed
            break
        done.append(packed.where("NOT open"))
        pool = packed.where("open")
        rows = pool.select(*columns)
        left, before = rows.count(), pool.where(begins).count()
    if pool is None:
        return rows.withColumns({
            "sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "proven": F.lit(True),
        }).select(*pieces.columns, "sequence_id", "offset", "proven")
    out = pool
    for more in done:
        out = out.union(more)
    return out.select(*pieces.columns, "sequence_id", "offset", "proven")


def certificate(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``bins`` used, and the lower bound ``least`` for all pieces together.

    The pieces are counted by length, at most ``capacity`` rows.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    bins = 0
    lengths = placed.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("bins"))
    for row in lengths.collect():
        counts[row.length] = row.n
        bins += row.bins
    return placed.sparkSession.createDataFrame([(bins, least_bins(counts, capacity))], "bins long, least long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and place whole documents: one row per piece.

    Both steps on texts share a Python worker: one each would double the workers, and an encoder stays in each of them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encode, cut = encoding(path or tokenizer_path(), ["doc_id"]), _cut(capacity)
    with small_batches(docs.sparkSession):
        return place(rows.mapInArrow(lambda batches: cut(encode(batches)), PIECES), capacity)


def fill(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids`` and the ``lengths`` of the pieces in them.

    ``pieces`` has the ids of each piece (``cut_pieces`` with ids); at most
    ``capacity`` ids meet in a row. Pieces that are ``numbered`` before they
    are placed meet their places by that number; others by ``doc_id`` and
    ``piece``, which must be unique then.
    """
    key = [NUMBER] if NUMBER in pieces.columns and NUMBER in placed.columns else ["doc_id", "piece"]
    rows = pieces.select(*key, "ids").join(placed.select(*key, "sequence_id", "offset", "length"), key)
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return rows.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths")
    )
