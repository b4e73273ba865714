"""Packing token sequences: best-two-fit over the histogram of lengths.

Which documents share a sequence depends on their lengths only, so packing is decided on the histogram: at most
``capacity`` counts, whatever the number of documents. A bin starts with the longest length left and is filled greedily
with the longest that fit; then its smallest document is replaced by two unpacked ones that fit the expanded gap more
tightly. The same bin is made as often as the counts allow, so the number of different bins is bounded by the lengths.

Documents take the places of their length by rank. Ranks are counted in two levels (see ``running_total``), so a length
that a third of all documents share is ranked by many tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, free_name, running_total, stored
from .tokens import default_path, encoder

#: (first rank, number of places, first sequence, places in one sequence, offset of the first place)
Places = dict[int, list[tuple[int, int, int, int, int]]]


class _Lengths:
    """Counts of the lengths that are left, and the largest one that fits."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n

    def largest(self) -> np.ndarray:
        """For each room from 0: the largest length left that fits, 0 if none."""
        return np.maximum.accumulate(np.where(self.count > 0, np.arange(len(self.count)), 0))


def _fill(left: np.ndarray, bin_: list[int], gap: int) -> int:
    """Adds the largest lengths that fit; returns the gap that stays."""
    fits = np.flatnonzero(left[: gap + 1])
    while gap and len(fits):
        length = int(fits[-1])
        n = min(int(left[length]), gap // length)
        bin_ += [length] * n
        left[length] -= n
        gap -= n * length
        fits = fits[(fits <= gap) & (left[fits] > 0)] if gap else fits[:0]
    return gap


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins for lengths 1 to ``capacity``: (lengths in the bin, how many such bins), using each length as often as counted."""
    lengths, bins = _Lengths(counts, capacity), []
    top = capacity
    while True:
        while top and not lengths.count[top]:
            top -= 1
        if not top:
            return bins
        left = lengths.count.copy()
        left[top] -= 1
        bin_ = [top]
        gap = _fill(left, bin_, capacity - top)
        if gap and len(bin_) > 1:
            small = min(bin_)
            room = gap + small
            largest = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))
            first = np.flatnonzero(left[: room + 1])
            second = np.minimum(largest[room - first], first)
            second = np.where((second == first) & (left[first] < 2), largest[np.maximum(np.minimum(room - first, first - 1), 0)], second)
            both = np.where(second > 0, first + second, 0)
            if len(both) and both.max() > small:
                k = int(both.argmax())
                bin_.remove(small)
                left[small] += 1
                for x in (int(first[k]), int(second[k])):
                    bin_.append(x)
                    left[x] -= 1
                _fill(left, bin_, room - int(both[k]))
        need = Counter(bin_)
        times = min(int(lengths.count[x]) // n for x, n in need.items())
        for x, n in need.items():
            lengths.count[x] -= n * times
        bins.append((sorted(bin_, reverse=True), times))


def places(bins: list[tuple[list[int], int]]) -> Places:
    """For each length, where the documents of that length go, by rank."""
    out: Places = {}
    ranks: Counter = Counter()
    sequence = 0
    for bin_, times in bins:
        offset = 0
        for length, n in sorted(Counter(bin_).items(), reverse=True):
            out.setdefault(length, []).append((ranks[length], n * times, sequence, n, offset))
            ranks[length] += n * times
            offset += n * length
        sequence += times
    return out


def token_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of a document's ids with the end id: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                rows = [
                    (doc, piece, at // 4, len(x) // 4, zlib.crc32(x), x)
                    for doc, ids in zip(some.column(0).to_pylist(), encode.encode(some.column(1).to_pylist()))
                    for whole in (ids + end,)
                    for piece, at in enumerate(range(0, len(whole), 4 * capacity))
                    for x in (whole[at : at + 4 * capacity],)
                ]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()) + (pa.binary(),) * with_ids
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    Rows of equal length take their places in order of (hash of doc_id, piece and ids_crc32, doc_id, piece, start, ids_crc32); rows
    that agree in all of these are interchangeable. Other columns stay, whatever their names; one called sequence_id or
    offset is replaced. An empty table stays empty.
    """
    pieces = stored(pieces.drop("sequence_id", "offset"))
    bucket, position = free_name(pieces, "bucket"), free_name(pieces, "rank")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    where = {k: np.array(v, np.int64).T for k, v in places(best_two_fit(counts, capacity)).items()}
    most = max(counts.values(), default=1)
    ranked = running_total(
        pieces.withColumn(bucket, bucket_of(F.lit(most), "doc_id", "piece", "ids_crc32")),
        ["length"], bucket, ["doc_id", "piece", "start", "ids_crc32"], F.lit(1).cast("long"), position,
    ).drop(bucket)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", position))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, _, base, n, start = where[int(x)]
                k = np.searchsorted(first, rank[at], "right") - 1
                inside = rank[at] - first[k]
                sequence[at], offset[at] = base[k] + inside // n[k], start[k] + inside % n[k] * x
            for name, values in (("sequence_id", sequence), ("offset", offset)):
                batch = batch.append_column(name, pa.array(values))
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).drop(position)


def pack_documents(
    docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0, capacity: int = 2048, with_ids: bool = False
) -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A null or empty text is packed as its end id alone. A document longer than ``capacity`` is cut into full pieces and
    a last one. Repeated rows are packed each; a null id stays null. An empty table stays empty; other columns are ignored.
    """
    return pack_pieces(token_pieces(docs, tokenizer_path or default_path(), end_id, capacity, with_ids), capacity)
