"""Substring deduplication: Rabin-Karp hashes of all fixed-length word windows, grouped by Spark.

1. Each task hashes the windows of its documents, a bounded chunk of whole documents at a time, and sorts them. A window
   that repeats within the chunk is settled there: only its first place goes on. So a passage that a third of all
   documents share sends one entry for each chunk, and every window of the corpus is still seen.
2. Entries travel as packed arrays (8 bytes of hash, about 1 of place), one array for each chunk and bucket. The bucket
   comes from a second, independent hash, so that a window is known by 64 bits and its bucket: the chance of a false
   match of a window is (windows in one bucket) / 2^64, the same at every scale. Within a chunk both hashes must agree.
   Matches are not held against the words. A bucket's task finds the first place of each window; every other place is
   covered by an earlier one.
3. Places that are covered travel, packed again, to the task of their document's part, which merges them. They form
   maximal intervals, which are cut from the document's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words of whole documents that a task hashes at a time (one longer document is a chunk by itself).
CHUNK_WORDS = 1_500_000
#: Windows that one bucket holds about; a bucket is what one task sorts in memory.
BUCKET_WINDOWS = 2_500_000
#: Stands for a null id while places are sorted.
NULL_ID = -(2**63)


@lru_cache(maxsize=4)
def _powers(base: int, log2: int) -> np.ndarray:
    out = np.full(2**log2, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a rolling hash."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


def rolling_hashes(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2^64 of each run of ``window`` word hashes, by prefix sums of powers.

    The prefix difference is divided by the power of its start, which has an inverse because the base is odd.
    """
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64)
    log2 = n.bit_length()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(base, log2)[:n], dtype=np.uint64)])
    inverse = _powers(pow(base, -1, 2**64), log2)[: n - window + 1]
    return _mixed((sums[window:] - sums[: n - window + 1]) * inverse)


def _first_of(hashes: np.ndarray) -> np.ndarray:
    """For each entry the position of the first one with its hash."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order]
    new = np.ones(len(same), bool)
    new[1:] = same[1:] != same[:-1]
    out = np.empty(len(same), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    return out


SENT = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary())])


def packed(doc: np.ndarray, part: np.ndarray, starts: np.ndarray) -> bytes:
    """Places in order of (document, part of its id, start): documents, their numbers of places and the starts, as differences by byte plane."""
    change = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])) if len(doc) else np.zeros(0, int)
    counts = np.diff(np.append(change, len(doc))).astype("<u4")
    step = np.diff(starts.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    ids = np.diff(doc[change].astype("<i8"), prepend=np.int64(0))
    planes = [np.array([len(change)], "<u4").tobytes(), ids.tobytes(), part[change].astype("<i8").tobytes(), counts.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*planes, step.view(np.uint8).reshape(-1, 4).T.tobytes()]))


def unpacked(places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(places)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ids = np.cumsum(np.frombuffer(raw, "<i8", n, 4))
    parts = np.frombuffer(raw, "<i8", n, 4 + 8 * n)
    counts = np.frombuffer(raw, "<u4", n, 4 + 16 * n)
    planes = np.frombuffer(raw, np.uint8, offset=4 + 20 * n).reshape(4, -1)
    starts = np.cumsum(planes.T.copy().view("<u4").ravel(), dtype=np.uint32)
    return np.repeat(ids, counts), np.repeat(parts, counts), starts


def _task_of(doc: np.ndarray, part: np.ndarray, tasks: int) -> np.ndarray:
    """The task that merges the places of each document, by a hash."""
    key = doc.astype(np.int64).view(np.uint64) + part.astype(np.int64).view(np.uint64)
    return ((_mixed(key) >> np.uint64(33)) % np.uint64(tasks)).astype(np.int64)


def _chunk(rows: list[tuple[int, int, np.ndarray]], window: int, buckets: int) -> Iterator[tuple]:
    """The rows that one chunk sends: entries of first places, and, with a negative bucket, places settled already."""
    rows = sorted(rows, key=lambda r: r[:2])
    counts = [len(w) - window + 1 for *_, w in rows]
    doc, part = (np.repeat(np.array([r[i] for r in rows], np.int64), counts) for i in (0, 1))
    start = np.concatenate([np.arange(n, dtype=np.uint32) for n in counts])
    words = np.concatenate([w for *_, w in rows])
    # The windows of all documents are hashed at once; those that begin in one and end in another are left out.
    begins = np.cumsum([0] + [len(w) for *_, w in rows[:-1]])
    inside = np.repeat(begins, counts) + start
    key, second = (rolling_hashes(words, window, b)[inside] for b in BASES)
    # The upper bits of the second hash: its product with the number of buckets, divided by 2^32.
    bucket = ((second >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    first_of = _first_of(key)
    later = (first_of != np.arange(len(key))) & (second == second[first_of])
    if later.any():
        again = np.flatnonzero(later)
        to = xxhash.xxh64_intdigest(key[again[:1]].tobytes()) % buckets
        yield -1 - to, b"", packed(doc[again], part[again], start[again])
    at = np.flatnonzero(~later)
    at = at[np.argsort(bucket[at], kind="stable")]
    ends = np.searchsorted(bucket[at], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)):
        own = at[ends[b] : ends[b + 1]]
        yield int(b), key[own].tobytes(), packed(doc[own], part[own], start[own])


def _hashed(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            sent = list(_chunk(rows, window, buckets))
            for at in range(0, len(sent), 256):
                columns = zip(*sent[at : at + 256])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, SENT)], schema=SENT)

        for batch in batches:
            ids, parts, texts = batch.columns
            for k in range(batch.num_rows):
                words = (texts[k].as_py() or "").encode().split()
                if len(words) < window:
                    continue
                if rows and size + len(words) > CHUNK_WORDS:
                    yield from out()
                    rows, size = [], 0
                rows.append((ids[k].as_py(), parts[k].as_py(), np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), np.uint64, len(words))))
                size += len(words)
        if rows:
            yield from out()

    return run


def _ordered(places: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All places in order of (document, part, start), and the order that sorts them."""
    doc, part, start = (np.concatenate(x) for x in zip(*map(unpacked, places)))
    order = np.lexsort((start, part, doc))
    return doc[order], part[order], start[order], order


def _covered(tasks: int):
    """Of the entries of one bucket: the places that an earlier place has already, packed for each task that merges them."""

    def run(entries: pa.Table) -> pa.Table:
        doc, part, start, order = _ordered(entries.column("places").to_pylist())
        if entries.column("bucket")[0].as_py() >= 0:
            key = np.concatenate([np.frombuffer(h, "<u8") for h in entries.column("hashes").to_pylist()])[order]
            later = _first_of(key) != np.arange(len(key))
            doc, part, start = doc[later], part[later], start[later]
        task = _task_of(doc, part, tasks)
        by_task = np.argsort(task, kind="stable")
        ends = np.searchsorted(task[by_task], np.arange(tasks + 1))
        filled = np.flatnonzero(np.diff(ends))
        places = [packed(doc[at], part[at], start[at]) for at in (by_task[ends[p] : ends[p + 1]] for p in filled)]
        return pa.table({"task": pa.array(filled.astype(np.int64)), "places": pa.array(places, pa.binary())})

    return run


def _merged(entries: pa.Table) -> pa.Table:
    """The covered places of the documents of one task, one row per document."""
    doc, part, start, _ = _ordered(entries.column("places").to_pylist())
    change = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]))
    offsets = pa.array(np.append(change, len(doc)).astype(np.int32))
    places = pa.ListArray.from_arrays(offsets, pa.array(start.astype(np.int32)))
    return pa.table({"doc_id": doc[change].astype(np.int64), "part": part[change].astype(np.int64), "starts": places})


def repeated_windows(docs: DataFrame, octets: int, window: int = 20) -> DataFrame:
    """Places whose words stand earlier too: doc_id, part, starts (array of word positions).

    ``docs`` has doc_id, part and text; no two rows agree in doc_id and part. ``octets`` is the size of all texts.
    """
    buckets = max(1, round(octets / 6 / BUCKET_WINDOWS))  # a word with its space has six bytes or more in most texts
    sent = docs.select("doc_id", "part", "text").mapInArrow(_hashed(window, buckets), "bucket int, hashes binary, places binary")
    # Only windows that repeat are merged, so half as many tasks do.
    covered = sent.groupBy("bucket").applyInArrow(_covered(-(-buckets // 2)), "task long, places binary")
    return covered.groupBy("task").applyInArrow(_merged, "doc_id long, part long, starts array<int>")


def _distinct(docs: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows (doc_id, part, text), one for each different text of an id; how often each of them is repeated (doc_id,
    part, more), None if no id is; and the size of all texts.

    ``part`` is 0 where an id has one text, else the text's hash.
    """
    tag = F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    ids = stored(own.select("doc_id", tag, F.octet_length("text").alias("octets")))
    octets = ids.agg(F.sum("octets")).first()[0] or 0
    several = ids.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("tag") < F.max("tag")).alias("differ")).where("n > 1")
    several = stored(several.drop("n"))
    if several.isEmpty():
        return own.select("doc_id", F.lit(0).cast("long").alias("part"), "text"), None, octets
    part = F.when(F.col("differ"), F.col("tag")).otherwise(0).cast("long").alias("part")
    repeats = ids.groupBy("doc_id", "tag").agg((F.count("*") - 1).alias("more")).where("more > 0").join(several, "doc_id")
    repeats = stored(repeats.select("doc_id", "tag", part, "more"))
    rows = own.select("*", tag).join(several, "doc_id", "left").select("doc_id", part, "tag", "text")
    single = rows.join(repeats, ["doc_id", "tag"], "left_anti").select("doc_id", "part", "text")
    once = rows.join(repeats, ["doc_id", "tag"], "left_semi").groupBy("doc_id", "part").agg(F.first("text").alias("text"))
    return stored(single.unionByName(once)), repeats.drop("tag"), octets


def intervals(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals (begin, end) that the windows at sorted ``starts`` cover."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(starts[1:] > starts[:-1] + window) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + window


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, removed (array of begin and end word positions) and kept_text.

    Words are maximal runs without white space, unchanged; the kept ones are joined by one space. A null text has no
    words. A document of fewer than ``window`` words loses none. Ids are long; a null id is an id below all others. Rows
    that agree in id but not in text are documents in order of their texts' hashes; of equal rows one counts as the
    first, and the others repeat it. An empty table stays empty.
    """
    own, repeats, octets = _distinct(docs)
    places = repeated_windows(own, octets, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, rows = batch.slice(at, 256), []
                for doc, part, text, starts in zip(*(some.column(i).to_pylist() for i in range(3)), some.column(3)):
                    words = (text or "").encode().split()
                    found = np.unique(np.asarray(starts.values, np.int64)) if starts.is_valid else np.zeros(0, np.int64)
                    begins, ends = intervals(found, window)
                    kept, last = [], 0
                    for b, e in zip(begins.tolist(), ends.tolist()):
                        kept += words[last:b]
                        last = e
                    kept += words[last:]
                    spans = np.stack([begins, ends], 1).ravel().tolist()
                    rows.append((doc, part, len(words), len(words) - len(kept), spans, b" ".join(kept).decode()))
                kinds = (*(pa.int64(),) * 4, pa.list_(pa.int32()), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "n_words", "n_removed", "removed", "kept_text"])

    found = own.join(places, ["doc_id", "part"], "left").mapInArrow(
        cut, "doc_id long, part long, n_words long, n_removed long, removed array<int>, kept_text string"
    )
    if repeats:
        found = stored(found)
        again = found.join(repeats, ["doc_id", "part"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "more")))
        gone, n = F.col("n_words") >= window, F.col("n_words").cast("int")
        removed = F.when(gone, F.array(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
        again = again.select(
            "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"), removed.alias("removed"),
            F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        )
        found = found.drop("part").unionByName(again)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))).drop("part")


def kept_digests(docs: DataFrame, window: int = 20) -> DataFrame:
    """The result of :func:`without_repeats` with the SHA-256 of the kept text instead of the text."""
    return without_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
