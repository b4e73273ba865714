"""SimHash fingerprints, and near-duplicate groups by bit-sliced comparison.

Fingerprints within ``radius`` bits agree on at least one choice of ``m - radius`` of ``m`` bit ranges, so comparing
those that share such a choice loses no pair. With six ranges there are 15 choices of 21 bits or so, the same for any
number of fingerprints, so rows grow with the input and buckets stay small up to billions. Equal fingerprints are one
entry. A bucket larger than a block is dealt as pairs of blocks, so that a large group of near
copies is compared by many tasks.

Inside a task fingerprints lie in bit planes: a word of plane ``p`` holds bit ``p`` of 64 fingerprints of one bucket. A
query is compared with 64 fingerprints by one exclusive-or for each plane, and carry-save counters (ones, twos, fours
and so on, and a mark for an overflow) add the differing bits of all 64 at once. Words in which every lane has passed the
radius are abandoned along the way.

``drop_similar`` links by the Jaccard similarity of shingle sets. At 0.8 two fingerprints differ in 15 % of their bits,
10 of 64 on average, so bit ranges cannot bring all pairs together. Wide fingerprints of ``WORDS`` words do: each of
``TABLES`` tables puts those together that agree in ``KEY_BITS`` fixed bits of the later words; the bit planes of the first
word compare them within ``WIDE_RADIUS`` bits, and the second word must agree as well. In simulation 99.4 % of the pairs at
0.8 and all of those at 0.85 are close in this sense. Close ones are connected by trees; then blocks of each
connected group hold the shingle sets themselves against each other, inside a task, and give a tree of what is similar. So
no pairs travel, and no link between close texts is lost. A bucket holds about n / 2^16 unrelated entries, so comparisons
are linear in practice up to some 10^8 entries; beyond that raise ``KEY_BITS``, and ``TABLES`` by a sixth for each bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_name, shuffle_partitions, stored

SEED, SHINGLE, RADIUS = 42, 4, 4
#: The link by similarity: words of a shingle, and the least Jaccard similarity as a fraction.
SIMILAR_SHINGLE, SIMILARITY = 5, (4, 5)
#: Words of a wide fingerprint, and the largest number of differing bits of the first word, and of the first two together.
WORDS, WIDE_RADIUS, BOTH_RADIUS = 10, 18, 32
TABLES, KEY_BITS = 96, 16
#: Shingles of a block of sets that one task holds against another block.
BLOCK_SHINGLES = 65_536
#: Fingerprints of one bucket that are compared with each other by one task.
BLOCK = 512
#: Bit ranges (``m``).
RANGES = 6
#: (query, word) pairs that are compared at a time.
SLAB = 16_384
FULL = np.uint64(2**64 - 1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 of all word shingles, repeats included; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", max(1, len(words) - shingle + 1))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of all word shingles, as an unsigned integer; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    return int(_majority(hashes[:, None])[0]) if len(hashes) else 0


def _majority(hashes: np.ndarray) -> np.ndarray:
    """For each column of 64-bit words: the bits that are set in over half of the rows."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 255):  # so that the counts of a part fit in a byte
        some = np.ascontiguousarray(hashes[at : at + 255]).view(np.uint8)
        ones += np.add.reduce(np.unpackbits(some, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, fp (the fingerprint as a signed long) and text_hash. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            columns = [batch.column(0), pa.array(found.view(np.int64)), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "text_hash"])

    text = F.col(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return own.mapInArrow(run, "doc_id long, fp long, text_hash long")


def bit_ranges(m: int, bits: int = 64) -> list[int]:
    """Masks of ``m`` ranges that cover all bits."""
    ends = [round(i * bits / m) for i in range(m + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]


def table_masks(radius: int = RADIUS, ranges: int = RANGES) -> list[int]:
    """Masks of the bit choices: any two fingerprints within the radius agree on all bits of at least one."""
    m = max(ranges, radius + 1)
    return [sum(c) for c in combinations(bit_ranges(m), m - radius)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def planes_of(fps: np.ndarray, lane: np.ndarray, words: int) -> np.ndarray:
    """Bit planes [64, words]: fingerprint ``i`` in lane ``lane[i]``, counted over all words."""
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[lane] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, queries: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a query fingerprint and a word: (pair, lanes as bits) of those words with a lane within the radius.

    ``valid`` masks the lanes of each word that hold a fingerprint.
    """
    pair = np.arange(len(word))
    counters = [np.zeros(len(word), np.uint64) for _ in range(radius.bit_length())]  # ones, twos, fours, ...
    more = np.zeros(len(word), np.uint64)
    for p in range(64):
        carry = planes[p][word] ^ (np.uint64(0) - ((queries >> np.uint64(p)) & np.uint64(1)))
        for c in counters:
            carry, c[:] = c & carry, c ^ carry
        more |= carry
        if p in (23, 31, 39, 47, 55, 63):
            alive = np.flatnonzero(~_beyond(counters, more, radius) & valid[word])
            if len(alive) < len(pair):
                pair, word, queries, more = pair[alive], word[alive], queries[alive], more[alive]
                counters = [c[alive] for c in counters]
            if not len(pair):
                break
    return pair, ~_beyond(counters, more, radius) & valid[word]


def _beyond(counters: list[np.ndarray], more: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is larger than the radius, by comparing the counter's bits from the highest."""
    out, equal = more.copy(), ~more
    for bit, counter in reversed(list(enumerate(counters))):
        if radius >> bit & 1:
            equal &= counter
        else:
            out |= equal & counter
            equal &= ~counter
    return out


def near_pairs(fps: np.ndarray, begins: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of fingerprints of the same group within the radius; groups begin at ``begins``."""
    sizes = np.diff(np.append(begins, len(fps)))
    words_of = -(-sizes // 64)
    first_word = np.concatenate([[0], np.cumsum(words_of)])
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane = first_word[group] * 64 + np.arange(len(fps)) - begins[group]
    at_lane = np.zeros(int(first_word[-1]) * 64, np.int64)
    at_lane[lane] = np.arange(len(fps))
    planes = planes_of(fps, lane, int(first_word[-1]))
    valid = np.zeros(len(at_lane), np.uint8)
    valid[lane] = 1
    valid = np.packbits(valid, bitorder="little").view("<u8")
    # A query meets the words of its group from its own word on.
    todo = first_word[group + 1] - lane // 64
    query = np.repeat(np.arange(len(fps)), todo)
    word = np.arange(len(query)) - np.repeat(np.cumsum(todo) - todo, todo) + np.repeat(lane // 64, todo)
    left, right = [], []
    for k in range(0, len(query), SLAB):
        q, w = query[k : k + SLAB], word[k : k + SLAB]
        pair, lanes = within(planes, fps[q], w, valid, radius)
        hit, bit = np.nonzero(np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = q[pair[hit]], at_lane[w[pair[hit]] * 64 + bit]
        left.append(i[i < j])
        right.append(j[i < j])
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each position is connected to, by passing minima along the pairs."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted rows, a table for each run of batches that ends with a group of the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([c.to_numpy() for c in batch.columns[:keys]], 1)
        last = int(np.flatnonzero((now != now[-1]).any(1))[-1]) + 1 if (now != now[-1]).any() else 0
        before = held and [c[0].as_py() for c in held[-1].slice(held[-1].num_rows - 1).columns[:keys]] != now[0].tolist()
        if before:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _begins(keys: list[np.ndarray]) -> np.ndarray:
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _edges_of(radius: int, both_radius: int | None):
    """Reads rows (t, v, block, fp, code, more) sorted by bucket and sends one edge for each entry connected to a smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups_of(batches, 3):
            t, v, block, fps, code, more = (c.to_numpy() for c in rows.columns)
            begins = _begins([t, v, block])
            # Entries that are alone in their bucket are left out.
            several = np.repeat(np.diff(np.append(begins, len(fps))) > 1, np.diff(np.append(begins, len(fps))))
            t, v, block, fps, code, more = (x[several] for x in (t, v, block, fps, code, more))
            i, j = near_pairs(code.view(np.uint64), _begins([t, v, block]), radius)
            if both_radius is not None:
                x, y = code.view(np.uint64), more.view(np.uint64)
                good = np.bitwise_count(x[i] ^ x[j]).astype(int) + np.bitwise_count(y[i] ^ y[j]) <= both_radius
                i, j = i[good], j[good]
            root = forest(len(fps), i, j)
            child = np.flatnonzero(root != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[child]), pa.array(fps[root[child]])], ["a", "b"])

    return run


def _edges_in_buckets(rows: DataFrame, radius: int, both_radius: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the close entries of each bucket of ``rows``: t, v (the bucket), fp, code and more (what is compared).

    A bucket larger than a block is dealt as pairs of blocks. Close are codes within ``radius`` bits and, if
    ``both_radius`` is given, codes and mores together within that.
    """
    large = rows.groupBy("t", "v").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = large.select("t", "v", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    own, other = F.pmod(F.xxhash64("fp"), blocks).cast("int"), F.col("other")
    low, high = F.least("own", other), F.greatest("own", other)
    dealt = (
        rows.join(stored(large), ["t", "v"], "left")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("t", "v", (low.cast("long") * 2**31 + high).alias("block"), "fp", "code", "more")
        .repartition(shuffle_partitions(rows.sparkSession), "t", "v", "block")
        .sortWithinPartitions("t", "v", "block", "fp")
    )
    return dealt.mapInArrow(_edges_of(radius, both_radius), "a long, b long")


def near_edges(entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between different fingerprints that connect all those within ``radius`` bits of each other.

    ``entries`` has one row for each different fingerprint: fp. Every pair within the radius is found; a group of
    close ones is returned as a tree and not as all its pairs.
    """
    masks = table_masks(radius)
    choices = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("v")) for t, m in enumerate(masks)])
    rows = entries.select("fp", F.col("fp").alias("code"), F.lit(0).cast("long").alias("more"), F.inline(choices))
    return _edges_in_buckets(rows.select("t", "v", "fp", "code", "more"), radius)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept.

    Documents link if their fingerprints differ in ``radius`` bits or fewer; component_id is the smallest doc_id
    reachable, itself included, and kept marks the document with it. Documents without words have fingerprint zero and
    link like any other. A null id is larger than any other. Repeated rows are kept each. An empty table stays empty.
    """
    prints = stored(fingerprints(docs, shingle))
    groups = _groups(prints, lambda entries: near_edges(entries, radius))
    return prints.join(groups, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _groups(prints: DataFrame, edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For each different fp: the smallest doc_id of its component by the edges (a, b) of the entries."""
    entries = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(edges_of(entries))
    linked = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = stored(linked.select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = stored(linked.groupBy("root").agg(F.min("low").alias("component_id")))
    return stored(linked.join(lowest, "root").select("fp", "component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component (that with the smallest id), columns unchanged.

    Of repeated rows of that id each stays.
    """
    prints = stored(fingerprints(docs, shingle))
    return _without(docs, prints, _groups(prints, lambda entries: near_edges(entries, radius)))


def _without(docs: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those whose row of ``prints`` (doc_id, fp, text_hash) isn't the first of its group."""
    gone = prints.join(groups, "fp").where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    row = F.struct(F.col("doc_id").cast("long").alias("id"), F.col("text_hash").alias("text"))
    key = free_name(docs, "row_key")
    gone = stored(gone.select(row.alias(key)).distinct())
    own = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text"))
    return docs.withColumn(key, own).join(gone, key, "left_anti").select(*docs.columns)


#: Fixed by the seed: multipliers and summands that spread a shingle's hash over the words, and the bits of each table.
_RNG = np.random.default_rng(SEED)
_ODD, _ADD = _RNG.integers(0, 2**64, (2, WORDS), np.uint64) | np.uint64(1)
_TABLE_BITS = np.stack([_RNG.choice(64 * (WORDS - 2), KEY_BITS, replace=False) for _ in range(TABLES)])


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The majority words of a set of shingle hashes, each spread over ``WORDS`` words; zeros for the empty set."""
    if not len(shingles):
        return np.zeros(WORDS, np.uint64)
    spread = shingles[:, None] * _ODD + _ADD
    spread = (spread ^ (spread >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return _majority(spread ^ (spread >> np.uint64(32)))


def table_keys(words: np.ndarray) -> np.ndarray:
    """The buckets [entries, TABLES] of wide fingerprints [entries, WORDS]."""
    out = np.empty((len(words), TABLES), np.int32)
    for at in range(0, len(words), 1024):
        bits = np.unpackbits(np.ascontiguousarray(words[at : at + 1024, 2:]).view(np.uint8), axis=1, bitorder="little")
        out[at : at + 1024] = bits[:, _TABLE_BITS].astype(np.int32) @ (1 << np.arange(KEY_BITS, dtype=np.int32))
    return out


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def _digest(shingles: np.ndarray) -> int:
    """One number for a set; 0 for the empty one."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) if len(shingles) else 0


def _longs(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))


def _sets(docs: DataFrame, of: Callable[[np.ndarray], np.ndarray], name: str, shingle: int) -> DataFrame:
    """Columns doc_id, fp (the digest of the shingle set), text_hash, and ``of(set)`` as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
                fps = pa.array(np.array([_digest(s) for s in found], np.uint64).view(np.int64))
                columns = [batch.column(0), fps, batch.column(2), _longs([of(s) for s in found])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "text_hash", name])

    return docs.mapInArrow(run, f"doc_id long, fp long, text_hash long, {name} array<long>")


def _tables(entries: DataFrame) -> DataFrame:
    """Columns fp, code and more (the first two words) and keys (its bucket in each table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([np.array(w, np.int64) for w in batch.column(1).to_pylist()]) if batch.num_rows else np.zeros((0, WORDS), np.int64)
            keys = table_keys(words.view(np.uint64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * TABLES), pa.array(keys.ravel()))
            columns = [batch.column(0), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["fp", "code", "more", "keys"])

    return entries.select("fp", "words").mapInArrow(run, "fp long, code long, more long, keys array<int>")


def similar_sets(left: list[np.ndarray], right: list[np.ndarray], slab: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of a left and a right set whose Jaccard similarity is ``SIMILARITY`` or more.

    Common shingles are counted for a slab of left sets at a time, by way of the right sets that hold each shingle. A slab
    has at most ``slab`` of them, and of pairs, unless one left set has more.
    """
    part, whole = SIMILARITY
    a, b = (np.array([len(s) for s in sets]) for sets in (left, right))
    owner, flat = np.repeat(np.arange(len(right)), b), np.concatenate(right)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    begins = [np.searchsorted(flat, s, "left") for s in left]
    counts = [np.searchsorted(flat, s, "right") - at for s, at in zip(left, begins)]
    meets = np.cumsum([0] + [int(c.sum()) for c in counts])
    at = 0
    while at < len(left):
        end = min(int(np.searchsorted(meets, meets[at] + slab, "right")) - 1, at + slab // len(right))
        end = max(at + 1, end)
        n, first = np.concatenate(counts[at:end]), np.concatenate(begins[at:end])
        row = np.repeat(np.repeat(np.arange(end - at), a[at:end]), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        both = np.bincount(row * len(right) + owner[place], minlength=(end - at) * len(right)).reshape(end - at, -1)
        i, j = np.nonzero(both * whole >= part * (a[at:end, None] + b[None, :] - both))
        found.append((i + at, j))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))


def _similar_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows (root, low, high, own, fp, shingles) sorted by pair of blocks and sends a tree of the similar sets of each."""
    for rows in _groups_of(batches, 3):
        root, low, high, own, fps = (rows.column(c).to_numpy() for c in range(5))
        begins = _begins([root, low, high])
        for begin, end in zip(begins, [*begins[1:], len(fps)]):
            sets = [np.asarray(x.values).view(np.uint64) for x in rows.column(5).slice(begin, end - begin)]
            left, right = np.flatnonzero(own[begin:end] == low[begin]), np.flatnonzero(own[begin:end] == high[begin])
            if not len(left) or not len(right):
                continue
            i, j = similar_sets([sets[k] for k in left], [sets[k] for k in right])
            tree = forest(end - begin, left[i], right[j])
            child = np.flatnonzero(tree != np.arange(end - begin))
            here = fps[begin:end]
            yield pa.RecordBatch.from_arrays([pa.array(here[child]), pa.array(here[tree[child]])], ["a", "b"])


def similar_edges(docs: DataFrame, prints: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """Edges (a, b) that connect all entries that a similarity of ``SIMILARITY`` connects, among those that are close.

    ``docs`` has doc_id, text and text_hash; ``prints`` doc_id, fp, text_hash and words.
    """
    entries = stored(prints.groupBy("fp").agg(F.first("words").alias("words"), F.min("text_hash").alias("text_hash")))
    tables = stored(_tables(entries))
    rows = tables.select("fp", "code", "more", F.posexplode("keys").alias("t", "v")).select("t", F.col("v").cast("long").alias("v"), "fp", "code", "more")
    groups = stored(connected_components(_edges_in_buckets(rows, WIDE_RADIUS, BOTH_RADIUS).distinct()).withColumnRenamed("node", "fp"))
    texts = entries.join(groups, "fp", "left_semi").select("text_hash").distinct()
    sets = _sets(docs.join(texts, "text_hash", "left_semi").select("doc_id", "text", "text_hash"), lambda s: s, "shingles", shingle)
    sets = stored(sets.groupBy("fp").agg(F.first("shingles").alias("shingles")).join(groups, "fp"))
    sizes = sets.groupBy("root").agg(F.ceil(F.sum(F.size("shingles")) / BLOCK_SHINGLES).cast("int").alias("blocks"))
    blocks, other = F.greatest(F.col("blocks"), F.lit(1)), F.col("other")
    dealt = (
        sets.join(stored(sizes), "root")
        .withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("root", F.least("own", other).alias("low"), F.greatest("own", other).alias("high"), "own", "fp", "shingles")
        .repartition(shuffle_partitions(docs.sparkSession), "root", "low", "high")
        .sortWithinPartitions("root", "low", "high", "fp")
    )
    return dealt.mapInArrow(_similar_of, "a long, b long")


def drop_similar(docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component (that with the smallest id), columns unchanged.

    Documents link at a Jaccard similarity of 0.8 or more of their sets of shingles of lower-cased words. Documents
    without words (null texts among them) are one component. A null id is larger than any other. Of repeated rows of
    the smallest id each stays. An empty table stays empty.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    prints = stored(_sets(own, wide_fingerprint, "words", shingle))
    return _without(docs, prints, _groups(prints, lambda _: similar_edges(own, prints, shingle)))
