"""Ranked lexical search the other way round: items are the index, documents stream through it.

The items' terms form an inverted index, which is broadcast; its size is checked, and more items go in several blocks. One
pass over the documents cuts each whole text into terms once and keeps what the index knows: the document's length and
the counts of its known terms. Their frequencies over all documents give the weights. A second pass streams these counts
through the index, adds up a score for each item that a document meets, and updates the items' heaps of ``k`` documents.
Heaps are merged in two steps, so that no task gets those of all partitions.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

K = 10
#: Bytes of item texts whose index is broadcast at a time; the index takes some ten times as much.
ITEM_BYTES = 4 * 2**20
#: Documents scored at a time are limited so that they have at most so many scores.
SCORES = 2_000_000
#: Heaps of this many partitions are merged first.
PARTS = 64
NONE = 2**63 - 1
_KEPT = {c: c + 32 if 65 <= c <= 90 else c for c in range(256) if c >= 128 or chr(c).isalnum()}
_TABLE = bytes(_KEPT.get(c, 32) for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: runs of ASCII letters and digits and of any characters beyond ASCII, A-Z in lower case."""
    return text.translate(_TABLE).split() if text else []


class Index:
    """Which items hold each term, as lists one after another; items are numbered in the order given."""

    def __init__(self, items: list[tuple[int, bytes | None]]):
        self.ids = [i for i, _ in items]
        found: dict[bytes, list[int]] = {}
        for n, (_, text) in enumerate(items):
            for term in set(terms(text)):
                found.setdefault(term, []).append(n)
        self.number = {t: i for i, t in enumerate(sorted(found))}
        lists = [found[t] for t in self.number]
        self.begins = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        self.items = np.array([n for x in lists for n in x], np.int64)


def item_blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, bytes | None]]]:
    """Items in blocks of about ``limit`` bytes of text, one block at a time on the driver; null ids and texts are left out."""
    kept = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")
    )
    total = kept.agg(F.sum(F.octet_length("text"))).first()[0]
    if not total:
        return
    n = -(-total // limit)
    for k in range(n):
        rows = kept.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        yield sorted((r["id"], bytes(r["text"])) for r in rows)


def _counted(docs: DataFrame, index, id_col: str, text_col: str) -> DataFrame:
    """Columns doc_id, n, term (numbers, 32 bits each), tf (likewise) of documents with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.value.number.get
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(text.as_py())
                if words:
                    tf = Counter(map(get, words))
                    tf.pop(None, None)
                    rows.append((doc_id, len(words), np.array(list(tf), "<u4").tobytes(), np.array(list(tf.values()), "<u4").tobytes()))
            ids, n, term, count = zip(*rows) if rows else ((),) * 4
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(term, pa.binary()), pa.array(count, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "term", "tf"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, n long, term binary, tf binary")


def _frequencies(counted: DataFrame, n_terms: int) -> np.ndarray:
    """For each term of the index the number of documents that hold it; a task sends one row for each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    found = counted.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(n_terms, np.int64)
    for r in found:  # at most one row for each term of the index
        out[r["term"]] = r["df"]
    return out


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def length_term(n: list[int], n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m, in whole numbers of any size, which do not overflow on the way."""
    return np.array([10 + 90 * x * n_docs // n_terms for x in n], np.int64)


class Heaps:
    """For each item the best ``k`` documents so far: by score, then by ascending id (null last)."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(n_items, np.int64)  # a score below this cannot enter

    def update(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        some = score >= self.least[item]
        if not some.any():
            return
        item, doc, score = (np.concatenate(x) for x in zip((self.item, self.doc, self.score), (item[some], doc[some], score[some])))
        order = np.lexsort((doc, -score, item))
        begins = np.flatnonzero(np.diff(item[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
        order, place = order[place < self.k], place[place < self.k]
        self.item, self.doc, self.score = item[order], doc[order], score[order]
        last = place == self.k - 1
        self.least[self.item[last]] = self.score[last]


def _scored(counted: DataFrame, index, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The heaps of each partition: item_id, doc_id, score, part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, w = index.value, weights.value
        n_items, at_a_time = len(own.ids), max(1, SCORES // max(1, len(own.ids)))
        heaps = Heaps(n_items, k)
        for batch in batches:
            for part in (batch.slice(a, at_a_time) for a in range(0, batch.num_rows, at_a_time)):
                docs = part.column(0).fill_null(NONE).to_numpy()
                found = part.column(2).to_pylist()
                term = np.frombuffer(b"".join(found), "<u4").astype(np.int64)
                tf = np.frombuffer(b"".join(part.column(3).to_pylist()), "<u4").astype(np.int64)
                doc = np.repeat(np.arange(len(docs)), [len(x) // 4 for x in found])
                m = length_term(part.column(1).to_pylist(), n_docs, n_terms)
                gain = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                # Each known term of a document meets the items that hold it.
                many = own.begins[term + 1] - own.begins[term]
                ends = np.cumsum(many)
                item = own.items[np.repeat(own.begins[term] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
                total = np.zeros(len(docs) * n_items, np.int64)
                np.add.at(total, np.repeat(doc, many) * n_items + item, np.repeat(gain, many))
                met = np.flatnonzero(total)
                heaps.update(met % n_items, docs[met // n_items], total[met])
        ids = np.array(own.ids, np.int64)[heaps.item]
        documents = pa.array(heaps.doc, mask=heaps.doc == NONE)
        at = pa.array(np.full(len(ids), TaskContext.get().partitionId()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(heaps.item), pa.array(ids), documents, pa.array(heaps.score), at], ["item", "item_id", "doc_id", "score", "part"])

    return counted.mapInArrow(run, "item long, item_id long, doc_id long, score long, part long")


def ranked_documents(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank, doc_id, score; equal scores by ascending doc_id.

    A null or empty text has no terms: such documents do not count, and such items have no rows, nor has an item with a
    null id or whose terms no document holds. A null document id ranks after all others of its score. Repeated rows are
    documents, or items, of their own: ranks of a repeated item id repeat. Long texts are read whole. An empty table on
    either side gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    out = None
    for block, listed in enumerate(item_blocks(items, item_col, item_text_col, item_bytes)):
        heaps = _of_block(spark, docs, listed, k, id_col, text_col)
        heaps = heaps.withColumn("block", F.lit(block))
        out = heaps if out is None else out.unionByName(heaps)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out.select("item_id", "rank", "doc_id", "score")


def _of_block(spark: SparkSession, docs: DataFrame, items: list[tuple[int, bytes | None]], k: int, id_col: str, text_col: str) -> DataFrame:
    index = Index(items)
    shared = spark.sparkContext.broadcast(index)  # at most ITEM_BYTES of item texts
    counted = stored(_counted(docs, shared, id_col, text_col))
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = spark.sparkContext.broadcast(term_weights(_frequencies(counted, len(index.number)), n_docs))
    heaps = stored(_scored(counted, shared, weights, n_docs, n_terms, k))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for key in ([F.col("item"), F.col("part") % PARTS], [F.col("item")]):
        heaps = heaps.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
    return heaps
