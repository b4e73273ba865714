"""Language identification: nearest of several clustered centroids per language, over TF-IDF vectors of character n-grams.

1. Document frequencies of hashed n-grams are counted over all training rows (one array of ``SLOTS`` counts for each
   task, summed).
2. The normalised TF-IDF vectors of a bounded sample of training rows are clustered by spherical k-means within each
   language; a language has up to ``CENTROIDS`` unit centroids.
3. A text gets the language of the centroid with the largest cosine. It is rejected if that cosine lies below the
   threshold, which is a low quantile of the sample's own cosines, lowered by a margin, or if it has no letter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash

SLOTS, CENTROIDS = 2**14, 4
#: Training rows for each language that centroids are fitted on at most: the first by the hash of their id and text.
FIT_ROWS = 400
#: A text is rejected below (this share of the smallest 0.5 % cosine of the fitted rows).
REJECT_SHARE = 0.3
#: What a letter is, for fitting and predicting alike.
LETTER = r"\p{L}"
_OTHER = re.compile(r"[\W\d_]+")
#: Fixed odd multipliers of the n-gram hash.
MULTIPLIERS = (2654435761, 2246822519, 3266489917)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(LETTER), F.lit(False))


def grams(text: str) -> np.ndarray:
    """Slots of the character 1- to 3-grams of the lower-cased whole text; a run of other characters than letters is one space."""
    c = np.frombuffer(_OTHER.sub(" ", f" {text.lower()} ").encode("utf-32-le"), "<u4").astype(np.uint64)
    one, two, three = (np.uint64(m) for m in MULTIPLIERS)
    pairs = c[1:] * one + c[:-1] * two
    triples = pairs[1:] + c[:-2] * three
    codes = np.concatenate([c * one, pairs + np.uint64(1), triples + np.uint64(2)])
    codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (codes >> np.uint64(50)).astype(np.int64)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of the unit TF-IDF vector (1 + log of the count, times idf)."""
    counts = np.bincount(grams(text), minlength=SLOTS)
    slots = np.flatnonzero(counts)
    weights = (1 + np.log(counts[slots])) * idf[slots]
    norm = float(np.sqrt(weights @ weights))
    return slots, weights / norm if norm else weights


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, and the number of texts, over all rows of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                found[np.unique(grams(t.as_py() or ""))] += 1
                n += 1
        if n:
            slots = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1).astype(np.int32)), pa.array(np.append(found[slots], n))], ["slot", "n"])

    # At most SLOTS + 1 rows come back.
    total = rows.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    found, n = np.zeros(SLOTS, np.int64), 0
    for r in total:
        if r["slot"] < 0:
            n = r["n"]
        else:
            found[r["slot"]] = r["n"]
    return found, n


@dataclass
class LanguageModel:
    """Centroid ``i`` is column ``i`` of ``centroids`` and belongs to ``languages[owner[i]]``."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    reject_below: float

    def cosines(self, texts: list[str]) -> np.ndarray:
        """The largest cosine of each text (row) with each language (column)."""
        out = np.zeros((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            slots, weights = vector(text, self.idf)
            np.maximum.at(out[i], self.owner, weights @ self.centroids[slots])
        return out


def _clusters(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from spread-out first centroids."""
    first = [0]
    for _ in range(min(k, len(x)) - 1):
        first.append(int(np.argmin((x @ x[first].T).max(1))))
    centroids = x[first]
    for _ in range(rounds):
        own = np.argmax(x @ centroids.T, 1)
        sums = np.stack([x[own == j].sum(0) for j in range(len(centroids))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS, reject_share: float = REJECT_SHARE) -> LanguageModel:
    """Learns from columns doc_id, text, lang. Rows without a language or without a letter are not learned from.

    A null id is an id. Repeated rows count as often as they stand. Without rows the model knows no language.
    """
    rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("doc_id", "text", "lang")
    found, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + found)) + 1
    picked = first_by_hash(rows, "lang", ["doc_id", "text"], fit_rows, ["lang", "text"])
    by_lang: dict[str, list[str]] = {}
    for r in picked:
        by_lang.setdefault(r["lang"], []).append(r["text"])
    languages, owner, columns, own = sorted(by_lang), [], [], []
    for i, lang in enumerate(languages):
        x = np.zeros((len(by_lang[lang]), SLOTS))
        for j, text in enumerate(sorted(by_lang[lang])):
            slots, weights = vector(text, idf)
            x[j, slots] = weights
        c = _clusters(x, centroids)
        own.append((x @ c.T).max(1))
        columns.append(c)
        owner += [i] * len(c)
    low = float(np.quantile(np.concatenate(own), 0.005)) if own else 0.0
    matrix = np.concatenate(columns).T.copy() if columns else np.zeros((SLOTS, 0))
    return LanguageModel(languages, np.array(owner, np.int64), matrix, idf, reject_share * low)


def languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected.

    The score is the cosine with the nearest centroid, from 0 to 1. ``und`` with score 0 stands for a null text, one
    without a letter, or a model without languages; these are rejected, and so is a text far from every centroid. A tie
    goes to the first language by code point. Repeated rows are predicted each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x (languages x CENTROIDS) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = some.column(1).to_pylist()
                known = [bool(m.languages) and letter for letter in some.column(2).to_pylist()]
                cos = iter(m.cosines([t for t, k in zip(texts, known) if k]))
                rows = [next(cos) if k else None for k in known]
                pred = ["und" if r is None else m.languages[int(r.argmax())] for r in rows]
                score = [0.0 if r is None else min(1.0, max(0.0, float(r.max()))) for r in rows]
                far = [r is None or s < m.reject_below for r, s in zip(rows, score)]
                columns = [some.column(0), pa.array(pred), pa.array(score), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), has_letter(F.col(text_col)))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def drop_unknown_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns unchanged; no shuffle.

    A null text, one without a letter and, with a model without languages, every text is rejected. Repeated rows are
    decided alike. An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            keep = [bool(m.languages) and float(m.cosines([t.as_py()]).max()) >= m.reject_below for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.where(has_letter(F.col("text"))).mapInArrow(run, docs.schema)
