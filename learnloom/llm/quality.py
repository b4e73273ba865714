"""Document quality from lines: a linear-chain conditional random field marks every line good or bad.

A line's score for "good" is linear in features of its own and of the neighbouring lines; neighbouring states are tied
by a 2 x 2 table. Forward-backward gives the probability of each line's state in its document, and the mean of these,
weighted by the lines' lengths, is the document's quality.

Labels exist for documents only. Lines first get their document's label; a first field is trained, lines of bad
documents that it finds good are relabelled (the worst line always stays bad), and the final field is trained on those.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the field is fitted on at most: the first by the hash of their id.
FIT_ROWS = 3000
THRESHOLD = 0.3

#: Bytes of each class that line features count.
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SENTENCE = b" \t\r\v\f.,;:'\"?-()"
_SYMBOLS = bytes(i for i in range(33, 127) if not chr(i).isalnum() and i not in _SENTENCE)
_RUN = re.compile(rb"[^\w\s.,;:'\"\x80-\xff]{2,}")
OWN = ("length", "upper", "digits", "symbols", "runs", "word length", "repeated words", "equal neighbours", "bare marks", "repeated line", "full stop")
NEAR = (1, 3, 4, 6, 9)  # the features that neighbours lend
WIDTH = 1 + len(OWN) + 2 * len(NEAR)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features [lines, WIDTH] and lengths of all lines of the whole text; an empty text is one empty line."""
    lines = (text or "").encode().split(b"\n")
    seen = Counter(lines) if len(lines) > 1 else {}
    own = np.zeros((len(lines), len(OWN)))
    for i, line in enumerate(lines):
        n = len(line)
        if not n:
            continue
        words = line.split()
        k = max(1, len(words))
        own[i] = (
            math.log1p(n) / 8,
            (n - len(line.translate(None, _UPPER))) / n,
            (n - len(line.translate(None, _DIGITS))) / n,
            (n - len(line.translate(None, _SYMBOLS))) / n,
            min(1.0, len(_RUN.findall(line)) / k),
            min(3.0, n / k / 10),
            (1 - len(set(words)) / k) * min(1.0, k / 20),
            sum(map(eq, words, words[1:])) / k,
            sum(len(w) == 1 and not w.isalnum() for w in words) / k if b"|" in line or b"*" in line or b"-" in line else 0.0,
            float(bool(seen) and seen[line] > 1),
            float(words[-1][-1:] in b".!?") if words else 0.0,
        )
    own = np.minimum(own, 3)
    near = own[:, NEAR]
    zero = np.zeros((1, len(NEAR)))
    x = np.concatenate([np.ones((len(lines), 1)), own, np.concatenate([zero, near[:-1]]), np.concatenate([near[1:], zero])], 1)
    return x, np.array([len(line) for line in lines], np.float64)


def _passed(a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log odds that a line in state odds ``a`` passes to its neighbour by the table ``t`` [from, to] (1: good)."""
    return np.logaddexp(t[1, 1] + a, t[0, 1]) - np.logaddexp(t[1, 0] + a, t[0, 0])


@dataclass
class LineField:
    """Weights of the features for "good" and the table of neighbouring states [before, after]."""

    weights: np.ndarray
    table: np.ndarray

    def messages(self, scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of each line from the lines up to it, and from the lines after it, for many documents at once.

        Documents stand in falling order of size, so at step ``i`` the first of them still have a line ``i``.
        """
        ahead, behind = scores.copy(), np.zeros_like(scores)
        alive = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), "left")
        for i in range(1, len(alive)):
            at = begins[: alive[i]] + i
            ahead[at] += _passed(ahead[at - 1], self.table)
        for i in range(len(alive) - 1, 0, -1):
            at = begins[: alive[i]] + i
            behind[at - 1] = _passed(scores[at] + behind[at], self.table.T)
        return ahead, behind

    def marginals(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability that each line is good; ``sizes`` are the line counts of the documents, one after another."""
        order, begins = _ordered(sizes)
        ahead, behind = self.messages(x @ self.weights, begins[order], sizes[order])
        return 1 / (1 + np.exp(-np.clip(ahead + behind, -60, 60)))


def _ordered(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.argsort(-sizes, kind="stable"), np.cumsum(sizes) - sizes


def fit_field(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 150, rate: float = 0.3) -> LineField:
    """Maximises the conditional likelihood of line states ``y``; ``share`` weighs each line's document. Adam, ridge 1e-3."""
    order, begins = _ordered(sizes)
    follow = np.setdiff1d(np.arange(len(x)), begins)
    field = LineField(np.zeros(x.shape[1]), np.zeros((2, 2)))
    moment, square = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    total = share.sum()
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[follow - 1], y[follow]), share[follow])
    for step in range(1, steps + 1):
        scores = x @ field.weights
        ahead, behind = field.messages(scores, begins[order], sizes[order])
        p = 1 / (1 + np.exp(-np.clip(ahead + behind, -60, 60)))
        grad = x.T @ (share * (y - p))
        joint = np.zeros((len(follow), 2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint[:, a, b] = a * ahead[follow - 1] + field.table[a, b] + b * (scores[follow] + behind[follow])
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        joint /= joint.sum((1, 2), keepdims=True)
        expected = (share[follow][:, None, None] * joint).sum(0)
        g = np.concatenate([grad, (seen - expected).ravel()]) / total
        g -= 1e-3 * np.concatenate([field.weights, field.table.ravel()])
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        field = LineField(field.weights + move[:-4], field.table + move[-4:].reshape(2, 2))
    return field


def fit_on_documents(texts: list[str | None], labels: list[int]) -> LineField:
    """The final field for documents with labels 0 and 1."""
    found = [line_features(t) for t in texts]
    sizes = np.array([len(x) for x, _ in found])
    x = np.concatenate([f[0] for f in found])
    label = np.repeat(np.array(labels), sizes)
    # Documents count alike, however many lines they have, and both labels together alike.
    share = 1 / np.repeat(sizes, sizes) ** 0.5
    for v in (0, 1):
        if (label == v).any():
            share[label == v] /= share[label == v].sum()
    first = fit_field(x, sizes, label, share)
    good = first.marginals(x, sizes)
    begins = np.cumsum(sizes) - sizes
    worst = np.repeat(np.minimum.reduceat(good, begins), sizes) == good
    states = np.where(label == 1, 1, np.where(worst, 0, good > 0.5)).astype(int)
    return fit_field(x, sizes, states, share)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> LineField | None:
    """Learns from the rows of ``labels`` (doc_id, quality), at most ``fit_rows``; None if there are none.

    Of several labels of an id the lowest counts, of several texts of it the first by hash. Null ids and null labels
    are not learned from.
    """
    some = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    # At most one text for each of the picked ids.
    first = F.min(F.struct(F.xxhash64("text").alias("order"), "text")).alias("first")
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(first)
    rows = rows.select("first.text", "quality").collect()
    rows.sort(key=lambda r: (r["text"] or "", r["quality"]))
    return fit_on_documents([r["text"] for r in rows], [r["quality"] for r in rows]) if rows else None


def document_scores(docs: DataFrame, field: LineField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, n_lines, bad_lines.

    The score is the length-weighted mean of its lines' probabilities of being good, from 0 to 1. A null text is the
    empty text, which is one empty line; a null id stays null. Without a field every score is 0.5. Repeated rows are
    scored each, long texts whole. An empty table stays empty; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [line_features(t) for t in some.column(1).to_pylist()]
                sizes = np.array([len(x) for x, _ in found])
                x, lengths = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                good = field.marginals(x, sizes) if field else np.full(len(x), 0.5)
                begins, weight = np.cumsum(sizes) - sizes, lengths + 1e-6
                score = np.add.reduceat(good * weight, begins) / np.add.reduceat(weight, begins)
                bad = np.add.reduceat((good < 0.5).astype(np.int64), begins)
                columns = [some.column(0), pa.array(np.clip(score, 0, 1)), pa.array(sizes.astype(np.int32)), pa.array(bad.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_lines", "bad_lines"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, score double, n_lines int, bad_lines int")
