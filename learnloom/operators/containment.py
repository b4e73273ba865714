"""Which terms occur in which texts: an Aho-Corasick automaton of the terms, or equi-joins on character grams.

Up to ``BROADCAST_TERMS`` terms are sent to the texts. Each worker builds an automaton of the terms that a text may hold
(those of its book, where terms belong to books) and reads every text once, whatever the number of terms; texts are
neither moved nor joined back. More terms are known by their rarest run of characters and meet the texts' runs by
exchange; candidates are tested. Both are exact. Keys may be null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..storage import stored
from .joins import matched

#: Terms that are sent to the texts at most, some 100 bytes each.
BROADCAST_TERMS = 500_000
#: Terms whose automata a worker keeps; beyond it those of other books are built again.
KEPT_TERMS = 200_000
#: Characters of a piece that a text is cut into, since the n-th character of a long text takes n steps to find.
PIECE = 256


class Automata:
    """An automaton for each group of terms, built when it is first asked for."""

    def __init__(self, groups: dict[tuple, list[str]]):
        self.groups, self.built, self.terms = groups, {}, 0

    def of(self, group: tuple):
        """(terms, automaton) of a group; None without terms."""
        listed = self.groups.get(group)
        if listed is None:
            return None
        if group not in self.built:
            import ahocorasick

            if self.terms + len(listed) > KEPT_TERMS:
                self.built, self.terms = {}, 0
            automaton = ahocorasick.Automaton()
            for i, term in enumerate(listed):
                automaton.add_word(term, (i, len(term)))
            automaton.make_automaton()
            self.built[group], self.terms = (listed, automaton), self.terms + len(listed)
        return self.built[group]


def occurrences(texts: DataFrame, keys: list[str], terms: DataFrame, within: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """Terms in texts by an automaton: keys, ``term`` and, with a ``size``, ``slot``.

    ``texts`` has keys and ``text``; ``terms`` has ``term`` and the columns ``within`` (some of the keys), in which text
    and term must agree. A slot is a stretch of ``size`` characters of the text, from 0; a term is in that where it
    begins, once for each. The terms come to the driver, so their number must be known to be small.
    """
    within = list(within)
    groups: dict[tuple, list[str]] = {}
    for *group, term in terms.where("term <> ''").select(*within, "term").distinct().collect():
        groups.setdefault(tuple(group), []).append(term)
    sent = texts.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = Automata(sent.value)
        for batch in batches:
            own = [batch.column(keys.index(c)).to_pylist() for c in within]
            asked = list(zip(*own)) if own else [()] * batch.num_rows
            texts_ = batch.column(len(keys))
            rows, found, slots = [], [], []
            # Texts of a group one after another, so that each automaton is built once.
            for at in sorted(range(batch.num_rows), key=lambda i: str(asked[i])):
                known, text = automata.of(asked[at]), texts_[at].as_py()
                if known is None or not text:
                    continue
                listed, automaton = known
                if size is None:
                    met = sorted({(i, 0) for _, (i, _) in automaton.iter(text)})
                else:
                    met = sorted({(i, (end + 1 - n) // size) for end, (i, n) in automaton.iter(text)})
                rows += [at] * len(met)
                found += [listed[i] for i, _ in met]
                slots += [s for _, s in met]
            part = batch.select(list(range(len(keys)))).take(pa.array(rows, pa.int64()))
            more = [pa.array(found, pa.string())] + [pa.array(slots, pa.int32())] * (size is not None)
            yield pa.RecordBatch.from_arrays([*part.columns, *more], [*keys, "term", *["slot"] * (size is not None)])

    rows = texts.select(*keys, F.col("text"))
    fields = rows.schema.fields[:-1] + [StructField("term", StringType())] + [StructField("slot", IntegerType())] * (size is not None)
    return rows.mapInArrow(run, StructType(fields))


def contained_terms(texts: DataFrame, keys: list[str], terms: DataFrame, gram: int = 3, within: Sequence[str] = ()) -> DataFrame:
    """Pairs of a text (``keys``) and a term that occurs in it: keys and ``term``; see :func:`occurrences`.

    More terms than ``BROADCAST_TERMS`` are found by their runs of ``gram`` characters.
    """
    terms = stored(terms.where("term <> ''").select(*within, "term").distinct())
    if terms.count() <= BROADCAST_TERMS:
        return occurrences(texts, keys, terms, within)
    return terms_by_grams(texts, keys, terms, gram, within)


def character_grams(text: Column, n: int) -> Column:
    """The different runs of ``n`` characters of a text; none if the text is shorter."""
    size = F.length(text)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((size - n) / PIECE).cast("int")), lambda k: F.substr(text, k * PIECE + 1, F.lit(PIECE + n - 1)))
    runs = F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substr(p, i, F.lit(n))))
    return F.when(size >= n, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def terms_by_grams(texts: DataFrame, keys: list[str], terms: DataFrame, gram: int, within: Sequence[str] = ()) -> DataFrame:
    """As :func:`contained_terms`, for any number of terms.

    A term is known by its rarest run of ``gram`` characters among the terms (a shorter term by itself). The runs of a
    text meet the terms' runs without the text; Spark's runtime filters drop most of them before. Then only texts with a
    candidate are read. The test is exact: a text that holds a term holds all its runs.
    """
    within = list(within)
    sizes = [r["n"] for r in terms.select(F.least(F.length("term"), F.lit(gram)).alias("n")).distinct().collect()]  # at most ``gram`` rows
    keyed = terms.select(*within, "term", F.explode(F.when(F.length("term") < gram, F.array("term")).otherwise(character_grams(F.col("term"), gram))).alias("gram"))
    counted = matched(keyed, keyed.groupBy(*within, "gram").agg(F.count("*").alias("n")), [*within, "gram"])
    known = stored(counted.groupBy(*within, "term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")))
    runs = F.concat(*[character_grams(F.col("text"), n) for n in sorted(sizes)]) if sizes else F.array().cast("array<string>")
    found = matched(texts.select(*keys, F.explode(runs).alias("gram")), known, [*within, "gram"]).select(*keys, "term")
    return matched(texts.select(*keys, "text"), stored(found), keys).where(F.contains("text", "term")).select(*keys, "term").distinct()
