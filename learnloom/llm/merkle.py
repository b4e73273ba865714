"""A Merkle manifest of a dataset: one tree for each group, one over the groups, and a proof for every row.

Rows of a group stand in a fixed order. Nodes are dealt to aligned blocks of ``2**LEVELS``; a block keeps each of its
levels as one string, the hexadecimal digests one after another, so a parent is the hash of a fixed-width substring of
the level below and a node's sibling is the substring beside it. The roots of full blocks are the nodes of the next round
of blocks, until a group has one node. The groups' roots are combined in the same way.

A block's row holds at most ``2**LEVELS`` nodes however many rows a group has, so no task holds a group. Places in a
group come from a range sort and from the counts of its parts. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Levels that a block climbs: 256 nodes, whose digests are a string of 16 KB.
LEVELS = 8
#: Characters of a SHA-256 in hexadecimal.
WIDTH = 64
PATH = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field_text(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value, so that no two lists of fields look alike."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """The digest of a row: that of its fields' texts one after another."""
    return digest(F.concat(*[field_text(f.cast("string")) for f in fields]))


def positions(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds ``pos``, the place of a row within its key from 0 in the order given, and ``n``, the rows of its key.

    The order must be total: it is sorted by ranges, and a place is the number of rows of the key in earlier ranges
    plus that within the range.
    """
    place = F.monotonically_increasing_id()  # the range, then the row within it
    first_key = F.col(key).asc()
    ranged = stored(rows.repartitionByRange(first_key, *order).sortWithinPartitions(first_key, *order).withColumn("place", place))
    part = F.shiftright("place", 33)
    counts = ranged.groupBy(key, part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(_window(key).orderBy("part").rowsBetween(_FIRST, -1))
    bases = counts.select(
        key, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"), F.sum("rows").over(_window(key)).alias("n")
    )
    placed = ranged.withColumn("part", part).join(stored(bases), [key, "part"])
    return placed.withColumn("pos", F.col("place") + F.col("base")).drop("place", "part", "base")


def _window(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


_FIRST = -(2**63)


def _node(level: Column, i: Column, nodes: int = 1) -> Column:
    """Node ``i`` of a level, or ``nodes`` of them from there; empty beyond its end."""
    return F.substr(level, (i * WIDTH + 1).cast("int"), F.lit(WIDTH * nodes))


def _parents(level: Column) -> Column:
    """The level above: the hash of every two nodes, and of the last one alone if their number is odd."""
    last = F.ceil(F.length(level) / (2 * WIDTH)).cast("int") - 1
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: digest(_node(level, 2 * i, 2))), "")


def blocks(nodes: DataFrame, key: str, levels: int = LEVELS, members: tuple[str, ...] = ()) -> DataFrame:
    """Columns key, block, n, members (pos, node and the columns asked for, in order), levels (strings, lowest first).

    ``nodes`` has the key, pos, n and node. A block climbs ``levels`` levels, or until its key has one node only.
    """
    dealt = nodes.groupBy(key, F.shiftright("pos", levels).alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node", *members))).alias("members")
    )
    leaves = F.array_join(F.transform("members", lambda m: m["node"]), "")
    # A level has more than one node, and so one above it, while n > 2**j.
    climb = F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda j: F.expr("n") > F.pow(F.lit(2), j))
    up = F.aggregate(climb, F.array(leaves), lambda below, _: F.concat(below, F.array(_parents(F.element_at(below, -1)))))
    return dealt.withColumn("levels", up)


def roots(block_rows: DataFrame, key: str, levels: int = LEVELS) -> DataFrame:
    """The nodes of the next round: key, pos, n, node."""
    above = F.ceil(F.col("n") / 2**levels).cast("long")
    return block_rows.select(key, F.col("block").alias("pos"), above.alias("n"), F.element_at("levels", -1).alias("node"))


def _path(levels: Column, i: Column) -> Column:
    """What stands before and after node ``i`` in its run, for each level that has one above it."""

    def step(j: Column) -> Column:
        own = (i / F.pow(F.lit(2), j)).cast("int")
        odd = own % 2 == 1
        beside = _node(F.element_at(levels, j + 1), F.when(odd, own - 1).otherwise(own + 1))
        return F.struct(F.when(odd, beside).otherwise("").alias("before"), F.when(odd, "").otherwise(beside).alias("after"))

    steps = F.filter(F.sequence(F.lit(0), F.size(levels) - 1), lambda j: j < F.size(levels) - 1)
    return F.transform(steps, step).cast(PATH)


def expand(block_rows: DataFrame, above: DataFrame, key: str, levels: int = LEVELS) -> DataFrame:
    """One row for each member of the blocks: its columns, the key, those of ``above``, and ``path`` up to the root.

    ``above`` has for each (key, pos), which is a block, the path of the block's root and more columns.
    """
    more = [c for c in above.columns if c not in (key, "pos", "path")]
    known = block_rows.join(above.withColumnsRenamed({"pos": "block", "path": "above"}), [key, "block"])
    inside = F.transform("members", lambda m: F.struct(m.alias("m"), _path(F.col("levels"), m["pos"] % 2**levels).alias("inside")))
    rows = known.select(key, "above", *more, F.inline(inside))
    return rows.select(key, "m.*", *more, F.concat("inside", "above").alias("path"))


def climbed(nodes: DataFrame, key: str, levels: int = LEVELS) -> DataFrame:
    """For each node (key, pos, n, node): its path to the root of its key, and ``root``."""
    own = stored(blocks(nodes, key, levels))
    above = stored(roots(own, key, levels))
    done = above.where("n = 1").select(key, "pos", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    more = above.where("n > 1")
    if not more.isEmpty():
        done = done.unionByName(climbed(more, key, levels).select(key, "pos", "path", "root"))
    return expand(own, done, key, levels)


def manifest(leaves: DataFrame, group: str, order: list[str], leaf: str, columns: list[str], levels: int = LEVELS) -> DataFrame:
    """One row for each row of ``leaves``: group, leaf, ``columns``, subroot, root and path.

    Rows of a group stand in ascending order of ``order`` (nulls first), equal ones in order of their digest; a null
    group is one of its own and comes first. ``path`` lists, from the leaf to the root over all groups, the sibling before
    and the sibling after a node (empty if there is none). The lists of one column set are wide (about 130 bytes a level):
    derive what is needed from them in the same query. An empty table gives an empty result.
    """
    # Fully equal rows are told apart by their place in the stored table, which stays the same however often it is read.
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]
    ordered = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    kept = stored(
        leaves.select(F.struct(F.col(group).alias("g")).alias("key"), F.col(leaf).alias("node"), *own, *ordered, F.monotonically_increasing_id().alias("row_no"))
    )
    members = tuple(f"c{i}" for i in range(len(columns)))
    by = [*(F.col(f"o{i}").asc_nulls_first() for i in range(len(order))), F.col("node").asc(), F.col("row_no").asc()]
    own_blocks = stored(blocks(positions(kept, "key", by), "key", levels, members))
    tops = stored(roots(own_blocks, "key", levels))
    done = tops.where("n = 1").select("key", "pos", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    more = tops.where("n > 1")
    if not more.isEmpty():
        done = done.unionByName(climbed(more, "key", levels).select("key", "pos", "path", "root"))
    within = stored(done.withColumnRenamed("root", "subroot"))
    groups = within.groupBy("key").agg(F.first("subroot").alias("node"))
    groups = positions(stored(groups.select(F.lit(0).alias("all"), "key", "node")), "all", [F.col("key").asc()])
    group_nodes = stored(groups)
    over = climbed(group_nodes, "all", levels).select("pos", F.col("path").alias("over"), "root")
    over = group_nodes.select("key", "pos").join(over, "pos").drop("pos")
    above = stored(within.join(over, "key").select("key", "pos", "subroot", "root", F.concat("path", "over").alias("path")))
    rows = expand(own_blocks, above, "key", levels)
    return rows.select(
        F.col("key.g").alias("group"), F.col("node").alias("leaf"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "subroot", "root", "path"
    )


def proof_digest(path: str) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(start: Column, path: str) -> Column:
    """The root that ``start`` leads to with the siblings of ``path``."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def document_manifest(docs: DataFrame, every: int = 7, levels: int = LEVELS) -> DataFrame:
    """A manifest of ``documents`` by language, audited against tampered rows.

    One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Where ``every`` divides the
    CRC-32 of the id, the row is tampered with for the fold: its ``n_chars`` is one more, unless it is null, which leaves
    it intact. A null text, source or language is told from an empty one; a null id comes first in its language and is
    never tampered with. Repeated rows are leaves of their own, next to each other, texts of one id in order of their
    digests. Texts of any length are hashed whole. An empty table gives an empty result; other columns are ignored.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang")]
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    changed = (F.crc32(F.col("doc_id").cast("string")) % every == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        "doc_id",
        "lang",
        leaf_digest(*fields, F.col("n_chars"), F.col("text")).alias("leaf"),
        F.when(changed, leaf_digest(*fields, more, F.col("text"))).alias("tampered"),
    )
    rows = manifest(leaves, "lang", ["doc_id"], "leaf", ["doc_id", "tampered"], levels)
    audited = rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), "path").alias("folded_root")
    )
    return audited.withColumn("verified", F.col("folded_root") == F.col("root"))
