"""The concept graph: lookups, neighbours, merges, shortest paths.

Nodes have label, name, subject, difficulty, importance, description; edges have src, dst, type, strength (and the labels
of their ends where they are not all concepts).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import replaced, stored


def get_concept(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """The concepts of a lookup table (name)."""
    return nodes.where("label = 'Concept'").join(names.select("name").distinct(), "name", "left_semi")


def search_concepts(nodes: DataFrame, keyword: str, subject: str | None = None, limit: int = 10) -> DataFrame:
    """The first ``limit`` concepts by name whose name contains the keyword, of one subject if given."""
    found = nodes.where((F.col("label") == "Concept") & F.contains("name", F.lit(keyword)))
    return (found if subject is None else found.where(F.col("subject") == subject)).orderBy("name").limit(limit)


def drop_invalid_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("name is not null and name <> ''")


def drop_invalid_links(links: DataFrame) -> DataFrame:
    ok = [F.coalesce(c, F.lit("")) != "" for c in ("source", "target", "relation")]
    return links.where(ok[0] & ok[1] & ok[2])


def related_concepts(edges: DataFrame, nodes: DataFrame, names: DataFrame, relation_type: str | None = None, limit: int | None = 5) -> DataFrame:
    """Concepts that an edge of a requested name leads to: src, name, type, strength and the attributes.

    With a limit, the first by name, then type, of each requested name.
    """
    edges = edges if relation_type is None else edges.where(F.col("type") == relation_type)
    wanted = edges.join(names.select(F.col("name").alias("src")).distinct(), "src", "left_semi")
    concepts = nodes.where("label = 'Concept'").drop("label")
    found = wanted.select("src", F.col("dst").alias("name"), "type", "strength").join(concepts, "name")
    if limit is None:
        return found
    place = F.row_number().over(Window.partitionBy("src").orderBy("name", "type"))
    return found.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def ranked_neighbours(links: DataFrame, names: DataFrame, weight: str, limit: int = 3) -> DataFrame:
    """The ``limit`` linked rows (concept, name, weight) of each requested concept with the highest weight; ties by name."""
    wanted = links.join(names.select(F.col("name").alias("concept")).distinct(), "concept", "left_semi")
    place = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc(weight), "name"))
    return wanted.select("concept", "name", weight).withColumn("place", place).where(F.col("place") <= limit)


def concept_examples(examples: DataFrame, names: DataFrame, limit: int = 3) -> DataFrame:
    return ranked_neighbours(examples, names, "relevance", limit)


def concept_misconceptions(misconceptions: DataFrame, names: DataFrame, limit: int = 3) -> DataFrame:
    return ranked_neighbours(misconceptions, names, "frequency", limit)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes by label and of edges by type, and of all nodes: kind, name, n."""
    by_label = nodes.groupBy(F.lit("label").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    by_type = edges.groupBy(F.lit("type").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n"))
    total = nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), F.lit("all").alias("name"), "n")
    return by_label.unionByName(by_type).unionByName(total)


def merge_nodes_insert_only(nodes: DataFrame, incoming: DataFrame, subject: str = "imported") -> DataFrame:
    """All nodes, and the concepts of ``incoming`` (seq, name, type, definition, difficulty, importance) that are absent by name.

    The first row of a name by ``seq`` counts; rows of another type or without a name are left out. Defaults: difficulty
    3, importance 4.
    """
    rows = imported_concepts(incoming, subject)
    new = rows.join(nodes.where("label = 'Concept'").select("name"), "name", "left_anti").select(*rows.columns)
    return nodes.select(*rows.columns).unionByName(new)


def imported_concepts(incoming: DataFrame, subject: str = "imported") -> DataFrame:
    """The nodes that :func:`merge_nodes_insert_only` would add to an empty graph: each name once."""
    rows = drop_invalid_nodes(incoming).where("type = 'Concept'")
    first = F.min_by(F.struct("definition", "difficulty", "importance"), "seq")
    return rows.groupBy("name").agg(first.alias("f")).select(
        F.lit("Concept").alias("label"), "name", F.lit(subject).alias("subject"),
        F.coalesce("f.difficulty", F.lit(3)).alias("difficulty"), F.coalesce("f.importance", F.lit(4)).alias("importance"),
        F.coalesce("f.definition", F.lit("")).alias("description"),
    )


def merge_nodes_typed(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """As above with the key (type, name); the id stands in for a missing name, and both defaults are 3."""
    rows = imported_nodes(incoming)
    return nodes.select(*rows.columns).unionByName(rows.join(nodes.select("label", "name"), ["label", "name"], "left_anti").select(*rows.columns))


def imported_nodes(incoming: DataFrame) -> DataFrame:
    """The nodes that :func:`merge_nodes_typed` would add to an empty graph: each (label, name) once."""
    named = incoming.withColumn("name", F.coalesce("name", "id")).where("name is not null")
    rows = named.withColumn("label", F.coalesce("type", F.lit("Concept")))
    first = F.min_by(F.struct("definition", "difficulty", "importance"), "seq")
    return rows.groupBy("label", "name").agg(first.alias("f")).select(
        "label", "name", F.lit("").alias("subject"), F.coalesce("f.difficulty", F.lit(3)).alias("difficulty"),
        F.coalesce("f.importance", F.lit(3)).alias("importance"), F.coalesce("f.definition", F.lit("")).alias("description"),
    )


def merge_edges_concepts(edges: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (src, dst, type, strength) and the links between concepts that are absent; the first by ``seq`` sets the strength."""
    new = imported_edges(links, nodes)
    old = edges.select("src", "dst", "type", "strength")
    return old.unionByName(new.join(old, ["src", "dst", "type"], "left_anti"))


def imported_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that :func:`merge_edges_concepts` would add to a graph without any: each (src, dst, type) once."""
    names = nodes.where("label = 'Concept'").select("name").distinct()
    rows = drop_invalid_links(links)
    for end in ("source", "target"):
        rows = rows.join(names.withColumnRenamed("name", end), end, "left_semi")
    first = rows.groupBy(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("relation").alias("type"))
    return first.agg(F.coalesce(F.min_by("strength", "seq"), F.lit(0.5)).alias("strength"))


def merge_edges_any_label(edges: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """As above, with ends matched by name across all labels: one link can make several edges. Type default RELATED_TO."""
    new = imported_labelled_edges(links, nodes)
    old = edges.select(*new.columns)
    return old.unionByName(new.join(old, LABELLED_EDGE, "left_anti"))


LABELLED_EDGE = ["src_label", "src", "dst_label", "dst", "type"]


def imported_labelled_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that :func:`merge_edges_any_label` would add to a graph without any, each once."""
    names = nodes.select("label", "name").distinct()
    rows = links.where("source is not null and target is not null").withColumn("type", F.coalesce("relation", F.lit("RELATED_TO")))
    both = rows.join(names.select(F.col("label").alias("src_label"), F.col("name").alias("source")), "source").join(
        names.select(F.col("label").alias("dst_label"), F.col("name").alias("target")), "target"
    )
    named = both.withColumnsRenamed({"source": "src", "target": "dst"}).groupBy(*LABELLED_EDGE)
    return named.agg(F.coalesce(F.min_by("strength", "seq"), F.lit(0.5)).alias("strength"))


def import_counts(nodes: DataFrame, links: DataFrame, merged_nodes: DataFrame, merged_edges: DataFrame, old_nodes: DataFrame, old_edges: DataFrame) -> DataFrame:
    """Rows that an import accepted and rows it created: kind, accepted, created."""

    def row(kind: str, tried: DataFrame, after: DataFrame, before: DataFrame) -> DataFrame:
        counts = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("of"), "n") for n, d in (("t", tried), ("a", after), ("b", before))]
        n = lambda of: F.sum(F.when(F.col("of") == of, F.col("n")).otherwise(0))
        every = counts[0].unionByName(counts[1]).unionByName(counts[2])
        return every.agg(n("t").alias("accepted"), (n("a") - n("b")).alias("created")).select(F.lit(kind).alias("kind"), "accepted", "created")

    return row("nodes", drop_invalid_nodes(nodes), merged_nodes, old_nodes).unionByName(row("links", drop_invalid_links(links), merged_edges, old_edges))


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int, wanted: DataFrame | None = None) -> DataFrame:
    """Breadth-first levels from each ``start`` (column start): start, name, depth, parent.

    Each level joins the frontier with the edges, keeps the smallest parent of a newly met name, and drops names met
    before; a level is stored, so the plan does not grow. With ``wanted`` (start, name) a start is followed only until all
    its wanted names are met.
    """
    step = stored(edges.select(F.col("src").alias("name"), F.col("dst").alias("next")).distinct())
    seen = stored(
        starts.select("start").distinct().select("start", F.col("start").alias("name"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    )
    frontier, left = seen, None if wanted is None else stored(wanted.select("start", "name").where("start <> name").distinct())
    for depth in range(1, max_depth + 1):
        ahead = frontier if left is None else frontier.join(left.select("start").distinct(), "start", "left_semi")
        met = ahead.select("start", "name").join(step, "name").groupBy("start", F.col("next").alias("name")).agg(F.min(F.col("name")).alias("parent"))
        frontier = stored(met.join(seen, ["start", "name"], "left_anti").select("start", "name", F.lit(depth).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if left is not None:
            left = replaced(left, stored(left.join(frontier, ["start", "name"], "left_anti")))
    return seen


#: Numbers that a slice of a step of a search shuffles, and slices at most, as each shuffles the graph again.
SLICE_NUMBERS, MOST_SLICES = 100_000_000, 8


class NumberedGraph:
    """The moves of ``edges`` with numbers for names, in the order of the names: ``names`` (name, id), and for each number the
    array ``near`` of those that its moves lead to (``ahead``) and come from (``behind``). All are stored. Numbers are
    ints from 0 without gaps, half as large as what Spark numbers rows by. ``edges`` is read several times."""

    def __init__(self, edges: DataFrame):
        step = edges.select("src", "dst").where("src is not null and dst is not null")
        ends = step.select(F.col("src").alias("name")).distinct().unionByName(step.select(F.col("dst").alias("name")).distinct())
        self.names = numbered_names(ends.distinct())
        ids = self.numbered(self.numbered(step, "src", "_src"), "dst", "_dst")
        # Rows of a target are together then, by its name, and its sources need no shuffle of their own.
        both = ids.groupBy("dst", F.col("_dst").alias("id")).agg(F.array_sort(F.collect_set("_src")).alias("near"))
        self.behind = stored(both.select("id", "near"))
        each = self.behind.select(F.col("id").alias("dst"), F.explode("near").alias("id"))
        self.ahead = stored(each.groupBy("id").agg(F.array_sort(F.collect_list("dst")).alias("near")))
        self.mean = self.ahead.agg(F.avg(F.size("near"))).first()[0] or 0.0

    def numbered(self, rows: DataFrame, column: str, out: str | None = None) -> DataFrame:
        """``rows`` with numbers in the place of names, or beside them as ``out``; those whose name has no move are left out."""
        both = rows.join(self.names.select(F.col("name").alias(column), F.col("id").alias("_id")), column)
        return both.withColumn(out or column, F.col("_id")).drop("_id")

    def named(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.join(self.names.select(F.col("id").alias(column), F.col("name").alias("_name")), column).withColumn(column, F.col("_name")).drop("_name")


def numbered_names(names: DataFrame) -> DataFrame:
    """Distinct names, numbered from 0 in their order without gaps: name, id (int). Stored."""
    # Ranges are sorted and their partitions numbered in order, so that numbers ascend with names.
    ordered = stored(names.orderBy("name").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part).count().collect())
    before, bases = 0, [F.lit(0), F.lit(0)] if not counts else []
    for p, n in counts:
        bases += [F.lit(int(p)), F.lit(before)]
        before += n
    if before >= 1 << 31:
        raise ValueError(f"{before} names are more than an int numbers")
    return stored(ordered.select("name", (F.create_map(*bases)[part.cast("int")] + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("id")))


def _moves_of(level: DataFrame, near: DataFrame, root: str) -> DataFrame:
    """The moves of the names of a level, by root: root, and ``moves``, an array of (id, near)."""
    each = level.select(root, F.explode("names").alias("id")).hint("merge").join(near, "id")
    return each.groupBy(root).agg(F.collect_list(F.struct("id", "near")).alias("moves"))


def _ahead_of(level: DataFrame, near: DataFrame, root: str) -> DataFrame:
    """The names one move beyond a level, by root (root, names: an array)."""
    each = level.select(root, F.explode("names").alias("id")).hint("merge").join(near, "id")
    return each.groupBy(root).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("names"))


def meeting_levels(graph: NumberedGraph, pairs: DataFrame, max_depth: int) -> tuple[DataFrame, dict[str, list[DataFrame]]]:
    """Breadth-first from both ends of each pair of numbers (start, target; not equal) until its sides meet, always on the
    side with fewer names.

    Returns the pairs that meet (start, target, f, b: the levels at which they do, whose sum is the distance, and middle: the
    names met) and the levels of starts and of targets: tables with a row for each root, whose names are one array, so that
    rows number as many as pairs and roots, not as names met. A level holds all that so many moves lead to, also what
    was met before: a pair that hasn't met is further apart than its levels say, so what its sides share next is new to both.
    The last level met is never written for roots whose pairs have all met, and large steps are taken in slices of the roots,
    so that the disk holds the shuffle files of one slice.
    """
    sides, other = {"start": graph.ahead, "target": graph.behind}, {"start": "target", "target": "start"}
    levels = {root: [stored(pairs.select(root).distinct().withColumn("names", F.array(root)))] for root in sides}
    size = {root: levels[root][0].count() for root in sides}
    roots, left, count, found = dict(size), pairs, pairs.count(), []
    for depth in range(1, max_depth + 1):
        root = min(sides, key=lambda r: size[r])
        far = other[root]
        asked = levels[root][-1].join(left.select(root).distinct(), root, "left_semi")
        k = {root: len(levels[root]), far: len(levels[far]) - 1}
        # What is shuffled at a time: the new level, by some moves a name, and the other side's names for each pair.
        numbers = size[root] * graph.mean + count * size[far] / max(roots[far], 1)
        slices = max(1, min(MOST_SLICES, round(numbers / SLICE_NUMBERS)))
        for i in range(slices):
            of = lambda df: df.where(F.pmod(F.xxhash64(root), F.lit(slices)) == i) if slices > 1 else df  # noqa: B023, E731
            new = _ahead_of(of(asked), sides[root], root)
            # The pairs take the other side's names along to where the new level is made.
            held = of(left).join(levels[far][-1].withColumnRenamed("names", "_far"), far).hint("merge")
            both = held.join(new.hint("merge"), root).select("start", "target", F.array_intersect("_far", "names").alias("middle"))
            now = both.where(F.size("middle") > 0).select("start", "target", F.lit(k["start"]).alias("f"), F.lit(k["target"]).alias("b"), "middle")
            found.append(stored(now))
        met = reduce(lambda a, b: a.unionByName(b), found)
        if depth == max_depth:
            break
        left = stored(left.join(met.select("start", "target"), ["start", "target"], "left_anti"))
        if not (count := left.count()):
            break
        wanted = asked.join(left.select(root).distinct(), root, "left_semi")
        levels[root].append(stored(_ahead_of(wanted, sides[root], root)))
        roots[root], size[root] = levels[root][-1].agg(F.count("*"), F.coalesce(F.sum(F.size("names")), F.lit(0))).first()
        if not size[root]:
            break
    return met, levels


def _paths(graph: NumberedGraph, met: DataFrame, levels: dict[str, list[DataFrame]]) -> list[DataFrame]:
    """The path of each pair that meets, as numbers (start, target, path): that with the smallest parent at each level, from
    the target back. A table for each two levels at which pairs meet."""
    pair, paths = ["start", "target"], []
    for f, b in sorted({(r["f"], r["b"]) for r in met.select("f", "b").distinct().collect()}):
        # What lies on shortest paths at each depth from the meeting level on, each with its smallest way back to that level.
        rows = met.where((F.col("f") == f) & (F.col("b") == b)).select(*pair, F.transform("middle", lambda x: F.struct(x.alias("id"), F.array(x).alias("path"))).alias("on"))
        for k in range(1, b + 1):
            wanted = levels["target"][b - k].join(rows.select("target").distinct(), "target", "left_semi")
            at = rows.join(_moves_of(wanted, graph.behind, "target"), "target")
            # A parent is the smallest of the names before that leads here; structs compare by their ids, which differ.
            first = lambda x: F.array_min(F.filter("on", lambda y: F.array_contains(x["near"], y["id"])))
            tied = F.filter(F.transform("moves", lambda x: F.struct(x["id"].alias("id"), first(x).alias("from"))), lambda x: x["from"].isNotNull())
            rows = at.select(*pair, F.transform(tied, lambda x: F.struct(x["id"].alias("id"), F.concat(x["from"]["path"], F.array(x["id"])).alias("path"))).alias("on"))
        # From the meeting level back: the smallest parent among the names met from the start.
        rows = rows.select(*pair, F.col("on")[0]["path"].alias("path"))
        for depth in range(f - 1, 0, -1):
            at = rows.withColumn("id", F.element_at("path", 1)).join(graph.behind, "id").join(levels["start"][depth], "start")
            rows = at.select(*pair, F.concat(F.array(F.array_min(F.array_intersect("near", "names"))), "path").alias("path"))
        paths.append(rows.select(*pair, F.concat(F.array("start"), "path").alias("path") if f else F.col("path")))
    return paths


def shortest_learning_path(
    edges: DataFrame, pairs: DataFrame, max_depth: int = 5, graph: NumberedGraph | None = None, searched: Sequence[tuple[DataFrame, dict[str, list[DataFrame]]]] = ()
) -> DataFrame:
    """Edges of a shortest path for each pair (start, target): start, target, step (from 1), src, dst, type, strength.

    Of several paths that with the smallest parent at each level, from the target back; of several edges of a step the
    first type by name. A pair of equal ends, or without a path of at most ``max_depth`` edges, has no rows. All pairs
    are walked together, from both ends (:func:`meeting_levels`), and each is one row throughout. Pairs that met in a
    search before (``searched``, of the same graph and depth) are not searched again.
    """
    graph, pair = graph or NumberedGraph(edges), ["start", "target"]
    asked = pairs.select(*pair).where("start <> target").distinct()
    known = stored(graph.numbered(graph.numbered(asked, "start", "_start"), "target", "_target"))
    left, paths = known.select(F.col("_start").alias("start"), F.col("_target").alias("target")), []
    for met, levels in searched:
        paths += _paths(graph, met.join(left, pair, "left_semi"), levels)
        left = stored(left.join(met.select(*pair), pair, "left_anti"))
    if not left.isEmpty():
        paths += _paths(graph, *meeting_levels(graph, left, max_depth))
    none = known.select(F.col("_start").alias("start"), F.col("_target").alias("target"), F.array().cast("array<int>").alias("path"))
    every = reduce(lambda a, b: a.unionByName(b), paths) if paths else none
    moves = F.transform(F.slice("path", 2, F.size("path")), lambda x, i: F.struct((i + 1).alias("step"), F.get("path", i).alias("src"), x.alias("dst")))
    own = every.withColumnsRenamed({"start": "_start", "target": "_target"}).join(known, ["_start", "_target"])
    steps = stored(graph.named(graph.named(own.select(*pair, F.inline(moves)), "src"), "dst"))
    # Only the edges of some path are put together.
    some = edges.join(steps.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    first = some.groupBy("src", "dst").agg(F.min_by(F.struct("type", "strength"), "type").alias("e"))
    return steps.join(first, ["src", "dst"]).select("start", "target", "step", "src", "dst", "e.type", "e.strength")


def names_of(column: Column | str, df: DataFrame) -> DataFrame:
    return df.select(F.col(column).alias("name") if isinstance(column, str) else column.alias("name")).distinct()
