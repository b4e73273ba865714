"""Reading and writing books, graphs, vocabularies, messages and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import graph as g
from .tables import Tables


#: Where a path names the book: in the file's name, or in a folder ``book_id=...``.
BOOK_FILE = r"(?:book_id=([^/]*)/|([^/]+?)(?:\.json)?$)"


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _book_id(pattern: str = BOOK_FILE):
    path = _decoded(F.col("_metadata.file_path"))
    folder = _decoded(F.regexp_extract(path, pattern, 1))  # names of folders are encoded once more
    named = F.when(folder != "", folder).otherwise(F.regexp_extract(path, pattern, 2))
    return F.when(named != "__HIVE_DEFAULT_PARTITION__", named)


def read_page_texts(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Pages (book_id, page, text) of files that map page numbers to texts; the file's name is the book.

    A file with a line for each page, as an indented dump has, is read in parallel by ranges of its bytes, since a text's
    own line breaks are escaped. A file without line breaks is one piece; if its pages stand in a row as ``"1": "text",
    "2": "text"``, the separator ``", "`` with its quotes, which no escaped text holds, splits it likewise.
    """
    if separator is None:
        lines = spark.read.text(path).select(_book_id().alias("book_id"), F.trim("value").alias("line"))
        alone = F.col("line").startswith('"')  # an entry, maybe the last, with a comma unless it is
        whole = F.when(alone, F.concat(F.lit("{"), F.regexp_replace("line", r",$", ""), F.lit("}"))).otherwise(F.col("line"))
    else:
        lines = spark.read.text(path, lineSep=separator).select(_book_id().alias("book_id"), F.col("value").alias("line"))
        # The quotes around the separator are lost; the file's first and last entries have their own, and a brace.
        first, last = F.col("line").rlike(r'^\s*\{\s*"'), F.col("line").rlike(r'(?s)(^|[^\\])(\\\\)*"\s*\}\s*$')
        whole = F.concat(F.when(first, "").otherwise('{"'), "line", F.when(last, "").otherwise('"}'))
    pages = lines.where(F.length("line") > 1).select("book_id", F.explode(F.from_json(whole, "map<string,string>")).alias("page", "text"))
    return pages.withColumn("page", F.col("page").cast("int"))


def write_page_texts(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").partitionBy("book_id").parquet(path)


def write_page_files(pages: DataFrame, path: str) -> None:
    """Pages as text files below a folder for each book, a page a line: parts of the dump that :func:`read_page_texts` reads."""
    line = F.concat(F.regexp_replace(F.to_json(F.struct(F.create_map(F.col("page").cast("string"), F.coalesce("text", F.lit(""))).alias("p"))), r'^\{"p":\{|\}\}$', ""), F.lit(","))
    pages.select("book_id", line.alias("value")).write.mode("overwrite").partitionBy("book_id").text(path)


def write_book_structure(chapters: DataFrame, sections: DataFrame, path: str) -> None:
    """A structure file for each book, in a folder of its own, as :func:`read_book_structure` reads it."""
    own = F.map_from_entries(F.collect_list(F.struct("chapter", F.struct("title", "page"))))
    parts = F.map_from_entries(F.collect_list(F.struct("section", F.struct("title", "page", "chapter"))))
    books = chapters.groupBy(F.struct("book_id").alias("b")).agg(own.alias("chapters"))
    books = books.join(sections.groupBy(F.struct("book_id").alias("b")).agg(parts.alias("sections")), "b", "full_outer")
    books.select("b.book_id", F.to_json(F.struct("chapters", "sections")).alias("value")).write.mode("overwrite").partitionBy("book_id").text(path)


def read_book_structure(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chapters (book_id, chapter, title, page) and sections (book_id, section, title, page, chapter)."""
    kind = "chapters map<string,struct<title:string,page:int>>, sections map<string,struct<title:string,page:int,chapter:string>>"
    files = spark.read.text(path, wholetext=True).select(_book_id().alias("book_id"), F.from_json("value", kind).alias("s"))
    chapters = files.select("book_id", F.explode("s.chapters").alias("chapter", "c")).select("book_id", "chapter", "c.title", "c.page")
    sections = files.select("book_id", F.explode("s.sections").alias("section", "c")).select("book_id", "section", "c.title", "c.page", "c.chapter")
    return chapters, sections


NODE = "id string, name string, type string, definition string, chapter string, importance int, difficulty int, page int"
LINK = "source string, target string, type string, strength double"


def read_graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`read_graph_json` for large files with line breaks between their objects, read in parallel by ranges of bytes.

    Objects end in ``},`` and a line break, which no escaped text holds. Whatever has a source and a target is a link.
    ``seq`` grows along a file with gaps: it is made of the byte that a range begins at, the row in its task, of which
    there are fewer than bytes, and the place among the objects of one row.
    """
    where = F.shiftleft(F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % 2**33, 20)
    kind = ", ".join(dict.fromkeys(f"{NODE}, {LINK}".split(", ")))
    lines = spark.read.text(path, lineSep="},\n").select(_book_id().alias("book_id"), where.alias("at"), "value")
    # An object that ends where a row ends has lost its brace.
    found = F.regexp_extract_all("value", F.lit(r'(?s)\{[^{}"]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^{}"]*+)*+(?:\}|\z)'), F.lit(0))
    rows = lines.select("book_id", "at", F.posexplode(found).alias("pos", "object"))
    parsed = F.from_json(F.when(F.col("object").endswith("}"), F.col("object")).otherwise(F.concat("object", F.lit("}"))), kind)
    rows = rows.select("book_id", (F.col("at") + F.col("pos")).alias("seq"), parsed.alias("r")).select("book_id", "seq", "r.*")
    linked = F.col("source").isNotNull() | F.col("target").isNotNull()
    nodes = rows.where(~linked & F.coalesce("id", "name").isNotNull()).select("book_id", "seq", *[c.split()[0] for c in NODE.split(", ")])
    return _with_defaults(nodes, rows.where(linked).select("book_id", "seq", *[c.split()[0] for c in LINK.split(", ")]))


def _with_defaults(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = nodes.withColumn("name", F.coalesce("name", "id")).fillna({"type": "Concept", "importance": 3, "difficulty": 3, "chapter": "", "page": 1})
    return nodes, links.fillna({"strength": 0.5})


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of graph files, with defaults: name = id, type Concept, importance and difficulty 3, strength 0.5."""
    kind = f"nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, links array<struct<{LINK.replace(' ', ':').replace(',:', ',')}>>"
    files = spark.read.text(path, wholetext=True).select(_book_id().alias("book_id"), F.from_json("value", kind).alias("g"))
    nodes = files.select("book_id", F.posexplode("g.nodes").alias("seq", "n")).select("book_id", "seq", "n.*")
    links = files.select("book_id", F.posexplode("g.links").alias("seq", "l")).select("book_id", "seq", "l.*")
    return _with_defaults(nodes, links)


def graph_tables(points: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points as nodes (id = name = concept) and relations as links, with the defaults of the graph file."""
    has_chapter = "chapter" in points.columns
    nodes = points.select(
        F.col("concept").alias("id"), F.col("concept").alias("name"), F.lit("Concept").alias("type"), "definition",
        (F.coalesce("chapter", F.lit("")) if has_chapter else F.lit("")).alias("chapter"),
        F.coalesce("importance", F.lit(3)).alias("importance"), F.coalesce("difficulty", F.lit(3)).alias("difficulty"), F.coalesce("page", F.lit(1)).alias("page"),
    )
    return nodes, relations.select("source", "target", F.col("relation").alias("type"), F.coalesce("strength", F.lit(0.5)).alias("strength"))


def write_graph_json(points: DataFrame, relations: DataFrame, path: str) -> None:
    """Nodes and links as two JSON datasets below ``path``."""
    nodes, links = graph_tables(points, relations)
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    links.write.mode("overwrite").json(f"{path}/links")


def read_vocabularies(spark: SparkSession, path: str) -> DataFrame:
    """Terms (domain, term) of files, or folders, named ``<domain>_concepts.txt``, a term a line; blank lines are dropped."""
    named = F.regexp_extract(_decoded(F.col("_metadata.file_path")), r"([^/=]*)_concepts\.txt(?:/[^/]*)?$", 1)
    return spark.read.text(path).select(_decoded(named).alias("domain"), F.trim("value").alias("term")).where("term <> ''")


def write_vocabularies(vocabulary: DataFrame, path: str) -> None:
    """Terms (domain, term) as text files in a folder for each domain, as :func:`read_vocabularies` reads them."""
    vocabulary.select(F.concat("domain", F.lit("_concepts.txt")).alias("name"), F.col("term").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def read_messages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One JSON message a line, as column value; parse it with ``route_messages``."""
    return (spark.readStream if stream else spark.read).text(path)


def point_batches(points: DataFrame, batch_size: int = 10) -> DataFrame:
    """Adds ``batch``: pages of a book in order, ``batch_size`` to a batch, counting pages that have points."""
    rank = F.dense_rank().over(Window.partitionBy("book_id").orderBy("page"))
    return points.withColumn("batch", F.floor((rank - 1) / batch_size))


def write_point_batches(points: DataFrame, path: str, batch_size: int = 10) -> None:
    """Each batch once, not cumulative."""
    point_batches(points, batch_size).write.mode("overwrite").partitionBy("batch").parquet(path)


def write_monitor_snapshot(emotions: DataFrame, learning: DataFrame, log: DataFrame, path: str) -> None:
    """The series of emotions and learning states, and the log, as three JSON datasets below ``path``."""
    for name, df in (("emotions", emotions), ("learning", learning), ("log", log)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_monitor_snapshot(spark: SparkSession, path: str, emotions: StructType, learning: StructType, log: StructType) -> tuple[DataFrame, ...]:
    """What :func:`write_monitor_snapshot` wrote, by the schemas of its tables."""
    return tuple(spark.read.schema(s).json(f"{path}/{n}") for n, s in (("emotions", emotions), ("learning", learning), ("log", log)))


def replace_tables(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> None:
    """Replaces all the tables below ``path`` in one commit; they may be derived from what they replace.

    A job that fails leaves what was there. Read them with :class:`learnloom.sources.tables.Tables`.
    """
    Tables(spark, path).replace_all(tables)


def import_graph(tables: Tables, nodes: DataFrame, links: DataFrame, typed: bool = False, buckets: int = 64) -> dict[str, int]:
    """Merges nodes and links into the stored tables ``nodes`` and ``edges`` and returns how many rows each got.

    With ``typed`` the rules are those of ``merge_nodes_typed`` and ``merge_edges_any_label``, else those of
    ``merge_nodes_insert_only`` and ``merge_edges_concepts``. Only the buckets of the keys that come in are read, and those
    that get rows are added to; the nodes that links may join are looked up by name among all nodes' names only if
    ``typed``, else in the buckets of the links' ends. Tables that are missing are made.
    """
    new = g.imported_nodes(nodes) if typed else g.imported_concepts(nodes)
    edge_key = g.LABELLED_EDGE if typed else ["src", "dst", "type"]
    strength = ", ".join(f"{c} string" for c in edge_key) + ", strength double"
    there = tables.names()
    empty = {"nodes": new.where("false"), "edges": tables.spark.createDataFrame([], strength)}
    keys = {"nodes": ["label", "name"], "edges": edge_key}
    missing = [n for n in empty if n not in there]
    if missing:
        tables.replace_all({n: empty[n] for n in missing}, {n: (keys[n], buckets) for n in missing})
    added = {"nodes": tables.insert_absent("nodes", new)}
    if typed:
        known, make = tables.read("nodes").select("label", "name"), g.imported_labelled_edges
    else:
        ends = links.select(F.lit("Concept").alias("label"), F.explode(F.array("source", "target")).alias("name")).where("name is not null")
        known, make = tables.read("nodes", buckets=tables.touched("nodes", ends)), g.imported_edges
    return added | {"edges": tables.insert_absent("edges", make(links, known))}


# A small graph to start from, our own: (name, difficulty, importance, description).
SEED_SUBJECT = "data structures"
SEED_CONCEPTS = [
    ("array", 1, 5, "values side by side, found by their number"),
    ("linked list", 2, 4, "values that each know where the next one is"),
    ("stack", 2, 4, "what was put on last comes off first"),
    ("queue", 2, 4, "what was put in first comes out first"),
    ("binary tree", 3, 5, "each node has a left and a right part at most"),
    ("heap", 4, 3, "a tree whose parents are never larger than their children"),
    ("hash table", 3, 5, "a value's place follows from its key"),
    ("graph", 4, 4, "points and the lines between them"),
]
# (concept, kind, name, description, weight)
SEED_DETAILS = [
    ("array", "Example", "seat numbers", "row and seat lead straight to a place in a theatre", 0.8),
    ("stack", "Example", "undo", "an editor takes back the newest change first", 0.9),
    ("queue", "Example", "print jobs", "a printer works them off as they came", 0.85),
    ("hash table", "Example", "cloakroom", "the ticket's number tells the hook", 0.7),
    ("linked list", "Misconception", "always slower", "adding in the middle moves nothing else", 0.5),
    ("hash table", "Misconception", "keys in order", "places say nothing about the order of keys", 0.6),
]
# (concept, type, concept, strength)
SEED_LINKS = [
    ("array", "IS_PREREQUISITE_OF", "heap", 0.7), ("array", "IS_PREREQUISITE_OF", "hash table", 0.8), ("linked list", "IS_PREREQUISITE_OF", "binary tree", 0.75),
    ("linked list", "IS_RELATED_TO", "queue", 0.6), ("array", "IS_RELATED_TO", "stack", 0.6), ("binary tree", "INCLUDES", "heap", 0.9), ("graph", "INCLUDES", "binary tree", 0.85),
]


def seed_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, name, subject, difficulty, importance, description) and edges (labels and names of both ends, type,
    strength, relevance, frequency) of a small graph for first steps."""
    nodes = [("Concept", n, SEED_SUBJECT, d, i, text) for n, d, i, text in SEED_CONCEPTS]
    nodes += [(kind, n, None, None, None, text) for _, kind, n, text, _ in SEED_DETAILS]
    edges = [("Concept", a, "Concept", z, kind, strength, None, None) for a, kind, z, strength in SEED_LINKS]
    for concept, kind, n, _, weight in SEED_DETAILS:
        example = kind == "Example"
        edges.append(("Concept", concept, kind, n, f"HAS_{kind.upper()}", None, weight if example else None, None if example else weight))
    return (
        spark.createDataFrame(nodes, "label string, name string, subject string, difficulty int, importance int, description string"),
        spark.createDataFrame(edges, "src_label string, src string, dst_label string, dst string, type string, strength double, relevance double, frequency double"),
    )
