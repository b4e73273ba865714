"""How the driver's tables stand in for books, graphs, students and messages; each has the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.emotion import normalised
from ..operators import mining
from ..storage import stored

DEFINITION = r"([A-Za-z]{2,20}) is ([^.\n]{5,}?)\."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each source, a page for each document."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page"), "text")


PAGES = "pages_ AS (SELECT source AS book_id, doc_id AS page, text FROM documents)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.mine_definitions(pages(spark, sf_dir), [DEFINITION])
    return found.withColumn("importance", (1 + F.col("page") % 5).cast("int")).withColumn(
        "difficulty", (1 + F.length("definition") % 5).cast("int")
    )


POINTS = rf"""matches_ AS (SELECT source AS book_id, doc_id AS page, regexp_extract_all(text, '{DEFINITION}', 1) AS c,
  regexp_extract_all(text, '{DEFINITION}', 2) AS d FROM documents),
numbered_ AS (SELECT book_id, page, unnest(c) AS c, unnest(d) AS d, unnest(generate_series(0, len(c) - 1)) AS match FROM matches_),
points AS (SELECT book_id, page * 10000000 + match AS seq, page, trim(c) AS concept, trim(d) AS definition,
  CAST(1 + page % 5 AS INT) AS importance, CAST(1 + length(trim(d)) % 5 AS INT) AS difficulty FROM numbered_
  WHERE length(trim(c)) >= 2 AND length(trim(d)) >= 5)"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long words of the benchmark, a domain for each remainder of the item by five."""
    words = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("domain"), F.col("item_id") % 5).alias("domain"), F.explode(F.regexp_extract_all("text", F.lit("[a-z]{8,}"), F.lit(0))).alias("term")
    )
    return words.distinct()


VOCABULARY = """vocabulary AS (SELECT DISTINCT 'domain' || (item_id % 5) AS domain, unnest(regexp_extract_all(text, '[a-z]{8,}')) AS term FROM benchmark)"""

# A heading for each digit group that is followed by a word, as in "4 555 ...": the tables have no real headings.
NUMBERED = r"(\d)(\d)\d* ([^\n ]+)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept for each part."""
    return table(spark, sf_dir, "part").select(
        F.lit("Concept").alias("label"),
        F.col("p_partkey").cast("string").alias("name"),
        F.col("p_type").alias("subject"),
        (1 + F.col("p_size") % 5).cast("int").alias("difficulty"),
        (1 + F.col("p_partkey") % 5).cast("int").alias("importance"),
        F.concat_ws(" ", "p_brand", "p_name").alias("description"),
    )


NODES = """nodes AS (SELECT 'Concept' AS label, CAST(p_partkey AS VARCHAR) AS name, p_type AS subject,
  CAST(1 + p_size % 5 AS INT) AS difficulty, CAST(1 + p_partkey % 5 AS INT) AS importance, p_brand || ' ' || p_name AS description FROM part)"""


def raw_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in an order, as relations with an input order ``seq``."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("source"),
        F.lead("l_partkey").over(order).cast("string").alias("target"),
        F.when(F.col("l_returnflag") == "A", "IS_PREREQUISITE_OF").when(F.col("l_returnflag") == "N", "INCLUDES").otherwise("IS_RELATED_TO").alias("relation"),
        F.round(1 - F.col("l_discount"), 6).alias("strength"),
        (F.col("l_orderkey") * 100 + F.row_number().over(order)).alias("seq"),
    )
    return rows.where("target is not null and source <> target")


RELATIONS = """raw_relations AS (SELECT * FROM (SELECT CAST(l_partkey AS VARCHAR) AS source, CAST(lead(l_partkey) OVER o AS VARCHAR) AS target,
  CASE l_returnflag WHEN 'A' THEN 'IS_PREREQUISITE_OF' WHEN 'N' THEN 'INCLUDES' ELSE 'IS_RELATED_TO' END AS relation,
  round(1 - l_discount, 6) AS strength, l_orderkey * 100 + row_number() OVER o AS seq FROM lineitem
  WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE target IS NOT NULL AND source <> target)"""


def edges(spark: SparkSession, sf_dir: str, raw: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Edges between concepts: label and name of both ends, type, strength; with ``by`` the rows of one end are put together first."""
    raw = raw or raw_relations(spark, sf_dir)
    merged = (raw.repartition(by) if by else raw).groupBy("source", "target", "relation").agg(F.max("strength").alias("strength"))
    concept = F.lit("Concept")
    return merged.select(
        concept.alias("src_label"), F.col("source").alias("src"), concept.alias("dst_label"), F.col("target").alias("dst"), F.col("relation").alias("type"), "strength"
    )


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between concepts as a stored table (src, dst, type, strength), put together by one shuffle, of their sources."""
    return stored(edges(spark, sf_dir, None, "source").drop("src_label", "dst_label"))


EDGES = RELATIONS + """, edges AS (SELECT source AS src, target AS dst, relation AS type, max(strength) AS strength FROM raw_relations GROUP BY ALL)"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a part as its examples (relevance) and misconceptions (frequency): concept, name, relevance, frequency."""
    rows = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").cast("string").alias("concept"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("name")
    )
    return rows.agg(F.round(F.max(1 - F.col("l_tax")), 6).alias("relevance"), F.round(F.avg("l_discount"), 6).alias("frequency"))


EXAMPLES = """examples AS (SELECT CAST(l_partkey AS VARCHAR) AS concept, 's' || l_suppkey AS name, round(max(1 - l_tax), 6) AS relevance,
  round(avg(l_discount), 6) AS frequency FROM lineitem GROUP BY ALL)"""


def mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a customer has bought of a part, as mastery from 0 to 1: student_id, concept, mastery."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    both = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    bought = both.groupBy(F.col("o_custkey").alias("student_id"), F.col("l_partkey").cast("string").alias("concept"))
    return bought.agg(F.least(F.lit(1.0), F.sum("l_quantity") / 50).alias("mastery"))


MASTERY = """mastery AS (SELECT o_custkey AS student_id, CAST(l_partkey AS VARCHAR) AS concept, least(1.0, sum(l_quantity) / 50) AS mastery
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def stored_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mastery as a stored table with a student's rows together, which aggregate before a shuffle."""
    return stored(mastery(spark, sf_dir).hint("rebalance", "student_id"))


def requests(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """What each student asks for: the concept of smallest number bought, and as target the one of largest number."""
    number = F.col("concept").cast("long")
    picked = (known or mastery(spark, sf_dir)).groupBy("student_id").agg(F.min_by("concept", number).alias("concept"), F.max_by("concept", number).alias("target"))
    return picked.select("student_id", "concept", "target")


REQUESTS = """requests AS (SELECT student_id, arg_min(concept, CAST(concept AS BIGINT)) AS concept, arg_max(concept, CAST(concept AS BIGINT)) AS target
  FROM mastery GROUP BY student_id)"""


def emotion_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven scores from an event's value: session_id, event_id, ts, modality, probs, confidence, error."""
    weights = F.array(*[((F.floor(F.col("value") * 100) + 17 * i) % 97 + 1).cast("double") for i in range(7)])
    probs = normalised(weights)
    face = F.col("event_type").isin("purchase", "signup") | ((F.col("event_type") == "error") & (F.col("event_id") % 2 == 1))
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", "ts", F.when(face, "face").otherwise("audio").alias("modality"),
        F.when(~failed, probs).alias("probs"), F.when(failed, "no signal").alias("error"),
    )


_WEIGHT = "((CAST(floor(value * 100) AS BIGINT) + {}) % 97 + 1)"
_WEIGHTS = ", ".join(_WEIGHT.format(17 * i) for i in range(7))
EMOTIONS = f"""weights_ AS (SELECT *, list_transform([{_WEIGHTS}], lambda w: CAST(w AS DOUBLE)) AS w FROM events),
emotions AS (SELECT user_id AS session_id, event_id, ts,
  CASE WHEN event_type IN ('purchase', 'signup') OR (event_type = 'error' AND event_id % 2 = 1) THEN 'face' ELSE 'audio' END AS modality,
  CASE WHEN event_type <> 'error' THEN list_transform(w, lambda x: x / list_sum(w)) END AS probs,
  CASE WHEN event_type = 'error' THEN 'no signal' END AS error FROM weights_)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON message for each turn: user -> text, assistant -> text_result, system -> command; every seventh is broken."""
    kind = F.when(F.col("role") == "user", "text").when(F.col("role") == "assistant", "text_result").otherwise("command")
    body = F.to_json(
        F.struct(
            kind.alias("type"),
            F.concat_ws("-", "conv_id", "turn").alias("id"),
            F.struct("text", F.when(F.col("role") == "system", "init_session").alias("command")).alias("data"),
        )
    )
    broken = (F.col("conv_id") + F.col("turn")) % 7 == 6
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(broken, F.concat(F.lit("{"), body)).otherwise(body).alias("value")
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of sessions: session_id, seq, role, content."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of devices: device_id, metric, ts, event_id, value."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("device_id"), F.col("event_type").alias("metric"), "ts", "event_id", "value")
