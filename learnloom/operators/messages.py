"""Messages and sessions: routing, logs, histories, prompts, commands."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions import text as tx

KINDS = ("audio", "image", "text", "command")
ENVELOPE = "type string, id string, data string"


def route_messages(messages: DataFrame, value: str = "value", kinds=KINDS) -> DataFrame:
    """Parses JSON messages: adds type, id, data (JSON text), route and error; works on streams too.

    Broken JSON goes to the error route with an empty id, an unknown type with its own id.
    """
    parsed = F.from_json(value, ENVELOPE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = messages.withColumn("m", parsed)
    bad = F.col("m").isNull() | F.col("m._bad").isNotNull()
    known = F.col("type").isin(*kinds)
    rows = rows.withColumns({"type": F.when(~bad, F.col("m.type")), "id": F.when(bad, "").otherwise(F.coalesce("m.id", F.lit(""))), "data": F.when(~bad, F.col("m.data")), "broken": bad}).drop("m")
    error = F.when(F.col("broken"), "invalid JSON").when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unsupported type: "), F.coalesce("type", F.lit(""))))
    return rows.withColumn("error", error).withColumn("route", F.when(F.col("error").isNull(), F.col("type")).otherwise("error")).drop("broken")


def typed_messages(messages: DataFrame, most: int = 10 * 2**20) -> dict[str, DataFrame]:
    """A table for each kind of message, and one of those that cannot be routed; all have session_id, seq and id.

    ``audio`` and ``image`` have their payload as bytes, its size and an error where it does not decode, is larger than
    ``most``, or is a raw image without a shape; ``text`` has text and context; ``command`` what :func:`parse_commands`
    gives; ``error`` type, error and value.
    """
    rows = route_messages(messages)
    of = lambda kind: rows.where(F.col("route") == kind)
    data = lambda field: F.get_json_object("data", f"$.{field}")
    own = ["session_id", "seq", "id"]

    def payload(kind: str, plain: str, **more: Column) -> DataFrame:
        sent = of(kind).select(*own, F.coalesce(data("format"), F.lit(plain)).alias("format"), F.coalesce(data("data"), F.lit("")).alias("payload"), *[c.alias(n) for n, c in more.items()])
        return decode_payloads(sent, most=most).drop("payload")

    rate = F.coalesce(data("sample_rate").cast("int"), F.lit(16000))
    image = payload("image", "jpeg", shape=F.from_json(data("shape"), "array<int>"))
    raw = ~F.col("format").isin("jpeg", "jpg", "png") & F.col("shape").isNull()
    return {
        "audio": payload("audio", "wav", sample_rate=rate),
        "image": image.withColumn("error", F.coalesce("error", F.when(raw, "no shape"))),
        "text": of("text").select(*own, data("text").alias("text"), data("context").alias("context")),
        "command": parse_commands(of("command"), ["session_id", "seq"]),
        "error": of("error").select(*own, "type", "error", "value"),
    }


def log_message_text(value: Column) -> Column:
    """What a log shows of a message: its message, else the text of its data, else its data, else all of it."""
    text, data = F.get_json_object(value, "$.data.text"), F.get_json_object(value, "$.data")
    return F.coalesce(F.get_json_object(value, "$.message"), text, F.when(data.startswith("{"), data), value)


def with_user_queries(messages: DataFrame) -> DataFrame:
    """Log rows (session_id, seq, type, message) of messages: a text message adds a row of type user_query."""
    text = F.get_json_object("value", "$.data.text")
    asked = (F.col("type") == "text") & (F.coalesce(text, F.lit("")) != "")
    own = F.struct(F.col("type").alias("type"), log_message_text(F.col("value")).alias("message"))
    more = F.struct(F.lit("user_query").alias("type"), text.alias("message"))
    rows = F.when(asked, F.array(own, more)).otherwise(F.array(own))
    return messages.select("session_id", "seq", F.inline(rows))


def message_log(messages: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` messages of each session: adds place, 1 for the newest."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    return messages.withColumn("place", place).where(F.col("place") <= n)


def session_history(messages: DataFrame, max_messages: int = 10) -> DataFrame:
    """The last messages of each session; all if ``max_messages`` is not positive."""
    return messages if max_messages <= 0 else message_log(messages, max_messages).drop("place")


def session_activity(messages: DataFrame, at: str = "seq") -> DataFrame:
    return messages.groupBy("session_id").agg(F.min(at).alias("created_at"), F.max(at).alias("last_active"), F.count("*").alias("messages"))


def build_prompts(messages: DataFrame, queries: DataFrame, instruction: str, plain: str, max_messages: int = 10) -> DataFrame:
    """A prompt for each query (session_id, query): instruction, rendered history, query; ``plain`` without a history."""
    line = F.concat(F.when(F.col("role") == "user", "Q: ").otherwise("A: "), F.coalesce("content", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    told = session_history(messages, max_messages).groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("told"))
    rows = queries.join(told, "session_id", "left")
    with_history = F.concat_ws("\n", F.lit(instruction), "told", F.concat(F.lit("Q: "), "query"), F.lit("A:"))
    return rows.select("session_id", "query", F.when(F.col("told").isNotNull(), with_history).otherwise(F.concat_ws("\n", F.lit(plain), F.concat(F.lit("Q: "), "query"), F.lit("A:"))).alias("prompt"))


# Names of the levels of detail and tones. What they add to a prompt is our own.
DETAILS = {
    "very_basic": "No term without an image from daily life.",
    "basic": "Short sentences; a newcomer reads this.",
    "medium": "First the idea, then how it works.",
    "advanced": "Include the derivation.",
    "expert": "Name open questions and limits.",
}
TONES = {
    "encouraging": "Point out what the reader can do by now.",
    "neutral": "Keep to the facts.",
    "positive": "Show why it is worth knowing.",
    "empathetic": "Say which part takes most people long.",
}


def teaching_prompts(requests: DataFrame, details=DETAILS, tones=TONES) -> DataFrame:
    """A prompt for each (concept, detail_level, tone); an unknown level or tone adds nothing."""
    look = lambda table, c: F.coalesce(F.create_map(*[F.lit(x) for p in table.items() for x in p])[F.col(c)], F.lit(""))
    return requests.withColumn("prompt", F.concat_ws(" ", F.format_string('Explain "%s".', "concept"), look(details, "detail_level"), look(tones, "tone"), F.lit("Give a definition, key properties and an example.")))


def query_knowledge(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Definition, difficulty and importance of each asked concept; ``found`` tells whether it is known."""
    known = nodes.where("label = 'Concept'").select(F.col("name").alias("concept"), F.col("description").alias("definition"), "difficulty", "importance", F.lit(True).alias("found"))
    return requests.join(known, "concept", "left").withColumn("found", F.coalesce("found", F.lit(False)))


COMMANDS = ("init_session", "end_session", "query_knowledge", "recommend_knowledge")


def parse_commands(commands: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Commands (id, data) as command, session_id, student_id, concept and error; works on streams too.

    A new session is named after the message. Columns of ``keep`` stay; if session_id is one of them, that of the
    command is asked_session_id.
    """
    command = F.coalesce(F.get_json_object("data", "$.command"), F.lit(""))
    param = lambda p: F.get_json_object("data", f"$.params.{p}")
    session = F.when(command == "init_session", F.concat(F.lit("session_"), "id")).when(command == "end_session", F.coalesce(param("session_id"), F.lit("")))
    concept = F.when(command.isin(*COMMANDS[2:]), F.coalesce(param("concept"), F.lit("")))
    return commands.select(
        *keep, "id", command.alias("command"), session.alias("asked_session_id" if "session_id" in keep else "session_id"), param("student_id").cast("long").alias("student_id"), concept.alias("concept"),
        F.when(~command.isin(*COMMANDS), F.concat(F.lit("unknown command: "), command)).alias("error"),
    )


def process_commands(commands: DataFrame, nodes: DataFrame, edges: DataFrame, mastery: DataFrame, emotions: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """Answers to commands (id, data): those of :func:`parse_commands` with definition, difficulty and importance of a
    queried concept, and the names of recommended concepts, best first.

    An unknown concept is an error of a query; without a recommendation the array is empty. Commands that ask the same
    are answered together.
    """
    from .recommend import recommend_related_concepts

    rows = parse_commands(commands)
    asked = F.col("command") == "query_knowledge"
    wanted = rows.where(asked).select("concept").distinct()
    known = query_knowledge(wanted, nodes).where("found").select("concept", "definition", "difficulty", "importance", F.lit(True).alias("found"))
    told = rows.where("command = 'recommend_knowledge'").select("student_id", "concept").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("place", "name")))
    best = recommend_related_concepts(told, edges, nodes, mastery, emotions, limit).groupBy("student_id", "concept")
    best = best.agg(F.transform(ordered, lambda x: x["name"]).alias("recommendations"))
    one = rows.where(asked).join(known, "concept", "left").withColumn("recommendations", F.lit(None).cast("array<string>"))
    two = rows.where("command = 'recommend_knowledge'").join(best, ["student_id", "concept"], "left")
    two = two.withColumn("recommendations", F.coalesce("recommendations", F.array().cast("array<string>")))
    none = {c: F.lit(None).cast(k) for c, k in (("definition", "string"), ("difficulty", "int"), ("importance", "int"), ("found", "boolean"))}
    rest = rows.where(~F.col("command").isin(*COMMANDS[2:])).withColumns(none | {"recommendations": F.lit(None).cast("array<string>")})
    every = one.unionByName(two.withColumns(none)).unionByName(rest)
    lost = (F.col("command") == "query_knowledge") & F.col("found").isNull()
    error = F.when(lost, F.concat(F.lit("unknown concept: "), "concept")).otherwise(F.col("error"))
    return every.select("id", "command", "session_id", "concept", "definition", "difficulty", "importance", "recommendations", error.alias("error"))


def decode_payloads(messages: DataFrame, payload: str = "payload", most: int = 10 * 2**20) -> DataFrame:
    """Adds bytes, size and error: base64 that does not decode, or more than ``most`` bytes, is an error."""
    rows = messages.withColumn("bytes", F.try_to_binary(F.col(payload), F.lit("base64")))
    error = F.when(F.col("bytes").isNull(), "not base64").when(F.octet_length("bytes") > most, "too large")
    return rows.withColumns({"size": F.octet_length("bytes"), "error": error})


def latest_status(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    last = F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(*order))
    return events.groupBy(key).agg(last.alias("last")).select(key, "last.*")


def current_session_state(rows: DataFrame, order: list[str]) -> DataFrame:
    """The latest non-null concept and emotion of each session."""
    at = F.struct(*order)
    late = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c)
    return rows.groupBy("session_id").agg(late("concept"), late("emotion"))


def cached_requests(requests: DataFrame, key: list[str], server: str, order: str, entries: int = 100) -> DataFrame:
    """Each request (server, order, key) with ``hit``: whether its server's cache has the answer.

    A cache holds the answers of the last ``entries`` keys that were asked in vain; on a miss the key goes in and the oldest
    goes out, a hit changes nothing. A server's requests are gone through in order by one task, since each depends on those
    before it; the task holds the cache only. Null is a key, and a server, of its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = object(), FirstIn(entries)
        for batch in batches:
            hits = []
            for at, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != own:
                    own, cache = at, FirstIn(entries)
                hits.append(cache.ask(asked))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], [*batch.schema.names, "hit"])

    named = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    rows = requests.select(F.to_json(F.struct(server), {"ignoreNullFields": "false"}).alias("_server"), named.alias("_asked"), server, order, *key)
    dealt = rows.repartition("_server").sortWithinPartitions("_server", order, "_asked")
    return dealt.mapInArrow(run, StructType([*dealt.schema.fields, StructField("hit", BooleanType())])).drop("_server", "_asked")


class FirstIn:
    """The keys of a bounded cache in the order they came in."""

    def __init__(self, entries: int, keys: Sequence[str] = ()):
        self.entries, self.keys = entries, dict.fromkeys(keys)

    def ask(self, key: str) -> bool:
        """Whether the key is there; if not it goes in, and the oldest goes out of a full cache."""
        if key in self.keys:
            return True
        self.keys[key] = None
        if len(self.keys) > self.entries:
            del self.keys[next(iter(self.keys))]
        return False


def dedupe_requests(requests: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """The first request of each key, with the number of requests it answers."""
    rest = [c for c in requests.columns if c not in key]
    return requests.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("first"), F.count("*").alias("answers")).select(*key, "first.*", "answers")


def teaching_turns(
    queries: DataFrame, nodes: DataFrame, edges: DataFrame, examples: DataFrame, misconceptions: DataFrame, emotions: DataFrame,
    intents=tx.TEACHING_INTENTS, related: int = 3,
) -> DataFrame:
    """Each query (session_id, seq, content, concept) with its intent, the teaching strategy of its session and its answer.

    ``emotions`` (session_id, at, emotion, attention, understanding) gives the session's latest state; without one the
    strategy is neutral. The answer is an array: the definition of an explained concept, the names of as many examples as
    the strategy says, the commonest misconception, or up to ``related`` neighbours by strength and name; else empty.
    """
    from ..functions.emotion import teaching_strategy
    from .graph import concept_examples, concept_misconceptions, related_concepts

    asked = queries.withColumn("intent", tx.detect_teaching_intent(F.col("content"), intents))
    state = F.max_by(F.struct("emotion", "attention", "understanding"), "at").alias("state")
    rows = asked.join(emotions.groupBy("session_id").agg(state), "session_id", "left")
    strategy = teaching_strategy(F.coalesce("state.emotion", F.lit("neutral")), F.col("state.attention"), F.col("state.understanding"))
    rows = rows.withColumns({"emotion": F.col("state.emotion"), "strategy": strategy}).drop("state")
    names = asked.select(F.col("concept").alias("name")).distinct()

    def listed(found: DataFrame, concept: str, order: list[Column]) -> DataFrame:
        at = F.array_sort(F.collect_list(F.struct(*order, "name")))
        return found.groupBy(F.col(concept).alias("concept")).agg(F.transform(at, lambda x: x["name"]).alias("answer"))

    place = [F.col("place")]
    near = related_concepts(edges, nodes, names, limit=None)
    first = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("strength"), "name", "type")).alias("place")
    near = near.select("src", "name", first).where(F.col("place") <= related)
    answers = {
        "concept_explanation": query_knowledge(names.withColumnRenamed("name", "concept"), nodes).where("found").select("concept", F.array("definition").alias("answer")),
        "example_request": listed(concept_examples(examples, names, 2), "concept", place),
        "misconception_query": listed(concept_misconceptions(misconceptions, names, 1), "concept", place),
        "related_concepts": listed(near, "src", place),
    }
    every = None
    for intent, found in answers.items():
        part = found.select("concept", F.lit(intent).alias("intent"), "answer")
        every = part if every is None else every.unionByName(part)
    rows = rows.join(every, ["concept", "intent"], "left").withColumn("answer", F.coalesce("answer", F.array().cast("array<string>")))
    return rows.withColumn("answer", F.when(F.col("intent") == "example_request", F.slice("answer", 1, F.col("strategy.example_count"))).otherwise(F.col("answer")))
