"""Messages and sessions on the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import messages as m
from . import bindings as b
from .recommend import _SCORED
from .registry import query

_KIND = "CASE role WHEN 'user' THEN 'text' WHEN 'assistant' THEN 'text_result' ELSE 'command' END"
_ROUTED = f"""r_ AS (SELECT conv_id AS session_id, turn AS seq, text, role, {_KIND} AS kind, conv_id || '-' || turn AS mid, (conv_id + turn) % 7 = 6 AS broken FROM conversations)"""


@query(f"""WITH {_ROUTED} SELECT session_id, seq, CASE WHEN NOT broken THEN kind END AS type, CASE WHEN broken THEN '' ELSE mid END AS id,
 CASE WHEN broken THEN 'invalid JSON' WHEN kind = 'text_result' THEN 'unsupported type: text_result' END AS error, CASE WHEN broken OR kind = 'text_result' THEN 'error' ELSE kind END AS route FROM r_""")
def route_messages(spark, sf_dir):
    return m.route_messages(b.messages(spark, sf_dir)).select("session_id", "seq", "type", "id", "error", "route")


def _commands(spark, sf_dir, known=None):
    """A command of each kind, and one that is unknown, by the student's number; some concepts are unknown too."""
    s, kinds = F.col("student_id"), F.array(*map(F.lit, [*m.COMMANDS, "dance"]))
    concept = F.when(s % 10 == 7, F.concat(F.lit("no "), "concept")).otherwise(F.col("concept"))
    params = F.struct(F.concat(F.lit("s"), s).alias("session_id"), s.alias("student_id"), concept.alias("concept"))
    data = F.to_json(F.struct(F.get(kinds, (s % 5).cast("int")).alias("command"), params.alias("params")))
    return b.requests(spark, sf_dir, known).select(F.concat(F.lit("m"), s).alias("id"), data.alias("data"))


@query(f"""WITH {_SCORED.format('0')}, q AS (SELECT student_id, CASE WHEN student_id % 10 = 7 THEN 'no ' || concept ELSE concept END AS concept, student_id % 5 AS kind FROM requests),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY student_id, concept ORDER BY score DESC, name, type) <= 5),
 r AS (SELECT student_id, concept, list(name ORDER BY score DESC, name, type) AS names FROM best GROUP BY ALL)
SELECT 'm' || q.student_id AS id, ['init_session', 'end_session', 'query_knowledge', 'recommend_knowledge', 'dance'][kind + 1] AS command,
 CASE kind WHEN 0 THEN 'session_m' || q.student_id WHEN 1 THEN 's' || q.student_id END AS session_id, CASE WHEN kind IN (2, 3) THEN q.concept END AS concept,
 CASE WHEN kind = 2 THEN n.description END AS definition, CASE WHEN kind = 2 THEN n.difficulty END AS difficulty, CASE WHEN kind = 2 THEN n.importance END AS importance,
 CASE WHEN kind = 3 THEN coalesce(names, []) END AS recommendations,
 CASE WHEN kind = 4 THEN 'unknown command: dance' WHEN kind = 2 AND n.name IS NULL THEN 'unknown concept: ' || q.concept END AS error
 FROM q LEFT JOIN nodes n ON n.name = q.concept LEFT JOIN r ON r.student_id = q.student_id AND r.concept = q.concept""")
def process_commands(spark, sf_dir):
    edges = b.edges(spark, sf_dir).drop("src_label", "dst_label")
    return m.process_commands(_commands(spark, sf_dir), b.nodes(spark, sf_dir), edges, b.mastery(spark, sf_dir))


@query(f"""WITH {_ROUTED} SELECT mid AS id, CASE WHEN role = 'system' THEN 'init_session' ELSE '' END AS command, CASE WHEN role = 'system' THEN 'session_' || mid END AS session_id,
 CAST(NULL AS VARCHAR) AS concept, CASE WHEN role <> 'system' THEN 'unknown command: ' END AS error FROM r_ WHERE NOT broken""")
def parse_commands(spark, sf_dir):
    rows = m.route_messages(b.messages(spark, sf_dir)).where("data is not null")
    return m.parse_commands(rows).drop("student_id")


_LOG = f"""l_ AS (SELECT session_id, seq, kind AS type, text AS message FROM r_ WHERE NOT broken UNION ALL
 SELECT session_id, seq, 'user_query', text FROM r_ WHERE NOT broken AND kind = 'text' AND coalesce(text, '') <> '')"""


def _log(spark, sf_dir):
    return m.with_user_queries(m.route_messages(b.messages(spark, sf_dir)).where("data is not null"))


@query(f"WITH {_ROUTED}, {_LOG} SELECT * FROM l_")
def user_query_log(spark, sf_dir):
    return _log(spark, sf_dir)


@query("SELECT conv_id AS session_id, turn AS seq, role, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations QUALIFY place <= 3")
def message_log(spark, sf_dir):
    return m.message_log(b.chats(spark, sf_dir), 3)


@query("SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def session_history(spark, sf_dir):
    return m.session_history(b.chats(spark, sf_dir), 2)


@query("SELECT conv_id AS session_id, min(turn) AS created_at, max(turn) AS last_active, count(*) AS messages FROM conversations GROUP BY conv_id")
def session_activity(spark, sf_dir):
    return m.session_activity(b.chats(spark, sf_dir))


@query("""WITH h AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Q: ' ELSE 'A: ' END || coalesce(text, '') AS line FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10),
 t AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS told FROM h GROUP BY conv_id), q AS (SELECT DISTINCT conv_id, 'What is next in ' || conv_id || '?' AS query FROM conversations)
SELECT q.conv_id AS session_id, query, 'Answer from the history.' || chr(10) || told || chr(10) || 'Q: ' || query || chr(10) || 'A:' AS prompt FROM q JOIN t ON q.conv_id = t.conv_id""")
def build_prompts(spark, sf_dir):
    chats = b.chats(spark, sf_dir)
    asked = chats.select("session_id").distinct().withColumn("query", F.concat(F.lit("What is next in "), "session_id", F.lit("?")))
    return m.build_prompts(chats, asked, "Answer from the history.", "Answer.")


STEPS = [("first", ["th"]), ("second", ["qu", "tion"]), ("third", ["ch"])]
_LADDER = "CASE WHEN contains(lower(text), 'th') THEN '{}' WHEN contains(lower(text), 'qu') OR contains(lower(text), 'tion') THEN '{}' WHEN contains(lower(text), 'ch') THEN '{}' ELSE '{}' END"


@query(f"""SELECT conv_id AS session_id, turn AS seq, {_LADDER.format('first', 'second', 'third', 'general')} AS intent, {_LADDER.format('first', 'second', 'third', 'general_query')} AS teaching,
 {_LADDER.format('first', 'second', 'third', '')} AS action FROM conversations""")
def detect_intents(spark, sf_dir):
    """detect_intent, detect_teaching_intent and tag_actions with keyword ladders for the invented prose."""
    c = F.col("content")
    return b.chats(spark, sf_dir).select(
        "session_id", "seq", tx.detect_intent(c, STEPS).alias("intent"), tx.detect_teaching_intent(c, STEPS).alias("teaching"), F.array_join(tx.tag_actions(c, STEPS), ",").alias("action")
    )


@query(r"""SELECT conv_id AS session_id, turn AS seq, CASE WHEN contains(text, ' the ') AND length(trim(split_part(text, ' the ', 1))) <= 20 THEN trim(split_part(text, ' the ', 1)) END AS concept FROM conversations""")
def extract_defined_concept(spark, sf_dir):
    return b.chats(spark, sf_dir).select("session_id", "seq", tx.extract_defined_concept(F.col("content"), [" the ", " is "]).alias("concept"))


@query(r"""WITH a AS (SELECT conv_id, turn, CASE WHEN contains(text, ', ') THEN regexp_replace(substr(text, strpos(text, ', ') + 2), '^\s+|\s+$', '', 'g') ELSE text END AS t FROM conversations),
 s AS (SELECT conv_id, turn, CASE WHEN contains(t, ' and ') THEN regexp_replace(split_part(t, ' and ', 1), '^\s+|\s+$', '', 'g') ELSE t END AS t FROM a)
SELECT conv_id AS session_id, turn AS seq, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT starts_with(x, ', ') AND NOT starts_with(x, ' and ')), chr(10)) AS content FROM s""")
def strip_role_labels(spark, sf_dir):
    return b.chats(spark, sf_dir).select("session_id", "seq", tx.strip_role_labels(F.col("content"), [", "], " and ").alias("content"))


@query(f"""WITH {b.NODES}, q AS (SELECT conv_id AS session_id, CAST(conv_id AS VARCHAR) AS concept FROM conversations GROUP BY conv_id)
SELECT q.concept, session_id, description AS definition, difficulty, importance, n.name IS NOT NULL AS found FROM q LEFT JOIN nodes n ON n.name = q.concept""")
def query_knowledge(spark, sf_dir):
    asked = b.chats(spark, sf_dir).select("session_id", F.col("session_id").cast("string").alias("concept")).distinct()
    return m.query_knowledge(asked, b.nodes(spark, sf_dir))


_TURN = "CASE WHEN contains(lower(text), 'qu') THEN 'example_request' WHEN contains(lower(text), 'ch') THEN 'misconception_query' WHEN contains(lower(text), 'sh') THEN 'related_concepts' WHEN contains(lower(text), 'th') THEN 'concept_explanation' ELSE 'general_query' END"
_MOOD = """CASE event_type WHEN 'view' THEN 'joy' WHEN 'click' THEN 'sadness' ELSE 'neutral' END AS emotion, round(value / 100 % 1, 6) AS attention, round(value / 10 % 1, 6) AS understanding"""


@query(f"""WITH {b.NODES}, {b.EDGES}, {b.EXAMPLES}, c AS (SELECT concept, name, row_number() OVER (PARTITION BY concept ORDER BY relevance DESC, name) AS good, row_number() OVER (PARTITION BY concept ORDER BY frequency DESC, name) AS bad FROM examples),
 x AS (SELECT concept, list(name ORDER BY good) FILTER (good <= 2) AS shown, list(name ORDER BY bad) FILTER (bad <= 1) AS wrong FROM c GROUP BY concept),
 k AS (SELECT e.src AS concept, n.name, row_number() OVER (PARTITION BY e.src ORDER BY e.strength DESC, n.name, e.type) AS place FROM edges e JOIN nodes n ON n.name = e.dst),
 l AS (SELECT concept, list(name ORDER BY place) AS near FROM k WHERE place <= 3 GROUP BY concept),
 o AS (SELECT user_id, {_MOOD} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
 q AS (SELECT conv_id AS session_id, turn AS seq, CAST(1 + (conv_id + turn) % 250 AS VARCHAR) AS concept, {_TURN} AS intent FROM conversations WHERE role = 'user')
SELECT session_id, seq, q.concept, intent, o.emotion, CASE WHEN emotion = 'joy' THEN 'positive' WHEN emotion = 'sadness' THEN 'encouraging' ELSE 'neutral' END AS tone,
 CASE WHEN coalesce(understanding, 0.5) < 0.4 THEN 'very_basic' WHEN coalesce(understanding, 0.5) > 0.7 THEN 'advanced' WHEN coalesce(attention, 0.5) < 0.3 THEN 'low' ELSE 'medium' END AS detail_level,
 array_to_string(coalesce(CASE intent WHEN 'concept_explanation' THEN CASE WHEN n.name IS NOT NULL THEN [n.description] END
  WHEN 'example_request' THEN shown[1:CASE WHEN coalesce(attention, 0.5) < 0.3 THEN 2 ELSE 1 END] WHEN 'misconception_query' THEN wrong WHEN 'related_concepts' THEN near END, []), '; ') AS answer
 FROM q LEFT JOIN nodes n ON n.name = q.concept LEFT JOIN x ON x.concept = q.concept LEFT JOIN l ON l.concept = q.concept LEFT JOIN o ON o.user_id = q.session_id""")
def teaching_turns(spark, sf_dir):
    steps = [("example_request", ["qu"]), ("misconception_query", ["ch"]), ("related_concepts", ["sh"]), ("concept_explanation", ["th"])]
    asked = b.chats(spark, sf_dir).where("role = 'user'").withColumn("concept", (1 + (F.col("session_id") + F.col("seq")) % 250).cast("string"))
    mood = F.when(F.col("event_type") == "view", "joy").when(F.col("event_type") == "click", "sadness").otherwise("neutral")
    moods = b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("at"), mood.alias("emotion"),
        F.round(F.col("value") / 100 % 1, 6).alias("attention"), F.round(F.col("value") / 10 % 1, 6).alias("understanding"),
    )
    edges, examples = b.edges(spark, sf_dir).drop("src_label", "dst_label"), b.examples(spark, sf_dir)
    rows = m.teaching_turns(asked, b.nodes(spark, sf_dir), edges, examples, examples, moods, steps)
    return rows.select("session_id", "seq", "concept", "intent", "emotion", "strategy.tone", "strategy.detail_level", F.array_join("answer", "; ").alias("answer"))


@query("""SELECT conv_id AS session_id, turn AS seq, strlen(text) AS size, CASE WHEN strlen(text) > 100 THEN 'too large' END AS error FROM conversations WHERE text IS NOT NULL""")
def decode_payloads(spark, sf_dir):
    sent = b.chats(spark, sf_dir).where("content is not null").withColumn("payload", F.base64(F.col("content").cast("binary")))
    return m.decode_payloads(sent, most=100).select("session_id", "seq", F.col("size").cast("long").alias("size"), "error")


@query("SELECT user_id AS server, event_type AS status, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_status(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("server"), F.col("event_type").alias("status"), "ts", "event_id")
    return m.latest_status(rows, "server", ["ts", "event_id"])


@query("""SELECT user_id AS session_id, arg_max(CASE WHEN event_type = 'view' THEN CAST(event_id AS VARCHAR) END, (ts, event_id)) FILTER (event_type = 'view') AS concept,
 arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS emotion FROM events GROUP BY user_id""")
def current_session_state(spark, sf_dir):
    view = F.col("event_type") == "view"
    rows = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id", F.when(view, F.col("event_id").cast("string")).alias("concept"), F.when(~view, F.col("event_type")).alias("emotion"))
    return m.current_session_state(rows, ["ts", "event_id"])


@query("SELECT user_id, event_type, arg_min(value, event_id) AS value, min(event_id) AS event_id, count(*) AS answers FROM events GROUP BY user_id, event_type")
def dedupe_requests(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return m.dedupe_requests(rows, ["user_id", "event_type"], "event_id")


@query(f"""WITH {b.NODES} SELECT name AS concept, CASE difficulty WHEN 1 THEN 'very_basic' WHEN 5 THEN 'expert' ELSE 'medium' END AS detail_level, CASE WHEN importance > 3 THEN 'positive' ELSE 'neutral' END AS tone,
 'Explain "' || name || '". ' || CASE difficulty WHEN 1 THEN '{m.DETAILS['very_basic']}' WHEN 5 THEN '{m.DETAILS['expert']}' ELSE '{m.DETAILS['medium']}' END || ' ' ||
 CASE WHEN importance > 3 THEN '{m.TONES['positive']}' ELSE '{m.TONES['neutral']}' END || ' Give a definition, key properties and an example.' AS prompt FROM nodes""")
def teaching_prompts(spark, sf_dir):
    level = F.when(F.col("difficulty") == 1, "very_basic").when(F.col("difficulty") == 5, "expert").otherwise("medium")
    asked = b.nodes(spark, sf_dir).select(F.col("name").alias("concept"), level.alias("detail_level"), F.when(F.col("importance") > 3, "positive").otherwise("neutral").alias("tone"))
    return m.teaching_prompts(asked)
