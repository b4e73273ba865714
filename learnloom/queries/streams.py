"""Streams over the tables' files, drained until what is there now is done."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as st
from ..operators import emotions as ops, messages as m
from ..sources.tables import BatchSink, Tables
from ..storage import shared_path, stored
from . import bindings as b
from .emotions import _LABEL, _MEAN, _MIXED, _STATES
from .messages import _LOG, _ROUTED
from .registry import ORACLES, query


def _drained(stream, spark):
    """State in as many partitions as tasks run at a time."""
    return st.drained(stream, spark, partitions=spark.sparkContext.defaultParallelism)


def _stream(spark, sf_dir, name):
    return b.table(_Streamed(spark), sf_dir, name)


class _Streamed:
    """Stands in for the session where a binding reads a table, and reads it as a stream."""

    def __init__(self, spark):
        self.read, self.spark = self, spark

    def parquet(self, path):
        # A file source takes a folder or a pattern, and a table may be one file.
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


@query(f"""WITH {_ROUTED} SELECT session_id, seq, CASE WHEN NOT broken THEN kind END AS type, CASE WHEN broken THEN '' ELSE mid END AS id,
 CASE WHEN broken THEN 'invalid JSON' WHEN kind = 'text_result' THEN 'unsupported type: text_result' END AS error FROM r_""")
def stream_route_messages(spark, sf_dir):
    routed = m.route_messages(b.messages(_Streamed(spark), sf_dir)).select("session_id", "seq", "type", "id", "error")
    return _drained(routed, spark)


@query(f"WITH {_ROUTED}, {_LOG} SELECT session_id, seq, message, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC, message DESC) AS place FROM l_ QUALIFY place <= 3")
def stream_message_log(spark, sf_dir):
    log = m.with_user_queries(m.route_messages(b.messages(_Streamed(spark), sf_dir)).where("data is not null"))
    return _drained(st.stream_message_log(log.select("session_id", "seq", "message"), 3), spark)


@query(f"""WITH {b.EMOTIONS}, s AS (SELECT session_id, event_id, {_STATES} FROM emotions WHERE probs IS NOT NULL AND modality = 'face')
SELECT session_id, event_id, attention FROM s WHERE attention > 0 AND attention < 0.3""")
def stream_attention_alerts(spark, sf_dir):
    rows = ops.with_learning_states(b.emotion_results(_Streamed(spark), sf_dir).where("probs is not null"))
    rows = rows.withColumn("attention", F.round("attention", 6))
    return _drained(ops.attention_alerts(rows, face=F.col("modality") == "face").select("session_id", "event_id", "attention"), spark)


WAIT, LATE = 6 * 3600, 600  # seconds

# Sessions end after WAIT. The n-th results of both sides of a session pair; of a session that has ended, those left over go out alone.
_STREAMED = f"""{b.EMOTIONS}, o_ AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN list_max(probs) END AS confidence, epoch(ts) AS sec FROM emotions),
 g_ AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY session_id ORDER BY ts, event_id) > {WAIT} THEN 1 ELSE 0 END AS new FROM o_),
 i_ AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS part FROM g_),
 e_ AS (SELECT *, max(sec) OVER (PARTITION BY session_id, part) AS ends, max(part) OVER (PARTITION BY session_id) AS parts, (SELECT max(sec) FROM i_) AS now FROM i_),
 r_ AS (SELECT *, part < parts OR ends + {WAIT} < now - {LATE} AS over, row_number() OVER (PARTITION BY session_id, part, modality ORDER BY ts, event_id) AS n FROM e_),
 p_ AS (SELECT coalesce(a.session_id, f.session_id) AS session_id, coalesce(a.part, f.part) AS part, coalesce(a.n, f.n) AS n,
  CASE WHEN f.ts IS NULL THEN a.event_id WHEN a.ts IS NULL THEN f.event_id WHEN (a.ts, a.event_id) > (f.ts, f.event_id) THEN a.event_id ELSE f.event_id END AS event_id,
  a.probs AS audio_probs, f.probs AS face_probs, a.confidence AS audio_confidence, f.confidence AS face_confidence, a.error AS audio_error, f.error AS face_error
  FROM (SELECT * FROM r_ WHERE modality = 'audio') a FULL JOIN (SELECT * FROM r_ WHERE modality = 'face') f ON a.session_id = f.session_id AND a.part = f.part AND a.n = f.n
  WHERE (a.ts IS NOT NULL AND f.ts IS NOT NULL) OR coalesce(a.over, f.over)),
 {_MIXED}, fused AS (SELECT session_id, part, n, event_id, CASE WHEN audio_probs IS NULL OR face_probs IS NULL THEN mixed ELSE list_transform(mixed, lambda x: x / list_sum(mixed)) END AS probs,
  CASE WHEN mixed IS NULL THEN coalesce(audio_error, face_error, 'no result') END AS error FROM y_),
 h_ AS (SELECT *, list(probs) OVER (PARTITION BY session_id, part ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS past FROM fused WHERE probs IS NOT NULL), {_MEAN}"""


@query(f"""WITH {_STREAMED} SELECT session_id, event_id, {_LABEL.format('smoothed')} AS emotion, round(list_max(smoothed), 6) AS confidence, NULL AS error FROM smooth
 UNION ALL SELECT session_id, event_id, NULL, NULL, error FROM fused WHERE probs IS NULL""")
def stream_fuse_and_smooth(spark, sf_dir):
    rows = b.emotion_results(_Streamed(spark), sf_dir).withColumn("confidence", F.when(F.col("event_id") % 3 == 0, F.array_max("probs")))
    rows = rows.select("session_id", "modality", "probs", "confidence", "error", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return _drained(st.stream_fuse_and_smooth(rows, wait=float(WAIT), late=f"{LATE} seconds"), spark).withColumn("confidence", F.round("confidence", 6))


def _activity(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS part FROM g)
SELECT user_id AS session_id, min(ts) AS created_at, max(ts) AS last_active, count(*) AS messages FROM s GROUP BY user_id, part""")
def stream_session_activity(spark, sf_dir):
    """The sessions that end within the stream, and those still open at its watermark."""
    closed = _drained(st.stream_session_activity(_activity(_Streamed(spark), sf_dir)), spark)
    every = st.with_open_sessions(closed, _activity(spark, sf_dir))
    return every.select("session_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "last_active")], "messages")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_requests(spark, sf_dir):
    """The tables' files are one batch, within which no state expires."""
    rows = _stream(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(st.stream_dedupe_requests(rows, ["user_id", "event_type"]), spark).select("user_id", "event_type")


@query("SELECT user_id % 4 AS device_id, event_type AS metric, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 4, event_type ORDER BY ts DESC, event_id DESC) <= 100")
def stream_metric_series(spark, sf_dir):
    landed = _drained(b.metrics(_Streamed(spark), sf_dir), spark)
    return ops.bounded_series(landed, ["device_id", "metric"], ["ts", "event_id"])


@query(f"""WITH {_ROUTED} SELECT CASE WHEN broken OR kind = 'text_result' THEN 'error' ELSE kind END AS name, session_id, seq, CASE WHEN broken THEN '' ELSE mid END AS id,
 CASE WHEN NOT broken AND kind = 'text' THEN text END AS text, CASE WHEN NOT broken AND kind = 'command' THEN 'init_session' END AS command,
 CASE WHEN NOT broken AND kind = 'command' THEN 'session_' || mid END AS asked_session_id,
 CASE WHEN broken THEN 'invalid JSON' WHEN kind = 'text_result' THEN 'unsupported type: text_result' END AS error FROM r_""")
def stream_typed_tables(spark, sf_dir):
    """One stream of messages into a table for each kind, by a sink that writes a batch once."""
    path = shared_path(spark, "messages")
    sink = BatchSink(spark, path, m.typed_messages)
    sink.drain(b.messages(_Streamed(spark), sf_dir), f"{path}/_checkpoint")
    columns = ["session_id", "seq", "id", "text", "command", "asked_session_id", "error"]
    every = None
    for name in ("audio", "image", "text", "command", "error"):
        own = sink.read(name)
        rows = own.select(F.lit(name).alias("name"), *[F.col(c) if c in own.columns else F.lit(None).cast("string").alias(c) for c in columns])
        every = rows if every is None else every.unionByName(rows)
    return every


@query(ORACLES["process_commands"])
def stream_process_commands(spark, sf_dir):
    """Commands answered as they come, from stored tables of the graph."""
    from .messages import _commands

    tables, path = Tables(spark, shared_path(spark, "graph")), shared_path(spark, "answers")
    graph = {"nodes": b.nodes(spark, sf_dir), "edges": b.edges(spark, sf_dir).drop("src_label", "dst_label"), "mastery": b.mastery(spark, sf_dir)}
    tables.replace_all(graph, {"nodes": (["label", "name"], 8), "edges": (["src", "dst", "type"], 8)})
    landed = stored(_commands(spark, sf_dir, tables.read("mastery")))
    sink = BatchSink(spark, path, st.command_answers(tables))
    sink.drain(spark.readStream.schema(landed.schema).parquet(landed.stored_path), f"{path}/_checkpoint")
    return sink.read("answers").drop("_writer", "_batch")


# Rows in the order of the stream; a row is fresh where no session is open.
_ENDED = f"""e_ AS (SELECT user_id, ts, event_type = 'error' AS ends, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER o AS prev, lag(event_type = 'error') OVER o AS closed,
  max(epoch_us(ts)) OVER (PARTITION BY user_id) AS latest, (SELECT max(epoch_us(ts)) FROM events) AS now FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_type = 'error')),
 f_ AS (SELECT *, prev IS NULL OR closed OR us - prev > {WAIT * 1_000_000} AS fresh FROM e_),
 p_ AS (SELECT *, sum(CASE WHEN fresh AND NOT ends THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, ends ROWS UNBOUNDED PRECEDING) AS part FROM f_),
 s_ AS (SELECT user_id AS session_id, min(ts) AS created_at, max(ts) AS last_active, max(us) AS last, count(*) AS messages, bool_or(ends) AS told, max(latest) AS latest, max(now) AS now
  FROM p_ WHERE NOT (fresh AND ends) GROUP BY user_id, part)"""


@query(f"""WITH {_ENDED} SELECT session_id, created_at, last_active, messages, CASE WHEN told THEN 'command' ELSE 'idle' END AS ended_by
 FROM s_ WHERE told OR latest > last OR last + {WAIT * 1_000_000} < now - {LATE * 1_000_000}""")
def stream_sessions(spark, sf_dir):
    """Sessions that end by an error event, or by themselves, within the stream."""
    rows = b.table(_Streamed(spark), sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("ends")
    )
    ended = _drained(st.stream_sessions(rows, float(WAIT), f"{LATE} seconds"), spark)
    return ended.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_active")})


# The cache of each server, a request at a time.
_CACHED = """WITH RECURSIVE q_ AS (SELECT user_id % 4 AS server, event_id AS seq, event_type || '-' || CAST(floor(value) AS BIGINT) % 40 AS asked,
  row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS n FROM events),
 c_ AS (SELECT DISTINCT server, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS kept, CAST(NULL AS VARCHAR) AS asked, false AS hit FROM q_
  UNION ALL SELECT q_.server, q_.seq, q_.n, CASE WHEN list_contains(kept, q_.asked) THEN kept ELSE list_append(kept, q_.asked)[-100:] END, q_.asked, list_contains(kept, q_.asked)
  FROM c_ JOIN q_ ON q_.server = c_.server AND q_.n = c_.n + 1)
SELECT server, seq, asked, hit FROM c_ WHERE n > 0"""


def _asked(session, sf_dir):
    kind = F.floor("value").cast("long") % 40
    return b.table(session, sf_dir, "events").select((F.col("user_id") % 4).alias("server"), F.col("event_id").alias("seq"), F.concat_ws("-", "event_type", kind).alias("asked"))


@query(_CACHED)
def cached_requests(spark, sf_dir):
    return m.cached_requests(_asked(spark, sf_dir), ["asked"], "server", "seq")


@query(_CACHED)
def stream_cached_requests(spark, sf_dir):
    return _drained(st.stream_cached_requests(_asked(_Streamed(spark), sf_dir)), spark)


@query(ORACLES["mine_definitions"])
def stream_point_batches(spark, sf_dir):
    """Points of pages as they come: each batch of pages writes the points it brings, once, and none of those before."""
    from ..operators import mining

    path = shared_path(spark, "points")
    mined = lambda pages: mining.mine_definitions(pages, [b.DEFINITION]).withColumn("importance", (1 + F.col("page") % 5).cast("int")).withColumn("difficulty", (1 + F.length("definition") % 5).cast("int"))
    sink = BatchSink(spark, path, lambda pages: {"points": mined(pages)})
    sink.drain(b.pages(_Streamed(spark), sf_dir), f"{path}/_checkpoint")
    return sink.read("points").drop("_writer", "_batch")
