"""Emotion results, series and signals on the events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import emotion as em
from ..operators import emotions as ops
from . import bindings as b
from .registry import query

ORDER = ["ts", "event_id"]


def _pairs(spark, sf_dir):
    results = b.emotion_results(spark, sf_dir).withColumn("confidence", F.when(F.col("event_id") % 3 == 0, F.array_max("probs")))
    return ops.pair_modalities(results, ORDER)


def _fused(spark, sf_dir):
    return ops.fuse_emotions(_pairs(spark, sf_dir)).select("session_id", "n", "at.ts", "at.event_id", "probs", "emotion", "confidence", "error")


_REL = "CASE WHEN {0}_confidence IS NOT NULL THEN {0}_confidence WHEN {0}_probs IS NULL THEN 0.5::DOUBLE ELSE 1 + list_sum(list_transform({0}_probs, lambda p: p * ln(p))) / ln(7) END"
_MIXED = f"""w_ AS (SELECT *, {_REL.format('audio')} AS audio_rel, {_REL.format('face')} AS face_rel FROM p_),
 x_ AS (SELECT *, greatest(0.1, least(0.9, 0.4::DOUBLE - 0.2::DOUBLE * (face_rel - audio_rel))) AS wa, greatest(0.1, least(0.9, 0.6::DOUBLE + 0.2::DOUBLE * (face_rel - audio_rel))) AS wf FROM w_),
 y_ AS (SELECT *, CASE WHEN audio_probs IS NULL THEN face_probs WHEN face_probs IS NULL THEN audio_probs
  ELSE list_transform(audio_probs, lambda x, i: wa / (wa + wf) * x + wf / (wa + wf) * face_probs[i]) END AS mixed FROM x_)"""
_FUSED = f"""{b.EMOTIONS}, r_ AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN list_max(probs) END AS confidence, row_number() OVER (PARTITION BY session_id, modality ORDER BY ts, event_id) AS n FROM emotions),
 p_ AS (SELECT coalesce(a.session_id, f.session_id) AS session_id, coalesce(a.n, f.n) AS n, CASE WHEN f.ts IS NULL OR a.ts > f.ts THEN a.ts ELSE f.ts END AS ts,
  CASE WHEN f.ts IS NULL OR a.ts > f.ts THEN a.event_id ELSE f.event_id END AS event_id,
  a.probs AS audio_probs, f.probs AS face_probs, a.confidence AS audio_confidence, f.confidence AS face_confidence, a.error AS audio_error, f.error AS face_error
  FROM (SELECT * FROM r_ WHERE modality = 'audio') a FULL JOIN (SELECT * FROM r_ WHERE modality = 'face') f ON a.session_id = f.session_id AND a.n = f.n),
 {_MIXED}, fused AS (SELECT session_id, n, ts, event_id, CASE WHEN audio_probs IS NULL OR face_probs IS NULL THEN mixed ELSE list_transform(mixed, lambda x: x / list_sum(mixed)) END AS probs,
  CASE WHEN mixed IS NULL THEN coalesce(audio_error, face_error, 'no result') END AS error FROM y_)"""
_LABEL = "['anger', 'disgust', 'fear', 'joy', 'neutral', 'sadness', 'surprise'][list_position({0}, list_max({0}))]"


def _rounded(column: str):
    return F.transform(column, lambda x: F.round(x, 6)).alias(column)


@query(f"WITH {_FUSED} SELECT session_id, n, ts, event_id, list_transform(probs, lambda x: round(x, 6)) AS probs, {_LABEL.format('probs')} AS emotion, round(list_max(probs), 6) AS confidence, error FROM fused")
def fuse_emotions(spark, sf_dir):
    return _fused(spark, sf_dir).select("session_id", "n", "ts", "event_id", _rounded("probs"), "emotion", F.round("confidence", 6).alias("confidence"), "error")


@query(f"""WITH {b.EMOTIONS}, r_ AS (SELECT *, row_number() OVER (PARTITION BY session_id, modality ORDER BY ts, event_id) AS n FROM emotions),
 a AS (SELECT * FROM r_ WHERE modality = 'audio'), f AS (SELECT * FROM r_ WHERE modality = 'face')
SELECT coalesce(a.session_id, f.session_id) AS session_id, coalesce(a.n, f.n) AS n, a.error AS audio_error, f.error AS face_error FROM a FULL JOIN f ON a.session_id = f.session_id AND a.n = f.n""")
def pair_modalities(spark, sf_dir):
    return _pairs(spark, sf_dir).select("session_id", "n", "audio_error", "face_error")


_CLAMP = "round(greatest(0, least(1, {})), 6)"
_STATES = ", ".join(
    _CLAMP.format(" + ".join(f"({w})::DOUBLE * probs[{em.EMOTIONS.index(e) + 1}]" for e, w in parts.items())) + f" AS {name}" for name, parts in em.STATES.items()
)


@query(f"WITH {_FUSED} SELECT session_id, n, {_STATES} FROM fused WHERE probs IS NOT NULL")
def learning_states(spark, sf_dir):
    rows = ops.with_learning_states(_fused(spark, sf_dir).where("probs is not null"))
    return rows.select("session_id", "n", *[F.round(s, 6).alias(s) for s in em.STATES])


_W = "CASE len(past) " + " ".join(f"WHEN {n} THEN [{', '.join(f'{w!r}::DOUBLE' for w in em.smoothing_weights(n))}]" for n in range(1, 6)) + " END"
_MEAN = f"""k_ AS (SELECT *, {_W} AS w FROM h_),
 m_ AS (SELECT *, list_transform(range(1, 8), lambda e: list_sum(list_transform(past, lambda p, i: p[e] * w[i]))) AS mean FROM k_),
 smooth AS (SELECT * EXCLUDE (mean), list_transform(mean, lambda x: x / list_sum(mean)) AS smoothed FROM m_)"""
# Results are smoothed in the order in which their pairs are complete, which is that of n; those of one side come last.
_SMOOTH = f"""{_FUSED}, h_ AS (SELECT *, list(probs) OVER (PARTITION BY session_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS past FROM fused WHERE probs IS NOT NULL), {_MEAN}"""


@query(f"WITH {_SMOOTH} SELECT session_id, n, list_transform(smoothed, lambda x: round(x, 6)) AS smoothed, round(list_max(smoothed), 6) AS confidence FROM smooth")
def smooth_emotions(spark, sf_dir):
    rows = ops.smooth_emotions(_fused(spark, sf_dir), ["n"])
    return rows.select("session_id", "n", _rounded("smoothed"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {_FUSED}, s AS (SELECT session_id, n, {_LABEL.format('probs')} AS emotion, {_STATES} FROM fused WHERE probs IS NOT NULL)
SELECT session_id, n, CASE WHEN emotion = 'joy' THEN 'positive' WHEN emotion IN ('sadness', 'disgust') THEN 'encouraging' ELSE 'neutral' END AS tone,
 CASE WHEN emotion = 'joy' THEN 'slightly_faster' WHEN emotion IN ('sadness', 'disgust') THEN 'slower' ELSE 'normal' END AS pace,
 CASE WHEN understanding < 0.4 THEN 'very_basic' WHEN understanding > 0.7 THEN 'advanced' WHEN attention < 0.3 THEN 'low' ELSE 'medium' END AS detail_level,
 CASE WHEN attention < 0.3 THEN 2 ELSE 1 END AS example_count,
 array_to_string(list_filter([CASE WHEN attention < 0.3 THEN 'attention_seeking' END, CASE WHEN emotion IN ('sadness', 'disgust') THEN 'encouraging' END], lambda x: x IS NOT NULL), ',') AS gestures FROM s""")
def teaching_strategy(spark, sf_dir):
    rows = ops.with_learning_states(_fused(spark, sf_dir).where("probs is not null"))
    rounded = {s: F.round(s, 6) for s in em.STATES}
    rows = rows.withColumns(rounded).withColumn("s", em.teaching_strategy(F.col("emotion"), F.col("attention"), F.col("understanding")))
    return rows.select("session_id", "n", "s.tone", "s.pace", "s.detail_level", "s.example_count", F.array_join("s.gestures", ",").alias("gestures"))


@query(f"WITH {_FUSED}, s AS (SELECT session_id, n, event_id, {_STATES} FROM fused WHERE probs IS NOT NULL) SELECT session_id, n, attention FROM s WHERE event_id % 2 = 0 AND attention > 0 AND attention < 0.3")
def attention_alerts(spark, sf_dir):
    rows = ops.with_learning_states(_fused(spark, sf_dir).where("probs is not null")).withColumn("attention", F.round("attention", 6))
    return ops.attention_alerts(rows, face=F.col("event_id") % 2 == 0).select("session_id", "n", "attention")


_LIST = "list(round({0}, 6) ORDER BY ts, event_id) AS {1}"


@query(f"""WITH {_FUSED}, l AS (SELECT * FROM fused WHERE probs IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) <= 100)
SELECT session_id, list(strftime(ts, '%Y-%m-%d %H:%M:%S') ORDER BY ts, event_id) AS labels, {", ".join(_LIST.format(f"probs[{i + 1}]", e) for i, e in enumerate(em.EMOTIONS))} FROM l GROUP BY session_id""")
def emotion_series(spark, sf_dir):
    rows = ops.emotion_series(_fused(spark, sf_dir), ["session_id"], ORDER)
    return rows.select("session_id", "labels", *[_rounded(e) for e in em.EMOTIONS])


@query(f"""WITH {_FUSED}, s AS (SELECT session_id, ts, event_id, {_STATES} FROM fused WHERE probs IS NOT NULL),
 l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) <= 100)
SELECT session_id, list(strftime(ts, '%Y-%m-%d %H:%M:%S') ORDER BY ts, event_id) AS labels, {", ".join(_LIST.format(s, s) for s in em.STATES)} FROM l GROUP BY session_id""")
def learning_state_series(spark, sf_dir):
    rows = ops.with_learning_states(_fused(spark, sf_dir).where("probs is not null"))
    rows = ops.learning_state_series(rows, ["session_id"], ORDER)
    return rows.select("session_id", "labels", *[_rounded(s) for s in em.STATES])


@query(f"""WITH {_FUSED}, e AS (SELECT session_id, {_LABEL.format('probs')} AS emotion, lead({_LABEL.format('probs')}) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS next FROM fused WHERE probs IS NOT NULL)
SELECT emotion, next, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY emotion), 6) AS p FROM e WHERE next IS NOT NULL GROUP BY emotion, next""")
def emotion_transition_matrix(spark, sf_dir):
    rows = ops.emotion_transition_matrix(_fused(spark, sf_dir).where("probs is not null"), ORDER)
    return rows.withColumn("p", F.round("p", 6))


@query("SELECT user_id % 4 AS device_id, event_type AS metric, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 4, event_type ORDER BY ts DESC, event_id DESC) <= 100")
def bounded_series(spark, sf_dir):
    return ops.bounded_series(b.metrics(spark, sf_dir), ["device_id", "metric"], ORDER)


@query("""WITH g AS (SELECT user_id % 4 AS device_id, ts, event_id, value % 100 AS utilisation, value * 1048576 AS used_bytes, 80000.0::DOUBLE * 1048576 AS total_bytes FROM events),
 l AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, event_id DESC) <= 100)
SELECT device_id, list(strftime(ts, '%Y-%m-%d %H:%M:%S') ORDER BY ts, event_id) AS labels, list(round(utilisation, 6) ORDER BY ts, event_id) AS utilisation, list(round(used_bytes / 1048576, 6) ORDER BY ts, event_id) AS used_mb,
 list(round(80000.0::DOUBLE, 6) ORDER BY ts, event_id) AS total_mb FROM l GROUP BY device_id""")
def gpu_series(spark, sf_dir):
    rows = b.metrics(spark, sf_dir).select(
        "device_id", "ts", "event_id", (F.col("value") % 100).alias("utilisation"), (F.col("value") * 1048576).alias("used_bytes"), F.lit(80000.0 * 1048576).alias("total_bytes")
    )
    return ops.gpu_series(rows, ORDER).select("device_id", "labels", *[_rounded(c) for c in ("utilisation", "used_mb", "total_mb")])


@query("""WITH d AS (SELECT user_id AS frame, event_id AS box_id, value AS h, CAST(1 + event_id % 7 AS DOUBLE) AS w FROM events)
SELECT frame, box_id, h, w FROM d QUALIFY row_number() OVER (PARTITION BY frame ORDER BY h * w DESC, box_id) = 1""")
def largest_region_per_frame(spark, sf_dir):
    events = b.table(spark, sf_dir, "events")
    return ops.largest_region_per_frame(events.select(F.col("user_id").alias("frame"), F.col("event_id").alias("box_id"), F.col("value").alias("h"), (1 + F.col("event_id") % 7).cast("double").alias("w")))


@query("""WITH s AS (SELECT user_id % 4 AS device_id, date_trunc('hour', ts) AS start, ts, event_id, value - 50 AS value FROM events),
 c AS (SELECT *, CASE WHEN (lag(value) OVER (PARTITION BY device_id, start ORDER BY ts, event_id) >= 0) <> (value >= 0) THEN 1 ELSE 0 END AS crossed FROM s)
SELECT device_id, start, round(sqrt(avg(value * value)), 6) AS energy, round(avg(crossed), 6) AS zcr, count(*) AS samples FROM c GROUP BY device_id, start""")
def signal_energy_zcr(spark, sf_dir):
    samples = b.metrics(spark, sf_dir).select("device_id", "ts", "event_id", (F.col("value") - 50).alias("value"))
    rows = ops.signal_energy_zcr(samples, ["device_id"], ORDER)
    return rows.select("device_id", F.col("start").cast("timestamp_ntz").alias("start"), F.round("energy", 6).alias("energy"), F.round("zcr", 6).alias("zcr"), "samples")


@query("""WITH s AS (SELECT user_id % 4 AS device_id, value - 50 AS value, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS n FROM events),
 f AS (SELECT device_id, n AS begins FROM s WHERE n % 64 = 0),
 x AS (SELECT s.device_id, begins, n, value, lag(value) OVER (PARTITION BY s.device_id, begins ORDER BY n) AS before FROM f JOIN s ON s.device_id = f.device_id AND n >= begins AND n < begins + 256),
 g AS (SELECT device_id, begins, sqrt(sum(value * value) / 256) AS energy, sum(CASE WHEN (before >= 0) <> (value >= 0) THEN 1 ELSE 0 END) / 256 AS zcr FROM x GROUP BY ALL HAVING count(*) = 256)
SELECT device_id, round(avg(energy), 6) AS energy, round(avg(zcr), 6) AS zcr, count(*) AS frames FROM g GROUP BY device_id""")
def frame_energy_zcr(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("device_id").orderBy(*ORDER)) - 1
    samples = b.metrics(spark, sf_dir).select("device_id", place.alias("position"), (F.col("value") - 50).alias("value"))
    rows = ops.frame_energy_zcr(samples, ["device_id"], 256, 64)
    return rows.select("device_id", F.round("energy", 6).alias("energy"), F.round("zcr", 6).alias("zcr"), "frames")


@query("""WITH t AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings), m AS (SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) + 0 AS x FROM t GROUP BY ALL)
SELECT label, list(x ORDER BY pos) AS pooled FROM m GROUP BY label""")
def mean_pool_embeddings(spark, sf_dir):
    rows = ops.mean_pool_embeddings(b.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return rows.select("label", F.transform("pooled", lambda x: F.round(x, 6) + 0).alias("pooled"))


@query(f"""WITH l AS (SELECT vec_id, list_transform(embedding[1:7], lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding[1:7]) AS DOUBLE))) AS e FROM embeddings),
 p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM l)
SELECT vec_id, {_LABEL.format('probs')} AS emotion, round(list_max(probs), 6) AS confidence FROM p""")
def softmax_argmax(spark, sf_dir):
    probs = em.softmax(F.slice("embedding", 1, 7))
    rows = b.table(spark, sf_dir, "embeddings").select("vec_id", probs.alias("probs"))
    return rows.select("vec_id", em.label_of(F.col("probs")).alias("emotion"), F.round(F.array_max("probs"), 6).alias("confidence"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'joy' WHEN 'click' THEN 'fear' ELSE event_type END AS label, round(value / 100, 6) AS share FROM events")
def map_percent_scores(spark, sf_dir):
    scores = em.map_percent_scores(F.create_map("event_type", "value"), {"view": "joy", "click": "fear"})
    rows = b.table(spark, sf_dir, "events").select("event_id", F.explode(scores).alias("label", "share"))
    return rows.withColumn("share", F.round("share", 6))
