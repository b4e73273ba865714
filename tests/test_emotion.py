import base64

from pyspark.sql import functions as F

from learnloom.functions import emotion as em
from learnloom.operators import emotions as ops, messages as m

PAIR = "session_id long, audio_probs array<double>, face_probs array<double>, audio_confidence double, face_confidence double, audio_error string, face_error string"


def fused(spark, audio, face, a=None, f=None):
    audio, face = (p and [float(x) for x in p] for p in (audio, face))
    df = spark.createDataFrame([(1, audio, face, a, f, None if audio else "none", None if face else "none")], PAIR)
    return ops.with_learning_states(ops.fuse_emotions(df)).first()


def test_fusion_golden(spark):
    r = fused(spark, [0, 0, 0, 0.7, 0.2, 0, 0.1], [0, 0, 0, 0.3, 0.1, 0, 0.6], 0.7, 0.6)
    assert r["emotion"] == "joy"
    assert [round(x, 6) for x in r["probs"]] == [0, 0, 0, 0.468, 0.142, 0, 0.39]
    assert [round(r[s], 4) for s in ("attention", "engagement", "understanding")] == [0.2674, 0.3652, 0.0022]


def test_one_side_and_errors(spark):
    r = fused(spark, None, [0, 0, 0, 0.3, 0.1, 0, 0.6])
    assert r["emotion"] == "surprise" and r["error"] is None
    assert fused(spark, None, None)["error"] == "none"


def test_reliability(spark):
    df = spark.createDataFrame([([0.25] * 4,), ([1.0],), ([],), (None,)], "p array<double>")
    got = [round(x[0], 9) for x in df.select(em.reliability(F.lit(None).cast("double"), F.col("p"))).collect()]
    assert got == [0, 1, 0.5, 0.5]


def test_smoothing_weights():
    assert [round(w, 6) for w in em.smoothing_weights(2)] == [0.268941, 0.731059]
    assert [round(w, 6) for w in em.smoothing_weights(5)] == [0.114051, 0.146444, 0.188038, 0.241445, 0.310022]
    assert em.smoothing_weights(1) == [1]


def test_strategy(spark):
    row = spark.range(1).select(em.teaching_strategy(F.lit("sadness"), F.lit(0.1), F.lit(0.8)).alias("s")).first()["s"]
    assert (row["tone"], row["pace"], row["detail_level"], row["example_count"], row["gestures"]) == ("encouraging", "slower", "advanced", 2, ["attention_seeking", "encouraging"])
    row = spark.range(1).select(em.teaching_strategy(F.lit(None).cast("string"), F.lit(None), F.lit(None)).alias("s")).first()["s"]
    assert (row["tone"], row["detail_level"], row["gestures"]) == ("neutral", "medium", [])


def test_routes(spark):
    rows = [('{"type": "text", "id": "1", "data": {"text": "hi"}}',), ('{"type": "x", "id": "2"}',), ("{bad",), ("[]",)]
    got = [(r["route"], r["id"]) for r in m.route_messages(spark.createDataFrame(rows, "value string")).collect()]
    assert got[:3] == [("text", "1"), ("error", "2"), ("error", "")] and got[3][0] == "error"


def test_log_text(spark):
    rows = [('{"message": "m", "data": {"text": "t"}}',), ('{"data": {"text": "t"}}',), ('{"data": {"a": 1}}',), ("plain",)]
    assert [r[0] for r in spark.createDataFrame(rows, "v string").select(m.log_message_text(F.col("v"))).collect()] == ["m", "t", '{"a":1}', "plain"]


def test_payloads(spark):
    rows = [(base64.b64encode(b"12345").decode(),), ("***",)]
    got = m.decode_payloads(spark.createDataFrame(rows, "payload string"), most=4).collect()
    assert [(r["size"], r["error"]) for r in got] == [(5, "too large"), (None, "not base64")]


def test_frames_of_signals_match_brute_force(spark):
    import math
    import random

    from learnloom.operators import emotions as ops

    rng = random.Random(3)
    signals = {"a": [rng.gauss(0, 1) for _ in range(70)], None: [rng.choice([-1.0, 0.0, 1.0]) for _ in range(40)], "short": [1.0] * 7, "gap": [rng.gauss(0, 1) for _ in range(48)], "nulls": [rng.gauss(0, 1) for _ in range(32)]}
    rows = [(k, i, v) for k, s in signals.items() for i, v in enumerate(s) if not (k == "gap" and i == 21)]
    rows = [(k, i, None if k == "nulls" and i % 8 == 5 else v) for k, i, v in rows]
    have = {(k, i): v for k, i, v in rows if v is not None}
    want = {}
    for key in signals:
        found = []
        for begin in range(0, 80, 4):
            frame = [have.get((key, begin + i)) for i in range(8)]
            if None not in frame:
                turns = sum((x >= 0) != (y >= 0) for x, y in zip(frame, frame[1:]))
                found.append((math.sqrt(sum(x * x for x in frame) / 8), turns / 8))
        if found:
            want[key] = (sum(e for e, _ in found) / len(found), sum(z for _, z in found) / len(found), len(found))
    got = {r["device"]: (r["energy"], r["zcr"], r["frames"]) for r in ops.frame_energy_zcr(spark.createDataFrame(rows, "device string, position long, value double"), ["device"], 8, 4).collect()}
    assert got.keys() == want.keys() == {"a", None, "gap"}
    assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))
