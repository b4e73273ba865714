from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from learnloom import streaming as st
from learnloom.operators import emotions as ops

BASE = datetime(2024, 1, 1)
RESULT = "session_id long, modality string, probs array<double>, confidence double, error string, ts timestamp, event_id long"


def probs(seed):
    w = [(seed * 31 + 17 * i) % 97 + 1.0 for i in range(7)]
    return [x / sum(w) for x in w]


def results():
    """Two sessions with errors, confidences and sides that stay alone."""
    rows = []
    for i in range(40):
        failed = i % 9 == 4
        kind = "audio" if i % 3 else "face"
        rows.append((i % 2, kind, None if failed else probs(i), 0.7 if i % 5 == 0 and not failed else None, "no signal" if failed else None, BASE + timedelta(seconds=20 * i), i))
    return rows


def landed(spark, tmp_path, batches):
    """A stream over one file for each batch, in order."""
    folder = str(tmp_path / "in")
    for rows, schema in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        yield folder, schema


def stream_of(spark, folder, schema, files=None):
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def fused_in_batch(spark, rows):
    pairs = ops.pair_modalities(spark.createDataFrame(rows, RESULT), ["ts", "event_id"])
    fused = ops.fuse_emotions(pairs).select("session_id", "n", F.col("at.event_id").alias("event_id"), "probs", "emotion", "confidence", "error")
    good = ops.smooth_emotions(fused, ["n"]).select("session_id", "event_id", "emotion", F.round("confidence", 9), "error")
    bad = fused.where("probs is null").select("session_id", "event_id", F.lit(None).cast("string"), F.lit(None).cast("double"), "error")
    return sorted(map(tuple, good.union(bad).collect()), key=str)


def out(df):
    return sorted(map(tuple, df.select("session_id", "event_id", "emotion", F.round("confidence", 9), "error").collect()), key=str)


@pytest.mark.parametrize("cuts", [[40], [13, 29, 40]])
def test_stream_fuses_as_the_batch_does(spark, tmp_path, cuts):
    rows = results()
    last = (9, "audio", probs(1), None, None, BASE + timedelta(days=2), 1000)  # moves the watermark past the end of the sessions
    parts = [rows[a:b] for a, b in zip([0, *cuts], cuts)] + [[last]]
    got = None
    for folder, schema in landed(spark, tmp_path, [(p, RESULT) for p in parts]):
        stream = st.stream_fuse_and_smooth(stream_of(spark, folder, schema), wait=3600.0)
        got = st.drained(stream, spark, str(tmp_path / "out"), str(tmp_path / "state"))
    assert out(got) == fused_in_batch(spark, rows)


def test_a_lonely_result_waits_for_its_partner_and_then_goes_out_alone(spark, tmp_path):
    at = lambda s: BASE + timedelta(seconds=s)
    row = lambda kind, s, i: (1, kind, probs(i), None, None, at(s), i)
    counts = []
    batches = [[row("audio", 0, 1)], [row("audio", 60, 2), row("face", 70, 3)], [row("audio", 9000, 4)], [(2, "face", probs(5), None, None, at(90_000), 5)]]
    for folder, schema in landed(spark, tmp_path, [(b, RESULT) for b in batches]):
        stream = st.stream_fuse_and_smooth(stream_of(spark, folder, schema), wait=3600.0)
        counts.append(sorted(r["event_id"] for r in st.drained(stream, spark, str(tmp_path / "out"), str(tmp_path / "state")).collect()))
    # 1 pairs with 3; 2 goes out when the session's next result comes too late; 4 when the watermark passes its end.
    assert counts == [[], [3], [2, 3], [2, 3, 4]]


def test_message_log_keeps_the_newest(spark, tmp_path):
    schema = "session_id long, seq long, message string"
    rows = [(i % 3, i, f"m{i}") for i in range(30)]
    got = None
    for folder, kind in landed(spark, tmp_path, [(rows[:17], schema), (rows[17:], schema)]):
        got = st.drained(st.stream_message_log(stream_of(spark, folder, kind), 4), spark, str(tmp_path / "out"), str(tmp_path / "state"))
    last = {}
    for r in got.collect():
        last.setdefault((r["session_id"], r["place"]), set()).add(r["seq"])
    want = {(s, p + 1): sorted((i for i in range(30) if i % 3 == s), reverse=True)[p] for s in range(3) for p in range(4)}
    assert {k: max(v) for k, v in last.items()} == want


def test_sessions_are_complete(spark, tmp_path):
    schema = "session_id long, ts timestamp"
    rows = [(s, BASE + timedelta(minutes=m)) for s, m in [(1, 0), (1, 20), (1, 70), (2, 10), (1, 75), (3, 90), (2, 95)]]
    (folder, kind), = landed(spark, tmp_path, [(rows, schema)])
    closed = st.drained(st.stream_session_activity(stream_of(spark, folder, kind)), spark)
    every = st.with_open_sessions(closed, spark.read.parquet(folder)).collect()
    got = sorted((r["session_id"], r["created_at"], r["last_active"], r["messages"]) for r in every)
    at = lambda m: BASE + timedelta(minutes=m)
    assert got == [(1, at(0), at(20), 2), (1, at(70), at(75), 2), (2, at(10), at(10), 1), (2, at(95), at(95), 1), (3, at(90), at(90), 1)]
    assert 0 < closed.count() < 5


def test_requests_are_answered_again_after_the_watermark(spark, tmp_path):
    schema = "user_id long, kind string, ts timestamp"
    at = lambda m: BASE + timedelta(minutes=m)
    batches = [[(1, "a", at(0)), (1, "a", at(1)), (1, "b", at(2))], [(1, "a", at(5)), (2, "a", at(60))], [(1, "a", at(70)), (2, "a", at(75))]]
    for folder, kind in landed(spark, tmp_path, [(b, schema) for b in batches]):
        stream = st.stream_dedupe_requests(stream_of(spark, folder, kind), ["user_id", "kind"])
        got = st.drained(stream, spark, str(tmp_path / "out"), str(tmp_path / "state"))
    # An answer lapses when the watermark, at minute 50 after the second run, has passed its 10 minutes: (1, a) is asked anew.
    assert sorted((r["user_id"], r["kind"], r["ts"]) for r in got.collect()) == [(1, "a", at(0)), (1, "a", at(70)), (1, "b", at(2)), (2, "a", at(60))]


def test_the_state_store_is_put_back(spark):
    before = spark.conf.get(st.PROVIDER, None)
    with st.state_settings(spark, 3):
        assert spark.conf.get(st.PROVIDER) == st.STATE_STORE and spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get(st.PROVIDER, None) == before and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def slow_sessions(rows, gap, now):
    """Ended sessions of (session_id, minute, ends), in order of time."""
    out, opened = [], {}
    for s, m, ends in sorted(rows, key=lambda r: (r[1], r[2])):
        if s in opened and m - opened[s][1] > gap:
            out.append((s, *opened.pop(s), "idle"))
        if s in opened:
            opened[s] = (opened[s][0], m, opened[s][2] + 1)
            if ends:
                out.append((s, *opened.pop(s), "command"))
        elif not ends:
            opened[s] = (m, m, 1)
    return sorted(out + [(s, *x, "idle") for s, x in opened.items() if x[1] + gap < now])


@pytest.mark.parametrize("files", [1, 3])
def test_sessions_end_by_command_or_by_themselves(spark, tmp_path, files):
    import random

    rng = random.Random(files)
    rows = [(rng.randrange(6), m, rng.random() < 0.15) for m in range(0, 900, 3) for _ in range(rng.randrange(2))]
    rows += [(7, 5, True), (7, 8, False), (7, 8, True)]
    at = lambda m: BASE + timedelta(minutes=m)
    cut = [sorted(rows, key=lambda r: r[1])[k * len(rows) // files : (k + 1) * len(rows) // files] for k in range(files)]
    batches = [([(s, at(m), e) for s, m, e in part], "session_id long, ts timestamp, ends boolean") for part in cut]
    # Each file is a run of its own, which goes on from the state of the one before.
    for folder, kind in landed(spark, tmp_path, batches):
        stream = st.stream_sessions(stream_of(spark, folder, kind), gap=25 * 60.0)
        got = st.drained(stream, spark, str(tmp_path / "out"), str(tmp_path / "state"), partitions=2)
    minute = lambda t: round((t - BASE).total_seconds() / 60)
    found = sorted((r["session_id"], minute(r["created_at"]), minute(r["last_active"]), r["messages"], r["ended_by"]) for r in got.collect())
    assert found == slow_sessions(rows, 25, max(m for _, m, _ in rows) - 10)
    assert {r[4] for r in found} == {"command", "idle"}


@pytest.mark.parametrize("entries", [1, 3, 100])
def test_the_cache_is_the_same_in_batch_and_stream(spark, tmp_path, entries):
    import random

    from learnloom.operators import messages as m

    rng = random.Random(entries)
    rows = [(rng.choice([1, 2, None]), i, rng.choice(["a", "b", "c", "d", None]), rng.randrange(2)) for i in range(200)]
    want, caches = [], {}
    for s, i, x, y in rows:
        cache = caches.setdefault(s, [])
        want.append((s, i, (x, y) in cache))
        if (x, y) not in cache:
            cache.append((x, y))
            del cache[: max(0, len(cache) - entries)]
    df = spark.createDataFrame(rows, "server long, seq long, x string, y int")
    order = lambda rs: sorted(rs, key=str)
    got = m.cached_requests(df.repartition(3), ["x", "y"], "server", "seq", entries)
    assert order((r["server"], r["seq"], r["hit"]) for r in got.collect()) == order(want)
    asked = df.where("server is not null").selectExpr("server", "seq", "to_json(struct(x, y)) AS asked")
    for k, folder in enumerate(landed(spark, tmp_path, [([tuple(r) for r in asked.where(f"seq % 200 between {a} and {b}").collect()], asked.schema) for a, b in ((0, 99), (100, 199))])):
        got = st.drained(st.stream_cached_requests(stream_of(spark, *folder), entries), spark, str(tmp_path / "out"), str(tmp_path / "state"), partitions=2)
    assert sorted((r["server"], r["seq"], r["hit"]) for r in got.collect()) == sorted(w for w in want if w[0])
