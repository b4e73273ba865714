import random
from datetime import datetime, timedelta

import pytest

from learnloom import streaming as st

BASE = datetime(2024, 1, 1)
RESULT = "session_id long, modality string, probs array<double>, confidence double, error string, ts timestamp, event_id long"
EVEN = [1 / 7] * 7


def given(spark, tmp_path, batches, **options):
    """The results after each batch, each a run that goes on from the one before."""
    out = []
    for rows in batches:
        table = [(s, kind, p, c, e, BASE + timedelta(seconds=at), n) for s, kind, p, c, e, at, n in rows]
        spark.createDataFrame(table, RESULT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = st.stream_fuse_and_smooth(spark.readStream.schema(RESULT).parquet(str(tmp_path / "in")), **options)
        got = st.drained(stream, spark, str(tmp_path / "out"), str(tmp_path / "state"), partitions=2)
        out.append({(r["session_id"], r["event_id"]): r for r in got.collect()})
    return out


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_sessions_end_by_the_time_that_passed_in_any_zone(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # The watermark comes near the end of session 1 and then passes it; session 3 pairs just before its end.
        alone = lambda s, kind, at, n: (s, kind, EVEN, None, None, at, n)
        batches = [[alone(1, "audio", 0, 1), alone(3, "audio", 1000, 2)], [alone(2, "audio", 4000, 3)], [alone(3, "face", 4500, 4)], [alone(2, "audio", 4600, 5)]]
        found = [sorted(r) for r in given(spark, tmp_path, batches)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == [[], [], [(1, 1), (3, 4)], [(1, 1), (3, 4)]]


def test_single_and_zero_probabilities_are_as_in_the_batch_form(spark, tmp_path):
    rows = [(1, "audio", [0.0] * 7, None, None, 0, 1), (1, "face", [0.0] * 7, 0.5, None, 5, 2), (9, "face", EVEN, None, None, 90_000, 3)]
    last = given(spark, tmp_path, [rows])[-1]
    assert (last[1, 2]["emotion"], last[1, 2]["confidence"]) == ("anger", 0.0)


def slow_events(rows, wait, watermark):
    """(session, event) of all that a stream gives, a session at a time."""
    out = set()
    for session in {r[0] for r in rows}:
        own = sorted((at, n, kind) for s, kind, _, _, _, at, n in rows if s == session)
        parts = [[own[0]]]
        for r in own[1:]:
            parts.append([r]) if r[0] - parts[-1][-1][0] > wait else parts[-1].append(r)
        for part in parts:
            sides = [[(at, n) for at, n, k in part if k == kind] for kind in ("audio", "face")]
            pairs = min(map(len, sides))
            out |= {(session, max(a, f)[1]) for a, f in zip(*sides)}
            if part is not parts[-1] or part[-1][0] + wait < watermark:
                out |= {(session, n) for side in sides for _, n in side[pairs:]}
    return out


@pytest.mark.parametrize("buckets", [1, 4096])
def test_sessions_of_a_bucket_keep_apart(spark, tmp_path, buckets):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), rng.choice(["audio", "face", "audio"]), EVEN, None, None, 37 * n + n % 3, n) for n in range(150)]
    rows = [r for r in rows if not (r[0] in (1, None) and 1000 < r[5] < 3000) and not (r[0] == 4 and r[5] > 1500)]
    rows.append((6, "face", EVEN, None, None, 5600, 1000))
    parts = [[r for r in rows if a <= r[5] < b] for a, b in ((0, 1800), (1800, 4200), (4200, 9999))]
    last = given(spark, tmp_path, parts, wait=900.0, late="10 seconds", buckets=buckets)[-1]
    assert set(last) == slow_events(rows, 900, 5590) and len(last) > 40
    assert {s for s, _ in last} == {1, 2, 3, 4, 5, None}
