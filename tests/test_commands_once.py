from learnloom.queries import bindings, streams


def test_commands_are_made_from_the_stored_mastery(monkeypatch, spark):
    made, own = [], bindings.mastery
    monkeypatch.setattr(bindings, "mastery", lambda *a: made.append(a) or own(*a))
    assert streams.stream_process_commands(spark, "/root/testdata/sf0.001").count() and len(made) == 1
