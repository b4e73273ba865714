import random

import numpy as np
import pytest

from learnloom.llm import language_id, mixing, pii, quality


def test_base_spans():
    text = "é mail a.b@x.example.com, 10.0.0.255 and 10.0.0.256, 4012 8888 8888 1881, +1 (743) 555-3824; +12 1-"
    got = [(k, text[b:e]) for k, b, e in pii.base_spans(text)]
    assert got == [("email", "a.b@x.example.com"), ("ip", "10.0.0.255"), ("card", "4012 8888 8888 1881"), ("phone", "+1 (743) 555-3824")]
    spans = pii.base_spans("a@b.c_d@e.f")
    assert [("a@b.c_d@e.f")[b:e] for _, b, e in spans] == ["a@b.c", "_d@e.f"]


def test_base_spans_equal_plain_patterns():
    import re

    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, s):
        d = re.sub(r"\D", "", s)
        return {
            "email": True,
            "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")),
            "card": 16 <= len(d) <= 19 and pii.luhn(d) if kind == "card" else True,
            "phone": 8 <= len(d) <= 15,
        }[kind]

    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("a1 2.3@-+(b)4_5" if rng.random() < 0.8 else "0123456789") for _ in range(rng.randrange(60)))
        want = [(k, *m.span()) for k, p in plain.items() for m in re.finditer(p, text) if good(k, m[0])]
        assert pii.base_spans(text) == want, text


def test_personal_data_adds_secrets_and_keeps_base(docs):
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    rows = [(i, f'prose here. token = "{key[i % 20:] + key[: i % 20]}" and mail x{i}@y.org') for i in range(40)]
    rows += [(100 + i, f"ratio: aaaaaaaaaaaaaaaaaaaaaaaa line {i}") for i in range(40)] + [(200, None), (201, ""), (202, "9" * 100_000)]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(rows)).collect()}
    assert all([s["kind"] for s in got[i]["spans"]] == ["email", "secret"] for i in range(40))
    assert not any(got[100 + i]["spans"] for i in range(40)) and not got[200]["spans"] and not got[201]["spans"]
    assert pii.personal_data(docs([])).count() == 0


def planted(rng):
    """Texts with one span of an added kind, true or a decoy: (text, kind, span, true)."""
    word = lambda: "".join(rng.choice(["an", "ter", "ing", "sh", "ou"]) for _ in range(rng.randrange(1, 4)))
    digits = lambda n, first="0123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    high = "23456789"
    made = {
        "email_text": (lambda: f"{word()}.{word()}{digits(2)} [at] {word()} [dot] {rng.choice(['com', 'org', 'de'])}", ["mail", "contact", "and"], lambda: f"aa{digits(1)} [at] aa [dot] aaa", ["meet", "noon"]),
        "phone_local": (lambda: f"{digits(3, high)}-{digits(3, high)}-{digits(4)}", ["phone", "call", "so"], lambda: f"{rng.choice(['000', '111'])}-{rng.choice(['000', '111'])}-{rng.choice(['0000', '1111'])}", ["order", "part", "so"]),
        "secret": (lambda: hexes(40), ["token", "key", "password"], lambda: rng.choice(["a", "ab"]) * 16, ["ratio", "path"]),
        "national_id": (lambda: f"{rng.choice('1234578')}{digits(2)}-{digits(2, '123')}-{digits(4, '123')}", ["ssn", "tax", "then"], lambda: f"000-00-000{digits(1)}", ["serial", "part"]),
    }
    for kind, (true, cues, decoy, other) in made.items():
        for _ in range(150):
            for real in (True, False):
                span, cue = (true(), rng.choice(cues)) if real else (decoy(), rng.choice(other))
                glue = f'{cue} = "{span}"' if kind == "secret" else f"{cue} {span}"
                yield f"{word()} {word()}. {glue} {word()} {word()}", kind, span, real


def test_planted_spans_of_added_kinds(docs):
    cases = list(planted(random.Random(8)))
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs([(i, c[0]) for i, c in enumerate(cases)])).collect()}
    for kind in pii.ADDED_KINDS:
        own = [(any((s["kind"], cases[i][0][s["start"] : s["end"]]) == (kind, span) for s in got[i]), real) for i, (_, k, span, real) in enumerate(cases) if k == kind]
        recall = sum(f and r for f, r in own) / sum(r for _, r in own)
        precision = sum(f and r for f, r in own) / max(1, sum(f for f, _ in own))
        assert recall >= 0.95 and precision >= 0.95, (kind, recall, precision)


def test_labelers_and_inputs_look_at_different_things():
    text = 'we keep token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" here'
    b = text.index("f33e")
    assert pii.votes("secret", text, b, b + 40) == (1, 0, 1, 1)
    moved = text.replace("token", "thing")
    assert pii.votes("secret", moved, b, b + 40) == (1, 0, 0, 1) and pii.features("secret", moved, b, b + 40) == pii.features("secret", text, b, b + 40)


def test_reliabilities_find_good_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < a, np.where(truth, 1, 2), np.where(truth, 2, 1)) for a in (0.95, 0.9, 0.6, 0.85)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, table = pii.reliabilities(patterns, counts.astype(float))
    assert table[0, 1, 1] > table[2, 1, 1] and abs((p @ counts) / 4000 - 0.3) < 0.05


def make_corpus(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "ter", "ing", "sh", "ou"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        lines = [" ".join(word() for _ in range(12)) + "." for _ in range(rng.randrange(1, 8))]
        if not good:
            lines = [line.upper().replace(" ", "!! ") if i % 2 else " ".join(w + "$$$" for w in line.split()) for line in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good)))
    return rows, labels


def test_line_quality_separates_held_out_documents(spark, docs):
    rows, labels = make_corpus(240)
    table = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    df = docs(rows + [(1000, None), (1001, ""), (1002, "\n" * 50), (1003, "a" * 300_000)])
    field = quality.fit(df, table.where("doc_id < 160"))
    got = {r["doc_id"]: r["score"] for r in quality.document_scores(df, field).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, y in labels if i >= 160)
    assert all(0 <= got[i] <= 1 for i in (1000, 1001, 1002, 1003)) and len(got) == 244
    assert quality.fit(df, table.where("false")) is None
    assert quality.document_scores(df, None).where("score = 0.5").count() == 244


def test_marginals_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    field = quality.LineField(rng.normal(size=3), rng.normal(size=(2, 2)))
    sizes = np.array([1, 4, 3])
    x = rng.normal(size=(8, 3))
    got = field.marginals(x, sizes)
    begin = 0
    for n in sizes:
        s = x[begin : begin + n] @ field.weights
        total, good = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(s[i] * y[i] for i in range(n)) + sum(field.table[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            good += w * np.array(y)
        assert np.allclose(good / total, got[begin : begin + n])
        begin += n


def language_rows(n=120):
    rng = random.Random(1)
    parts = {"en": ["the", "and", "ing", "tion"], "de": ["der", "sch", "keit", "ung"], "el": ["και", "του", "ος", "η"]}
    return [(i, " ".join("".join(rng.choices(parts[k], k=2)) for _ in range(rng.randrange(3, 40))), k, "s") for i, k in zip(range(n), list(parts) * n)]


def test_language_of_held_out_rows(spark, docs):
    rows = language_rows()
    odd = [(900, None, "en", "s"), (901, "123 -- 4", "en", "s"), (902, "", None, "s"), (903, "ლამაზი დღეა", None, "s"), (904, "the " * 60_000, None, "s")]
    df = docs(rows + odd)
    model = language_id.fit(df.where("doc_id < 80 or doc_id >= 900"))
    got = {r["doc_id"]: r for r in language_id.languages(df, model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _ in rows) and not any(got[i]["rejected"] for i, *_ in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[903]["rejected"] and got[904]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    kept = language_id.drop_unknown_languages(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, *_ in rows} | {904}
    empty = language_id.fit(df.where("false"))
    assert language_id.languages(df, empty).where("lang_pred = 'und'").count() == 125


def test_shares_stop_at_three_sizes():
    got = mixing.shares([10, 100, 890], [5, 2, 1])
    assert got[0] == 30 and got[1] == 300 and abs(sum(got) - 1000) < 1e-9
    assert mixing.shares([0, 0], [5, 2]) == [0, 0] and mixing.shares([], []) == []


def test_mix_comes_near_targets(docs):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 60), None, rng.choice(["a", "b", "c", "c", "c", "c", None])) for i in range(900)]
    rows += [(None, "w w", None, "a"), (3, None, None, "empty"), (4, "", None, "empty")]
    got = mixing.source_mix(docs(rows)).collect()
    assert len(got) == len(rows)
    words = {(r["size"], r["source_size"], r["target"]) for r in got}
    for source_size, target in {(s, t) for _, s, t in words}:
        own = [r for r in got if (r["source_size"], r["target"]) == (source_size, target)]
        assert abs(sum(r["taken"] for r in own) - target) <= 2
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    targets = {(r["source_size"], r["target"]) for r in got}
    assert abs(sum(t for _, t in targets) - sum(r["size"] for r in got)) < 1e-3
    df = docs(rows)
    mixed = mixing.mixed_documents(df)
    taken = {}
    for r in mixed.collect():
        taken[r["doc_id"], r["text"]] = taken.get((r["doc_id"], r["text"]), 0) + len((r["text"] or "").split())
    assert mixed.columns == df.columns and sum(taken.values()) == sum(r["taken"] for r in got)
    assert mixing.source_mix(docs([])).count() == 0 and mixing.mixed_documents(docs([])).count() == 0


def test_schedule_orders_sources(docs):
    rows = [(i, "w", None, "abc"[i % 3]) for i in range(300)]
    first = [r["source"] for r in mixing.mixed_documents(docs(rows), weights=(1, 1, 1), slopes=(-0.9, 0.0, 0.9)).collect()]
    assert first[:100].count("a") > first[:100].count("b") > first[:100].count("c")


def test_resources_come_from_tables(spark, docs):
    gazetteer = spark.createDataFrame(
        [("secret", True, "starts", f"corp{i:05d}_") for i in range(5000)] + [("secret", False, "whole", "corp00001_deadbeefdeadbeef"), ("national_id", False, "starts", "555-"), ("secret", None, "whole", "x")],
        "kind string, good boolean, place string, value string",
    )
    cues = spark.createDataFrame([("secret", True, "Zugang")], "kind string, good boolean, word string")
    known = pii.resources(gazetteer, cues)
    vote = lambda kind, span, before="": pii.votes(kind, before + span, len(before), len(before) + len(span), known)
    assert vote("secret", "corp04999_aaaaaaaaaaaaaaaa")[1] == 1 and vote("secret", "corp05000_aaaaaaaaaaaaaaaa")[1] == 0
    assert vote("secret", "corp00001_deadbeefdeadbeef")[1] == 2 and vote("secret", "my_ExAmPlE_aaaaaaaaaaaaaa")[1] == 2
    assert vote("secret", "a" * 20, "zugang ")[2] == 1 and vote("national_id", "555-12-3456")[1] == 2 and vote("phone_local", "(212) 555-0100")[1] == 1
    assert pii.resources(gazetteer, cues, defaults=False).knows("email_text", True, "a at b dot com") is False
    rows = [(i, f"zugang: corp{i:05d}_{'0123456789abcdef'[i % 16 :]}0a1b2c3d4e5f") for i in range(30)]
    got = pii.personal_data(docs(rows), known=known).collect()
    assert all([s["kind"] for s in r["spans"]] == ["secret"] for r in got)
    with pytest.raises(ValueError, match="not an entry"):
        pii.Resources([("secret", True, "somewhere", "x")], [])
