"""The registered queries themselves, on small tables, against brute force: splits, columns and digests of the contracts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from learnloom.llm import queries
from learnloom.llm.tokens import default_path

from test_dedup import slow_fingerprint
from test_models import language_rows, make_corpus

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture
def tables(spark, tmp_path):
    def write(**named):
        folder = tmp_path / f"t{len(list(tmp_path.iterdir()))}"
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write


def documents(rows):
    return [(*r, *(None,) * (4 - len(r)), len(r[1] or ""))[:5] for r in rows], COLUMNS


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    good = {
        "email": lambda s, d: True, "ip": lambda s, d: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s, d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda s, d: 8 <= len(d) <= 15,
    }
    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good[k](m[0], re.sub(r"[^0-9]", "", m[0]))]


def test_personal_data_columns(spark, tables):
    rng = random.Random(3)
    parts = ["é mail", "a.b@x.example.com", "10.0.0.255", "10.0.0.256", "4012 8888 8888 1881", "4012888888881882", "+1 (743) 555-3824", "+12 1-", "1.2.3", 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"', "x@y"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randrange(9)))) for i in range(80)] + [(900, None), (901, ""), (902, "again 1.2.3.4"), (None, "a@b.c")]
    got = queries.op2_personal_data(spark, tables(documents=documents(rows))).collect()
    assert len(got) == len(rows)
    want = sorted(
        (str(i), *(sum(k == kind for k, *_ in plain_spans(t)) for kind in PLAIN), hashlib.sha256(",".join(f"{k}:{b}:{e}" for k, b, e in plain_spans(t)).encode()).hexdigest())
        for i, t in rows
    )
    assert sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: r["spans"] for r in got}
    for i, t in rows[:80]:
        spans = [s.split(":") for s in by_id[i].split(",") if s]
        assert [s for s in spans if s[0] in PLAIN] == [[k, str(b), str(e)] for k, b, e in plain_spans(t)]
        assert sum(s[0] == "secret" for s in spans) == (t or "").count("token =")


def test_quality_learns_from_the_other_rows_only(spark, tables):
    rows, labels = make_corpus(200)
    rows += [(1000, None), (1001, ""), (5, rows[5][1])]
    kinds = "doc_id long, quality int, toxic int"
    turned = [(i, y if remainder(i, 5) else 1 - y) for i, y in labels]
    one, two = (
        sorted(map(tuple, queries.op3_line_quality(spark, tables(documents=documents(rows), labels=([(i, y, 0) for i, y in ls], kinds))).collect()), key=str) for ls in (labels, turned)
    )
    assert one == two and len(one) == len(rows)
    known = dict(labels)
    for i, held_out, score, predicted in one:
        assert held_out == (remainder(i, 5) == 0) and predicted == int(score >= 0.3) and 0 <= score <= 1
        assert i >= 1000 or predicted == known[i]


def test_language_learns_from_the_other_rows_only(spark, tables):
    rows = language_rows(160) + [(900, None, "en", "s"), (901, "½ ② 12", "en", "s"), (902, "", None, None), (3, "the the and", "en", "s")]
    turned = [(i, t, "de" if remainder(i, 4) == 2 else k, s) for i, t, k, s in rows]
    one, two = (sorted((tuple(r) for r in queries.op10_language_id(spark, tables(documents=documents(d))).collect()), key=str) for d in (rows, turned))
    assert one == two and len(one) == len(rows)
    truth = {i: k for i, _, k, _ in rows}
    for i, held_out, pred, score, rejected in one:
        assert held_out == (remainder(i, 4) == 2) and 0 <= score <= 1
        assert pred == ("und" if i in (900, 901, 902) else truth[i]) and (i not in (900, 901, 902) or rejected)


def test_scores_are_those_of_all_labelings_of_the_lines(spark, tables):
    """Every way to label a document's lines is weighed; a line's share of good ones is averaged by length."""
    from itertools import product

    from learnloom.llm import quality

    rows, labels = make_corpus(90)
    rows = [(i, t) for i, t in rows if t.count("\n") < 7] + [(1000, None), (1001, "one\n\ntwo words\n")]
    df, known = spark.createDataFrame(*documents(rows)), spark.createDataFrame(labels, "doc_id long, quality int")
    field = quality.fit(df, known.where("pmod(crc32(cast(doc_id as string)), 5) <> 0"))
    got = {r["doc_id"]: r["score"] for r in queries.op3_line_quality(spark, tables(documents=documents(rows), labels=([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int"))).collect()}
    for i, text in rows:
        lines = (text or "").split("\n")
        x, _ = quality.line_features(text)
        assert len(x) == len(lines)
        weight = np.array([len(line.encode()) for line in lines]) + 1e-6
        total = share = 0.0
        for y in product((0, 1), repeat=len(lines)):
            w = np.exp(sum(s * v for s, v in zip(x @ field.weights, y)) + sum(field.table[a, b] for a, b in zip(y, y[1:])))
            total, share = total + w, share + w * float(np.dot(y, weight))
        assert abs(got[i] - share / total / weight.sum()) < 1e-6


def test_languages_are_those_of_the_nearest_row(spark, tables):
    """With four learned rows or fewer of a language each is a centroid, so the largest cosine with one of them decides."""
    import math
    from collections import Counter

    from learnloom.llm import language_id

    rows = language_rows(120)
    learned, kept = Counter(), []
    for i, t, k, s in rows:
        own = remainder(i, 4) != 2
        if not own or learned[k] < 4:
            kept.append((i, t, k, s))
            learned[k] += own
    train = [(t, k) for i, t, k, _ in kept if remainder(i, 4) != 2]
    slots = lambda t: Counter(language_id.grams(t).tolist())
    df = Counter(s for t, _ in train for s in slots(t))

    def unit(text):
        v = {s: (1 + math.log(n)) * (math.log((1 + len(train)) / (1 + df[s])) + 1) for s, n in slots(text).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {s: w / norm for s, w in v.items()}

    centroids = [(k, unit(t)) for t, k in train]
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, tables(documents=documents(kept))).collect()}
    for i, text, *_ in kept:
        v, best = unit(text), {}
        for k, c in centroids:
            best[k] = max(best.get(k, 0.0), sum(w * c.get(s, 0.0) for s, w in v.items()))
        want = max(sorted(best), key=best.get)
        assert got[i]["lang_pred"] == want and abs(got[i]["score"] - min(1.0, best[want])) < 1e-9


def test_other_languages_and_junk_are_rejected(spark, tables):
    """Scripts that no learned row has are far from every centroid; a language of the same script and a mixture are not."""
    rows = language_rows(160)
    far = [(900, "ლამაზი დღეა დღეს"), (901, "これは日本語の文章です"), (902, "שלום עולם טוב"), (903, "the and tion ing the und これ")]
    got = {r["doc_id"]: r for r in queries.op10_language_id(spark, tables(documents=documents(rows + far))).collect()}
    assert [got[i]["rejected"] for i, _ in far] == [True, True, True, False]
    assert not any(got[i]["rejected"] for i, *_ in rows)


def test_a_language_of_repeated_rows_is_not_lost(spark, tables):
    learned = [i for i in range(1000, 1010) if remainder(i, 4) != 2][:4]
    for own in learned:
        rows = language_rows(90)[1::3] + [(own, "the and ing tion the ing", "en", "s")] * 1500
        got = {r["lang_pred"] for r in queries.op10_language_id(spark, tables(documents=documents(rows))).where(f"doc_id = {own}").collect()}
        assert got == {"en"}


def test_fingerprints_and_groups(spark, tables):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(150)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)] + [(20 + i, t.replace("w1 ", "W9 ", 1)) for i, t in enumerate(base)] + [(50, None), (51, " "), (3, base[4]), (60, base[0].upper())]
    got = queries.op8_simhash(spark, tables(documents=documents(rows))).collect()
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    root = {i: i for i, _ in fps}
    for i, x in fps:
        for j, y in fps:
            if bin(x ^ y).count("1") <= 4:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{fp:016x}", root[i]) for i, fp in fps)


TEXTS = ["it's THE!! naïve--café 5'3", None, "", "a\x1cb", "word " * 3000, "😀 ok", "w w w"]


def encoded(text, end):
    library = Tokenizer.from_file(default_path())
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_files_are_those_of_the_library(spark, tables):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)]
    got = queries.op9_token_files(spark, tables(documents=documents(rows))).collect()
    want, start = [], 0
    for i, t in rows:
        ids = encoded(t, 2)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_packed_pieces_are_those_of_the_library(spark, tables):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    got = queries.op6_packing(spark, tables(documents=documents(rows))).collect()
    want = []
    for i, t in rows:
        ids = encoded(t, 0)
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for used in places.values():
        at = 0
        for offset, length in sorted(used):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1 + -(-sum(r["length"] for r in got) // 2048)


def test_mix_positions_integrate_to_the_targets(spark, tables):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 40), None, rng.choice("abbbcccc")) for i in range(1500)]
    got = queries.op4_source_mix(spark, tables(documents=documents(rows))).collect()
    total = sum(r["size"] for r in got)
    # At every time the words placed so far are that share of all words, and sources with a lower slope lead.
    for t in (0.25, 0.5, 0.75):
        placed = sum(r["size"] * r["copies"] for r in got if r["position"] is not None and r["copies"] == 1 and r["position"] <= t)
        many = [r for r in got if r["copies"] > 1]
        assert placed <= total * t + 40 and (many or abs(placed - total * t) < 0.02 * total)
    assert all((r["position"] is None) == (r["copies"] == 0) and r["taken"] == r["size"] * r["copies"] for r in got)
    assert [r["position"] or -1 for r in got] == sorted(r["position"] or -1 for r in got)
