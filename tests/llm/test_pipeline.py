import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from learnloom.llm import mixing
from learnloom.llm.tokens import default_path

from test_similar import brute_force

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    parts = {"en": ["the", "and", "ing", "tion"], "de": ["der", "sch", "keit", "ung"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        words = ["".join(rng.choices(parts[lang], k=3)) + str(i) for _ in range(rng.randrange(60, 120))]
        rows.append((i, " ".join(words), lang, f"s{i % 4}" if i % 5 else None))
    rows += [(100 + i, t.replace(" ", "\t"), la, s) for i, t, la, s in rows[:20]]  # exact copies
    for i, t, la, s in rows[20:35]:  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(w), la, s))
    rows += [(300, None, "en", "s1"), (301, "", None, None), (302, "12 --", "de", "s2"), (5, rows[5][1], rows[5][2], rows[5][3])]
    return [(*r, len(r[1] or "")) for r in rows]


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = [tuple(r) for r in docs.collect()]

    spoken = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    assert sorted(kept["language_id"]) == sorted(spoken)

    first = {}
    for r in sorted(spoken, key=lambda r: r[0]):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", r[1]), r)
    assert sorted(kept["exact_dedup"], key=lambda r: r[0]) == sorted(first.values(), key=lambda r: r[0])

    root = brute_force({r[0]: r[1] for r in first.values()})
    assert sorted(r[0] for r in kept["near_dedup"]) == sorted(i for i, low in root.items() if low == i)
    assert len(kept["near_dedup"]) < len(root)

    sizes = Counter()
    for _, text, _, source, _ in kept["near_dedup"]:
        sizes[source] += len(text.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.shares([sizes[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    taken, copies = Counter(), Counter(r[0] for r in kept["mixing"])
    for _, text, _, source, _ in kept["mixing"]:
        taken[source] += len(text.split())
    assert all(abs(taken[s] - targets[s]) <= 60 for s in names) and max(copies.values()) <= 3

    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(default_path()), Counter()
    for r in kept["mixing"]:
        ids = np.array(library.encode(r[1], add_special_tokens=False).ids + [0], "<u4")
        want.update((r[0], k, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed) == want
    filled = Counter()
    for r in packed:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 1


def test_run_equals_the_stages(spark, tmp_path):
    spark.createDataFrame(corpus()[:12], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() >= 1
