"""The Merkle manifest against a tree built node by node."""

import hashlib
import random
import zlib

import pytest

from learnloom.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def climb(levels, place, node):
    siblings = []
    for level in levels[:-1]:
        beside = [level[place ^ 1]] if place ^ 1 < len(level) else []
        node = sha("".join(beside + [node] if place % 2 else [node] + beside))
        siblings += beside
        place //= 2
    return siblings, node


def slow_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the operator's rows, in any order."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf, start = (sha("".join(map(field, (doc_id, source, lang, x, text)))) for x in (n, None if n is None else n + 1))
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        groups.setdefault(lang, []).append((doc_id, leaf, start if tampered else leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = levels_of([r[1] for r in groups[name]])
    top = levels_of([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for place, (doc_id, leaf, start) in enumerate(groups[name]):
            low, node = climb(trees[name], place, start)
            high, node = climb(top, k, node)
            out.append((doc_id, leaf, trees[name][-1][0], top[-1][0], sha("".join(low + high)), node, node == top[-1][0]))
    return sorted(out, key=str)


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS pos", "'y' AS leaf", "1 AS path")


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_manifest_is_that_of_the_tree(spark, levels):
    rng = random.Random(levels)
    rows = [(i * 3, f"text é {i}", rng.choice(["en", "en", "en", "é", "fr"]), rng.choice("ab"), i) for i in range(150)]
    rows += [(None, None, None, None, None), (7, "", None, "a", 3), (14, "long " * 50_000, "en", "", None), (None, "x", "en", "a", 2**63 - 1), (2**63 - 1, "", "", "", 2**63 - 1)]
    rows += [(6, "repeated", "en", "a", 9)] * 40 + [(6, "other", "en", "a", 9)]
    got = merkle.document_manifest(make(spark, rows), levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == slow_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(rows) / 2


@pytest.mark.parametrize("rows", [[], [(7, "alone", "en", "a", 5)], [(1, "a", "en", "a", 1), (2, "b", "en", "a", 1)], [(1, "a", "en", "a", 1), (2, "b", None, "a", 1)]])
def test_small_manifests(spark, rows):
    assert sorted(map(tuple, merkle.document_manifest(make(spark, rows)).collect()), key=str) == slow_manifest(rows)
