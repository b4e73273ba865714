"""Personal data by weak supervision.

1. One pass over each whole text finds the base spans (email, ip, card, phone) by their patterns and wider candidates
   of other kinds. Four labelers vote on each candidate (1 yes, 2 no, 0 abstains), each by a resource of its own: a
   stricter pattern, a gazetteer of known values, words of the context, and the statistics of the characters.
2. Spark counts the vote patterns of each kind over the corpus (at most 81 for a kind). Expectation-maximisation over
   these counts estimates the labelers' reliabilities and each pattern's probability of being personal data.
3. A logistic span classifier is trained with these probabilities as soft labels on features that no labeler sees:
   the words next to the span, its character shape, its first characters, its length and the share of digits. It is
   fitted on a bounded sample of candidates; the candidates that it accepts join the base spans, which always stay.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, stored

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds, in the order they take in ``spans`` after the base kinds.
ADDED_KINDS = ("email_text", "phone_local", "secret", "national_id")
LABELERS = ("pattern", "gazetteer", "context", "characters")
#: Candidates of each kind that the classifier is fitted on at most: the first by a hash of their place.
FIT_SPANS = 4000

#: Base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its start fails from inside too, so runs are taken whole.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Candidate patterns of the added kinds.
_CANDIDATES = (
    ("email_text", re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?[\[(]\s?dot\s?[\])]\s?[A-Za-z0-9-]{1,63})+"), 0),
    ("phone_local", re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"), 0),
    ("secret", re.compile(r"\b[A-Za-z_]{2,30}\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/-]{16,512})"), 1),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0),
)
#: Stricter patterns of the whole span.
_STRICT = {
    "email_text": re.compile(r"[A-Za-z][A-Za-z0-9._%+-]*\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]+(?:\s?[\[(]\s?dot\s?[\])]\s?[A-Za-z0-9-]+)*\s?[\[(]\s?dot\s?[\])]\s?[A-Za-z]{2,12}"),
    "phone_local": re.compile(r"\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}"),
    "secret": re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/-]{20,512}"),
    "national_id": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
}
#: Fixed values of the gazetteer: known values, and where they stand in a span, that speak for a kind.
_FOR = {
    "email_text": ("ends", """com org net edu gov mil int info biz io dev app ai co me tv us uk ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg
        hr si rs ua ru tr se no dk fi is ee lv lt br mx ar cl pe in cn jp kr hk sg za ng ke eg il""".split()),
    "phone_local": ("starts", """201 202 203 206 207 208 210 212 213 214 215 216 224 240 248 253 262 267 281 301 302 303 304 305 310 312 313 314 315 317 319 323
        330 334 336 347 402 404 405 406 408 410 412 414 415 417 419 425 469 480 502 503 504 505 508 510 512 513 515 516 518 520 530 540 541 551 559 602
        603 605 606 607 608 609 610 612 614 615 616 617 618 619 626 630 631 646 650 651 661 678 701 702 703 704 706 707 708 713 714 716 717 718 719 720 732
        740 757 760 763 770 773 775 800 801 802 803 804 805 808 810 812 813 814 816 817 818 828 831 832 833 843 845 847 850 856 858 860 864 866 877 888
        901 903 904 907 908 909 910 912 913 914 915 916 917 918 919 925 941 949 951 952 954 956 970 971 972 973 978 979""".split()),
    "secret": ("starts", """AKIA ASIA AIza ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk- sk_ pk_ rk_ xoxb- xoxp- xoxa- xoxs- xox eyJ ya29 npm_ pypi- dop_v1_ hf_
        shpat_""".split()),
    # By rule: the areas that were issued until 2011.
    "national_id": ("starts", [f"{n:03d}-" for n in range(1, 773) if n != 666 and not 734 <= n <= 749]),
}
#: Fixed values of the gazetteer that speak against a kind.
_AGAINST = {
    "email_text": ("ends", "example invalid localhost test".split()),
    "phone_local": ("starts", "000 111 123 999".split()),
    "secret": ("holds", "example placeholder changeme your_ xxxx lorem 0000000".split()),
    "national_id": ("whole", ["078-05-1120", "219-09-9999", "123-45-6789", *(f"987-65-432{d}" for d in range(10))]),
}
#: Fixed values of the context: words before a span that speak for and against a kind.
_CUES = {
    "email_text": ("mail email e-mail contact write reach address".split(), "meet meeting room noon clock".split()),
    "phone_local": ("phone tel telephone mobile cell call fax dial ring".split(), "order invoice part ratio score version isbn".split()),
    "secret": ("token secret password passwd pwd key apikey api_key access_key auth credential bearer private_key".split(), "sha md5 checksum digest commit hash ratio path file url".split()),
    "national_id": ("ssn social security insurance tax passport identity".split(), "order invoice part serial version isbn model".split()),
}
#: Entries of a caller's tables at most; they come to the driver and are sent to the tasks.
MOST_ENTRIES = 1_000_000


class Resources:
    """What the gazetteer and the context labeler know: values by (kind, for or against, place), words by (kind, for or against).

    A value of place ``starts``, ``ends`` or ``whole`` is compared as it is, ``holds`` in lower case, anywhere in a span; a
    local phone number without its first bracket. Lookups go by the lengths of the values, so their number does not matter.
    """

    def __init__(self, values: Iterable[tuple[str, bool, str, str]], words: Iterable[tuple[str, bool, str]]):
        self.values: dict[tuple[str, bool], dict[tuple[str, int], set[str]]] = {}
        self.words: dict[tuple[str, bool], set[str]] = {}
        for kind, good, place, value in values:
            if kind not in ADDED_KINDS or place not in ("starts", "ends", "whole", "holds") or not value:
                raise ValueError(f"not an entry of a gazetteer: {(kind, good, place, value)}")
            self.values.setdefault((kind, good), {}).setdefault((place, len(value)), set()).add(value)
        for kind, good, word in words:
            self.words.setdefault((kind, good), set()).add(word.lower())

    def knows(self, kind: str, good: bool, span: str) -> bool:
        span = span.removeprefix("(") if kind == "phone_local" else span
        for (place, n), known in self.values.get((kind, good), {}).items():
            if n > len(span):
                continue
            if place == "starts":
                met = span[:n] in known
            elif place == "ends":
                met = span[-n:] in known
            elif place == "whole":
                met = n == len(span) and span in known
            else:
                low = span.lower()
                met = any(low[i : i + n] in known for i in range(len(low) - n + 1))
            if met:
                return True
        return False

    def cued(self, kind: str, good: bool, before: set[str]) -> bool:
        return not before.isdisjoint(self.words.get((kind, good), ()))


def default_entries() -> tuple[list[tuple[str, bool, str, str]], list[tuple[str, bool, str]]]:
    """The built-in rows of the gazetteer (kind, good, place, value) and of the cues (kind, good, word)."""
    values = [(kind, good, place, v) for good, table in ((True, _FOR), (False, _AGAINST)) for kind, (place, listed) in table.items() for v in listed]
    return values, [(kind, good, w) for kind, both in _CUES.items() for good, listed in zip((True, False), both) for w in listed]


DEFAULT = Resources(*default_entries())


def resources(gazetteer: DataFrame | None = None, cues: DataFrame | None = None, defaults: bool = True) -> Resources:
    """Resources from tables (kind, good, place, value) and (kind, good, word), besides the built-in ones unless told otherwise."""
    values, words = default_entries() if defaults else ([], [])
    for table, columns, listed in ((gazetteer, ("kind", "good", "place", "value"), values), (cues, ("kind", "good", "word"), words)):
        if table is not None:
            rows = table.select(*columns).dropna().distinct().limit(MOST_ENTRIES + 1).collect()
            if len(rows) > MOST_ENTRIES:
                raise ValueError(f"more than {MOST_ENTRIES} entries")
            listed += [tuple(r) for r in rows]
    return Resources(values, words)


_WORD = re.compile(r"[A-Za-z][A-Za-z_-]*")
#: Places of the classifier's inputs: bias, kinds, words before and after, shape, first characters, length, digits.
_FIELDS = {"bias": 1, "kind": 4, "before": 256, "after": 256, "shape": 128, "first": 64, "length": 8, "digits": 6}
_AT = dict(zip(_FIELDS, np.cumsum([0, *_FIELDS.values()]).tolist()))
INPUTS = sum(_FIELDS.values())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part before an at sign reaches back to the last match at most."""
    last = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            yield begin, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base patterns, by kind as listed, then start; code points, end exclusive."""
    out = [("email", b, e) for b, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def _entropy(span: str) -> float:
    return -sum(n / len(span) * math.log2(n / len(span)) for n in Counter(span).values())


def votes(kind: str, text: str, begin: int, end: int, known: Resources = DEFAULT) -> tuple[int, int, int, int]:
    """The labelers' votes on a candidate, in their order."""
    span = text[begin:end]
    pattern = 1 if _STRICT[kind].fullmatch(span) else 2
    gazetteer = 2 if known.knows(kind, False, span) else 1 if known.knows(kind, True, span) else 0
    before = {w.lower().strip("_-") for w in _WORD.findall(text[max(0, begin - 40) : begin])}
    context = 1 if known.cued(kind, True, before) else 2 if known.cued(kind, False, before) else 0
    if kind in ("secret", "email_text"):
        bits = _entropy(span)
        characters = 1 if bits >= 3.2 else 2 if bits < 2.5 else 0
    else:
        digits = _DIGIT.findall(span)
        runs = max(sum((int(b) - int(a)) % 10 == step for a, b in zip(digits, digits[1:])) for step in (0, 1, 9))
        characters = 2 if len(set(digits)) < 3 or runs > 5 else 1 if len(set(digits)) > 4 and runs < 4 else 0
    return pattern, gazetteer, context, characters


def _slot(field: str, value: str) -> int:
    return _AT[field] + zlib.crc32(value.encode()) % _FIELDS[field]


def features(kind: str, text: str, begin: int, end: int) -> list[int]:
    """Places of a candidate's inputs that are 1. They are hashes of what the labelers do not look at."""
    span = text[begin:end]
    left, right = text[max(0, begin - 24) : begin].split(), text[end : end + 24].split()
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in span))
    return [
        0,
        _AT["kind"] + ADDED_KINDS.index(kind),
        _slot("before", left[-1].lower() if left else ""),
        _slot("after", right[0].lower() if right else ""),
        _slot("shape", shape[:8]),
        _slot("first", span[:2]),
        _AT["length"] + min(7, len(span) // 8),
        _AT["digits"] + round(5 * sum(c.isdigit() for c in span) / len(span)),
    ]


def candidates(text: str, base: list[tuple[str, int, int]], known: Resources = DEFAULT) -> list[tuple[str, int, int, int, list[int]]]:
    """Added candidates that overlap no base span: (kind, start, end, votes as a base-3 number, inputs)."""
    out = []
    taken = sorted((b, e) for _, b, e in base)
    for kind, pattern, group in _CANDIDATES:
        if kind == "email_text" and "at" not in text or kind == "secret" and "=" not in text and ":" not in text:
            continue
        for m in pattern.finditer(text):
            b, e = m.span(group)
            if any(b < y and x < e for x, y in taken):
                continue
            v = votes(kind, text, b, e, known)
            out.append((kind, b, e, v[0] * 27 + v[1] * 9 + v[2] * 3 + v[3], features(kind, text, b, e)))
            taken.append((b, e))
    return out


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Resources = DEFAULT) -> DataFrame:
    """One row per document: doc_id, base (array of kind, start, end), found (array of candidates)."""
    sent = docs.sparkSession.sparkContext.broadcast(known)  # at most MOST_ENTRIES of either kind besides the built-in ones
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    more = pa.struct([*span, ("votes", pa.int32()), ("inputs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                own = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in own])
                found.append([dict(zip(("kind", "start", "end", "votes", "inputs"), c)) for c in candidates(text, own, sent.value)])
            columns = [batch.column(0), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(more))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "found"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(
        run,
        "doc_id long, base array<struct<kind:string,start:int,end:int>>, "
        "found array<struct<kind:string,start:int,end:int,votes:int,inputs:array<int>>>",
    )


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for independent labelers: (probability of each vote pattern being personal data,
    table [labeler, class, vote]). ``votes`` is [patterns, labelers] with 0 abstain, 1 yes, 2 no."""
    k = votes.shape[1]
    table = np.array([[[0.3, 0.1, 0.6], [0.3, 0.6, 0.1]]] * k)
    prior = 0.5
    p = np.zeros(len(votes))
    for _ in range(rounds):
        logs = np.log(table)
        yes = np.log(prior) + logs[np.arange(k), 1, votes].sum(1)
        no = np.log(1 - prior) + logs[np.arange(k), 0, votes].sum(1)
        p = 1 / (1 + np.exp(np.clip(no - yes, -60, 60)))
        prior = float(np.clip((p @ counts + 1) / (counts.sum() + 2), 0.01, 0.99))
        for c, share in ((1, p * counts), (0, (1 - p) * counts)):
            for v in range(3):
                table[:, c, v] = ((votes == v) * share[:, None]).sum(0) + (4 if v == (1 if c else 2) else 1)
            table[:, c] /= table[:, c].sum(1, keepdims=True)
    return p, table


def span_classifier(x: np.ndarray, y: np.ndarray, counts: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (counts * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (counts * (y - p)) - ridge * w)
    return w


def classifier(scan: DataFrame, fit_spans: int = FIT_SPANS) -> tuple[np.ndarray, dict[tuple[str, int], float]] | None:
    """Weights of the classifier's inputs, and the probability of each (kind, vote pattern); None without candidates."""
    found = scan.select(F.explode("found").alias("c"), "doc_id").select("c.*", "doc_id")
    counts = found.groupBy("kind", "votes").count().collect()  # at most 4 x 81 rows
    if not counts:
        return None
    probability = {}
    for kind in {r["kind"] for r in counts}:
        own = [r for r in counts if r["kind"] == kind]
        patterns = np.array([[r["votes"] // 3**i % 3 for i in (3, 2, 1, 0)] for r in own])
        p, _ = reliabilities(patterns, np.array([r["count"] for r in own], np.float64))
        probability |= {(kind, r["votes"]): float(x) for r, x in zip(own, p)}
    sample = first_by_hash(found, "kind", ["doc_id", "start", "end", "inputs"], fit_spans, ["kind", "votes", "inputs"])
    rows = Counter((r["kind"], r["votes"], tuple(r["inputs"])) for r in sample)
    x = np.zeros((len(rows), INPUTS))
    for i, (*_, inputs) in enumerate(sorted(rows)):
        x[i, list(inputs)] = 1
    y = np.array([probability[k, v] for k, v, _ in sorted(rows)])
    return span_classifier(x, y, np.array([rows[r] for r in sorted(rows)], np.float64)), probability


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, known: Resources = DEFAULT) -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of kind, start, end; spans include base).

    A null text is empty and has no spans; a null id stays null. Spans are by kind (base kinds, then added kinds), then
    start. Repeated rows are scanned each, long texts whole; an empty table stays empty; other columns are ignored.
    ``known`` is what the gazetteer and the context labeler know, see :func:`resources`.
    """
    scan = stored(scanned(docs, id_col, text_col, known))
    model = classifier(scan)
    weights = F.array(*[F.lit(float(w)) for w in (model[0] if model else np.zeros(INPUTS))])
    score = lambda c: F.aggregate(c["inputs"], F.lit(0.0), lambda total, i: total + F.element_at(weights, i + 1))
    order = F.create_map(*[F.lit(x) for i, k in enumerate((*BASE_KINDS, *ADDED_KINDS)) for x in (k, i)])
    added = F.filter("found", lambda c: score(c) >= math.log(threshold / (1 - threshold)))
    ranked = F.transform(
        F.concat("base", F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))),
        lambda s: F.struct(order[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scan.select("doc_id", "base", spans.alias("spans"))
