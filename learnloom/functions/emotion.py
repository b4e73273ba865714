"""Emotion columns: reliability, fusion, learning states, strategy.

Probabilities are arrays of seven doubles in the fixed order of ``EMOTIONS``; everything is array arithmetic in built-in
functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels in their order, the weights of the modalities and of the learning states.
EMOTIONS = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]
BASE_WEIGHTS, SHIFT = (0.4, 0.6), 0.2
STATES = {
    "attention": {"neutral": 0.4, "surprise": 0.3, "joy": 0.2, "sadness": -0.3, "disgust": -0.2},
    "engagement": {"joy": 0.5, "surprise": 0.3, "neutral": 0.1, "sadness": -0.3, "anger": -0.2, "disgust": -0.2},
    "understanding": {"neutral": 0.4, "joy": 0.3, "surprise": -0.5, "fear": -0.2, "sadness": -0.2},
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once: inside an array function an expression is evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalised(values: Column) -> Column:
    """Divided by their sum where that is positive."""
    share = lambda v, s: F.when(s > 0, F.transform(v, lambda x: x / s)).otherwise(v)
    return let(values, lambda v: let(total(v), lambda s: share(v, s)))


def label_of(probs: Column) -> Column:
    """The label of the largest probability, the first of equal ones."""
    place = let(probs, lambda p: F.array_position(p, F.array_max(p)).cast("int"))
    return F.when(probs.isNotNull(), F.element_at(F.array(*map(F.lit, EMOTIONS)), place))


def reliability(confidence: Column, probs: Column) -> Column:
    """The confidence if there is one; else 1 - entropy / log(n); 0.5 without probabilities, 1 for a single one."""
    clipped = F.transform(probs, lambda p: F.greatest(F.lit(1e-10), F.least(F.lit(1.0), p)))
    entropy = -total(F.transform(clipped, lambda p: p * F.log(p)))
    n = F.size(probs)
    own = F.when(probs.isNull() | (n == 0), 0.5).when(n == 1, 1.0).otherwise(1 - entropy / F.log(n.cast("double")))
    return F.coalesce(confidence, own)


def adjusted_weights(audio: Column, face: Column, base=BASE_WEIGHTS, shift: float = SHIFT) -> tuple[Column, Column]:
    """The weights of the two modalities by their reliabilities, each within 0.1 to 0.9, adding up to 1."""
    move = shift * (face - audio)
    a, f = (F.greatest(F.lit(0.1), F.least(F.lit(0.9), w)) for w in (base[0] - move, base[1] + move))
    return a / (a + f), f / (a + f)


def fused(audio: Column, face: Column, audio_weight: Column, face_weight: Column) -> Column:
    """Weighted sum of both modalities, normalised; one alone if the other is null."""
    weights = F.struct(audio_weight.alias("a"), face_weight.alias("f"))
    both = normalised(let(weights, lambda w: F.zip_with(audio, face, lambda a, f: w["a"] * a + w["f"] * f)))
    return F.when(audio.isNull(), face).when(face.isNull(), audio).otherwise(both)


def learning_state(probs: Column, name: str) -> Column:
    """Attention, engagement or understanding: a linear combination within 0 to 1."""
    parts = [F.lit(w) * F.element_at(probs, EMOTIONS.index(e) + 1) for e, w in STATES[name].items()]
    value = parts[0]
    for p in parts[1:]:
        value = value + p
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def smoothing_weights(n: int) -> list[float]:
    """exp of n steps from 0 to 1, normalised: the current result weighs most."""
    w = [math.exp(i / (n - 1)) if n > 1 else 1.0 for i in range(n)]
    return [x / sum(w) for x in w]


def smoothed(history: Column, most: int = 5) -> Column:
    """The weighted mean of a history of probability arrays (oldest first, at most ``most``), normalised."""
    weights = F.element_at(F.array(*[F.array(*map(F.lit, smoothing_weights(n))) for n in range(1, most + 1)]), F.size(history))
    weighted = F.zip_with(history, weights, lambda p, w: F.transform(p, lambda x: x * w))
    zero = F.array_repeat(F.lit(0.0), len(EMOTIONS))
    mean = F.aggregate(weighted, zero, lambda a, p: F.zip_with(a, p, lambda x, y: x + y))
    return F.when(F.size(history) == 1, history[0]).otherwise(normalised(mean))


def teaching_strategy(emotion: Column, attention: Column, understanding: Column) -> Column:
    """Tone, pace, level of detail, number of examples and gestures. Nulls are neutral (0.5)."""
    low = F.coalesce(attention, F.lit(0.5)) < 0.3
    sad = emotion.isin("sadness", "disgust")
    known = F.coalesce(understanding, F.lit(0.5))
    return F.struct(
        F.when(emotion == "joy", "positive").when(sad, "encouraging").otherwise("neutral").alias("tone"),
        F.when(emotion == "joy", "slightly_faster").when(sad, "slower").otherwise("normal").alias("pace"),
        F.when(known < 0.4, "very_basic").when(known > 0.7, "advanced").when(low, "low").otherwise("medium").alias("detail_level"),
        F.when(low, 2).otherwise(1).alias("example_count"),
        F.array_compact(F.array(F.when(low, F.lit("attention_seeking")), F.when(sad, F.lit("encouraging")))).alias("gestures"),
    )


def softmax(logits: Column) -> Column:
    return normalised(let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top))))


def map_percent_scores(scores: Column, names: dict[str, str]) -> Column:
    """A map of label to percent with known labels renamed and values as shares."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform_values(F.transform_keys(scores, lambda k, _: F.coalesce(known[k], k)), lambda _, v: v / 100)
