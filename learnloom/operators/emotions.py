"""Emotion results: pairing modalities, fusing, smoothing, series and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import emotion as em


def pair_modalities(results: DataFrame, order: list[str]) -> DataFrame:
    """The n-th audio result of a session with its n-th face result; a side can be missing.

    ``results`` has session_id, modality, probs, confidence, error and the order columns; the pair takes the later order.
    """
    n = F.row_number().over(Window.partitionBy("session_id", "modality").orderBy(*order))
    own = results.withColumn("n", n)

    def side(name: str) -> DataFrame:
        renamed = [F.col(c).alias(f"{name}_{c}") for c in ("probs", "confidence", "error")]
        return own.where(F.col("modality") == name).select("session_id", "n", *renamed, F.struct(*order).alias(f"{name}_at"))

    both = side("audio").join(side("face"), ["session_id", "n"], "full_outer")
    return both.withColumn("at", F.greatest("audio_at", "face_at")).drop("audio_at", "face_at")


def fuse_emotions(pairs: DataFrame) -> DataFrame:
    """Adds probs, emotion, confidence and error to pairs. A side with an error leaves the other; both make an error."""
    audio = F.when(F.col("audio_error").isNull(), F.col("audio_probs"))
    face = F.when(F.col("face_error").isNull(), F.col("face_probs"))
    weights = em.adjusted_weights(em.reliability(F.col("audio_confidence"), audio), em.reliability(F.col("face_confidence"), face))
    out = pairs.withColumn("probs", em.fused(audio, face, *weights))
    error = F.when(F.col("probs").isNull(), F.coalesce("audio_error", "face_error", F.lit("no result")))
    return out.withColumns({"emotion": em.label_of(F.col("probs")), "confidence": F.array_max("probs"), "error": error})


def smooth_emotions(fused: DataFrame, order: list[str], history: int = 5) -> DataFrame:
    """Smooths each session's fused results over the last ``history`` unsmoothed ones: adds smoothed, emotion, confidence.

    With ``order`` the number of the pair, results follow each other as they are complete, which is what the stream does.

    Results with an error are left out; learning states stay those of the current row.
    """
    last = Window.partitionBy("session_id").orderBy(*order).rowsBetween(1 - history, 0)
    rows = fused.where("probs is not null").withColumn("past", F.collect_list("probs").over(last))
    rows = rows.withColumn("smoothed", em.smoothed(F.col("past"), history)).drop("past")
    return rows.withColumns({"emotion": em.label_of(F.col("smoothed")), "confidence": F.array_max("smoothed")})


def with_learning_states(rows: DataFrame, probs: str = "probs") -> DataFrame:
    return rows.withColumns({name: em.learning_state(F.col(probs), name) for name in em.STATES})


def attention_alerts(rows: DataFrame, threshold: float = 0.3, face: Column | None = None) -> DataFrame:
    """Rows with a detected face whose attention is positive and below the threshold; works on streams too."""
    face = F.col("face_detected") if face is None else face
    return rows.where(face & (F.col("attention") > 0) & (F.col("attention") < threshold))


def bounded_series(rows: DataFrame, key: list[str], order: list[str], n: int = 100) -> DataFrame:
    """The last ``n`` rows of each series."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def series(rows: DataFrame, key: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """One aligned array for each name of ``values`` and one of labels (times as text), in order, per key; missing values are 0."""
    filled = [F.coalesce(v, F.lit(0.0)).alias(n) for n, v in values.items()]
    at = F.struct(*order, *[f.alias(n) for f, n in zip(filled, values)])
    listed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(at)).alias("all"))
    return listed.select(*key, F.transform("all", lambda x: F.date_format(x[order[0]], "yyyy-MM-dd HH:mm:ss")).alias("labels"), *[_field("all", n) for n in values])


def _field(array: str, name: str) -> Column:
    return F.transform(array, lambda x: x[name]).alias(name)


def emotion_series(rows: DataFrame, key: list[str], order: list[str], n: int = 100) -> DataFrame:
    """The last ``n`` probabilities of each emotion, aligned by time; a label that a result lacks is 0."""
    last = bounded_series(rows.where("probs is not null"), key, order, n)
    return series(last, key, order, {e: F.element_at("probs", i + 1) for i, e in enumerate(em.EMOTIONS)})


def learning_state_series(rows: DataFrame, key: list[str], order: list[str], n: int = 100) -> DataFrame:
    return series(bounded_series(rows, key, order, n), key, order, {s: F.col(s) for s in em.STATES})


def emotion_transition_matrix(rows: DataFrame, order: list[str]) -> DataFrame:
    """Estimated probability of the next emotion given the current one: emotion, next, n, p."""
    after = F.lead("emotion").over(Window.partitionBy("session_id").orderBy(*order))
    pairs = rows.withColumn("next", after).where("next is not null").groupBy("emotion", "next").agg(F.count("*").alias("n"))
    return pairs.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("emotion")))


def gpu_series(rows: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """Per device: utilisation and used memory in MB, aligned, and the first total repeated.

    ``rows`` has device_id, utilisation, used_bytes, total_bytes.
    """
    last = bounded_series(rows, ["device_id"], order, n)
    mb = lambda c: F.col(c) / 1024 / 1024
    out = series(last, ["device_id"], order, {"utilisation": F.col("utilisation").cast("double"), "used_mb": mb("used_bytes"), "total_mb": mb("total_bytes")})
    return out.withColumn("total_mb", F.array_repeat(F.element_at("total_mb", 1), F.size("total_mb")))


def largest_region_per_frame(detections: DataFrame) -> DataFrame:
    """The detection with the largest h x w of each frame; ties go to the smallest box_id."""
    best = F.max_by(F.struct("box_id", "h", "w"), F.struct(F.col("h") * F.col("w"), -F.col("box_id")))
    return detections.groupBy("frame").agg(best.alias("b")).select("frame", "b.*")


def signal_energy_zcr(samples: DataFrame, key: list[str], order: list[str], window: str = "1 hour") -> DataFrame:
    """Root mean square and zero-crossing rate of ``value`` per key and tumbling window of ``ts``."""
    own = Window.partitionBy(*key, "start").orderBy(*order)
    framed = samples.withColumn("start", F.window("ts", window)["start"])
    crossed = (F.lag("value").over(own) >= 0) != (F.col("value") >= 0)
    framed = framed.withColumn("crossed", F.coalesce(crossed.cast("int"), F.lit(0)))
    return framed.groupBy(*key, "start").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("energy"), F.avg("crossed").alias("zcr"), F.count("*").alias("samples"))


def frame_energy_zcr(samples: DataFrame, key: list[str], frame: int = 2048, hop: int = 512) -> DataFrame:
    """Mean energy and zero-crossing rate of a signal over overlapping frames: key, energy, zcr, frames.

    ``samples`` has the key, position (from 0, one sample each) and value. A frame has ``frame`` samples and begins at a
    multiple of ``hop``, which divides it; its energy is the root of the mean square, its rate the share of samples whose
    sign differs from that of the sample before it in the frame (0 counts as positive). Samples are summed once, in panes
    of ``hop``, and frames are sums of panes, so the work does not grow with the overlap and no task sorts a whole signal.
    A frame that lacks a sample, or has a null one, does not count; a signal without a frame has no row.
    """
    if frame % hop:
        raise ValueError("hop must divide frame")
    panes = frame // hop
    own = [*key, "pane"]
    placed = samples.where("value is not null").withColumn("pane", F.floor(F.col("position") / hop))
    inside = Window.partitionBy(*own).orderBy("position")
    turned = (F.lag("value").over(inside) >= 0) != (F.col("value") >= 0)
    ends = [F.min_by("value", "position").alias("first"), F.max_by("value", "position").alias("last")]
    sums = [F.sum(F.col("value") * F.col("value")).alias("square"), F.sum(F.coalesce(F.col("turned").cast("int"), F.lit(0))).alias("turns"), F.count("*").alias("size")]
    pane = placed.withColumn("turned", turned).groupBy(*own).agg(*ends, *sums)
    ordered = Window.partitionBy(*key).orderBy("pane")
    # Where the sign changes between two panes counts in every frame that has both.
    pane = pane.withColumn("edge", F.coalesce(((F.lag("last").over(ordered) >= 0) != (F.col("first") >= 0)).cast("int"), F.lit(0)))
    ahead = ordered.rowsBetween(0, panes - 1)
    total = lambda c: F.sum(c).over(ahead)
    framed = pane.select(
        *key, (total("square") / frame).alias("power"), ((total("turns") + total("edge") - F.col("edge")) / frame).alias("rate"),
        total("size").alias("samples"), (F.max("pane").over(ahead) - F.col("pane")).alias("span"),
    )
    whole = framed.where((F.col("samples") == frame) & (F.col("span") == panes - 1))
    return whole.groupBy(*key).agg(F.avg(F.sqrt("power")).alias("energy"), F.avg("rate").alias("zcr"), F.count("*").alias("frames"))


def mean_pool_embeddings(tokens: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean of the vectors of each key by position; null vectors are masked. Partial sums by position keep tasks small."""
    parts = tokens.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(key).agg(F.transform(ordered, lambda p: p["x"]).alias("pooled"))
