"""Photos from their readings to a state: what is left to read, the kept reading, its trust, and where it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trailmark.operators.trust import confidence, shot_state
from trailmark.operators.vote import settle, word_weight


def left_to_read(shots: DataFrame, states: DataFrame) -> DataFrame:
    """Shots that wait or failed, and those that came later: none is read twice (shots: id; states: id, st)."""
    done = states.where(~F.col("st").isin("wait", "fail")).select("id")
    return shots.join(done, "id", "left_anti")


def reading_confidence(readings: DataFrame, words: DataFrame) -> DataFrame:
    """Readings with ``tess``: the mean confidence of their words with a digit, weighted by length, null without any.

    words: photo, pass_idx, text, confidence. It is not rounded here: ``settle`` takes the chosen reading's, else the
    mean of the winners, and rounds once.
    """
    use = F.coalesce("text", F.lit("")).rlike("[0-9]") & F.col("confidence").isNotNull()
    w = word_weight(F.coalesce("text", F.lit(""))).cast("double")
    heard = words.groupBy("photo", "pass_idx").agg((F.sum(F.when(use, F.col("confidence") * w)) / F.sum(F.when(use, w))).alias("tess"))
    return readings.drop("tess").join(heard, ["photo", "pass_idx"], "left")


def read_photos(readings: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """photo, lat, lon, pct, level, st of each photo: settled, trusted and put in its state.

    For photos whose readings are all made: found is what has a position, and a photo without one is ``none``.
    ``words``, where given, are what the readings' confidence is taken from. ``photo_chain`` reads by rounds.
    """
    readings = readings if words is None else reading_confidence(readings, words)
    kept = settle(readings)
    trust = confidence(F.col("tess"), F.col("agree"), F.col("total"), F.col("sure"), F.col("rival"), F.size("notes"), F.size("alts"), F.lit(False))
    rows = kept.withColumn("trust", trust)
    state = shot_state(F.lit(True), ~F.col("none"), F.col("trust.level"), F.col("trust.pct"), F.lit(False), F.lit(0))
    return rows.withColumn("state", state).select("photo", "lat", "lon", F.col("state.pct").alias("pct"), F.col("trust.level").alias("level"), F.col("state.st").alias("st"))


def ended(shots: DataFrame, outcomes: DataFrame, results: DataFrame) -> DataFrame:
    """id, st of each shot after a run: bad file, failed, given up (waits again), or the state of its result.

    outcomes: id, how (``bad``, ``fail``, ``stop`` or ``read``; the last of a shot counts by seq); results: photo, st.
    """
    last = outcomes.groupBy("id").agg(F.max_by("how", "seq").alias("how"))
    rows = shots.select("id").join(last, "id", "left").join(results.select(F.col("photo").alias("id"), F.col("st").alias("found")), "id", "left")
    st = F.when(F.col("how").isin("bad", "fail"), F.col("how")).when(F.col("how") == "read", F.coalesce("found", F.lit("none"))).otherwise("wait")
    return rows.select("id", st.alias("st"))


def relief_key(lat: Column, lon: Column) -> Column:
    """The signature of a path's samples: their rounded positions in order."""
    at = F.transform(F.arrays_zip(lat.alias("a"), lon.alias("o")), lambda p: F.format_string("%.5f,%.5f", p["a"], p["o"]))
    return F.sha2(F.array_join(at, ";"), 256)
