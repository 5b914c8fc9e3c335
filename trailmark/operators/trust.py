"""Trust in a reading, and the gate that keeps doubtful positions back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trailmark.functions.geo import js_round


def confidence(tess: Column, n: Column, total: Column, firm: Column, rival: Column, notes: Column, alts: Column, manual: Column) -> Column:
    """struct(pct, level, why) of a result; ``n`` and ``total`` are null without a photo."""
    plain = manual | n.isNull()
    base = F.when(firm, 88 + F.least(F.lit(7.0), 2.0 * F.greatest(F.lit(0), n - 3))).otherwise(F.when(total > 0, 75.0 * n / F.nullif(total, F.lit(0))).otherwise(0.0))
    engine = F.when(tess.isNotNull(), F.greatest(F.lit(-10.0), F.least(F.lit(5.0), (tess - 60) / 4.0))).otherwise(0.0)
    factor = F.when(rival, 0.6).otherwise(1.0) * F.when(notes > 0, F.pow(F.lit(0.85), F.least(F.lit(2), notes))).otherwise(1.0) * F.when((alts > 0) & ~rival, 0.8).otherwise(1.0)
    pct = F.when(plain, 100 - 20 * notes - 15 * alts).otherwise(js_round((base + engine) * factor))
    pct = F.greatest(F.lit(0), F.least(F.lit(100), pct)).cast("int")
    ok = (notes == 0) & (alts == 0) & (plain | (firm & ~rival)) & (pct >= 70)
    why = F.filter(
        F.array(
            F.when(~plain & firm, "agreement"), F.when(~plain & ~firm, "few_agree"), F.when(~plain & (tess < 60), "engine_unsure"), F.when(~plain & rival, "rival_value"),
            F.when(notes > 0, "warnings"), F.when((alts > 0) & (plain | ~rival), "several_readings"),
        ),
        lambda x: x.isNotNull(),
    )
    return F.struct(pct.alias("pct"), F.when(ok, "ok").otherwise("check").alias("level"), why.alias("why"))


def trusted(ok: Column, verified: Column, level: Column) -> Column:
    """May a result be passed on: read well, or verified by hand."""
    return F.coalesce(ok & (F.coalesce(verified, F.lit(False)) | (level == "ok")), F.lit(False))


def carry_doubt(edits: DataFrame) -> DataFrame:
    """Edits of a doubtful photo reading stay doubtful until one is verified.

    edits: chain, seq, ok, ocr, verified, pct, level. An edit inherits the doubt of
    the result before it; the first of a chain, a verified one and a reading of
    their own stand for themselves. The inherited doubt lasts while each edit
    parses, so it reaches from the last result that stands for itself.
    """
    w = Window.partitionBy("chain").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("ocr") | F.coalesce(F.col("verified"), F.lit(False)) | ~F.col("ok") | (F.row_number().over(w) == 1)
    rows = edits.withColumn("own", own)
    source = F.last(F.when(F.col("own"), F.struct("ok", "ocr", "verified", "pct", "level")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("src", source)
    doubtful = ~F.col("own") & F.col("src.ocr") & F.col("src.ok") & ~trusted(F.col("src.ok"), F.col("src.verified"), F.col("src.level"))
    doubtful = F.coalesce(doubtful, F.lit(False))
    return rows.select("chain", "seq", "ok", (F.col("ocr") | doubtful).alias("ocr"), F.when(doubtful, F.coalesce("src.pct", F.lit(0))).otherwise(F.col("pct")).alias("pct"), F.when(doubtful, "check").otherwise(F.col("level")).alias("level"))


def shot_state(found: Column, has_result: Column, level: Column, pct: Column, quad: Column, angle: Column) -> Column:
    """struct(st, pct, steps): none, ok or check of a read photo."""
    none = ~F.coalesce(found, F.lit(False)) | ~F.coalesce(has_result, F.lit(False)) | level.isNull()
    steps = F.filter(F.array(F.when(quad, "perspective"), F.when(angle != 0, "levelled")), lambda x: x.isNotNull())
    return F.struct(F.when(none, "none").when(level == "ok", "ok").otherwise("check").alias("st"), F.when(~none, pct).alias("pct"), F.when(none, F.array().cast("array<string>")).otherwise(steps).alias("steps"))


def shot_point(fix: Column, best: Column, alts: Column, chosen: Column) -> Column:
    """The point kept for a photo: its correction by hand, else the chosen reading."""
    everything = F.concat(F.array(best), F.coalesce(alts, F.slice(F.array(best), 1, 0)))
    return F.coalesce(fix, F.when(best.isNotNull(), F.element_at(everything, F.least(F.coalesce(chosen, F.lit(0)) + 1, F.size(everything)))))


def batch_summary(shots: DataFrame) -> DataFrame:
    """Counts of a batch by state, and its latest sure photo."""
    has = lambda s: F.count_if(F.col("st") == s)
    return shots.groupBy("batch").agg(
        has("ok").alias("ok"), has("check").alias("to_check"), F.count_if(F.col("st").isin("none", "bad", "fail")).alias("left_over"), F.count_if(F.col("st").isin("wait", "fail")).alias("to_read"),
        F.max_by(F.when(F.col("st") == "ok", F.col("id")), F.when(F.col("st") == "ok", F.struct("t", "id"))).alias("latest_ok"),
    )


def latest_fix(shots: DataFrame, fixes: DataFrame) -> DataFrame:
    """Shots with their last edit by hand: a fix makes them ok, an undo puts them to check.

    fixes: id, seq, undo, lat, lon.
    """
    last = fixes.groupBy("id").agg(F.max_by(F.struct("undo", "lat", "lon"), "seq").alias("f"))
    out = shots.join(last, "id", "left")
    st = F.when(F.col("f").isNull(), F.col("st")).when(F.col("f.undo"), "check").otherwise("ok")
    fixed = F.coalesce(~F.col("f.undo"), F.lit(False))
    return out.select(*[c for c in shots.columns if c not in ("st", "lat", "lon")], st.alias("st"), F.when(fixed, F.col("f.lat")).otherwise(F.col("lat")).alias("lat"), F.when(fixed, F.col("f.lon")).otherwise(F.col("lon")).alias("lon"))
