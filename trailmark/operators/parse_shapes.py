"""The column parser over many texts: what their digits do not decide is found once a shape.

A text's shape is its normalised form with all digits written as 9. Lexemes, tokens, windows and the ways to read them
follow from it, so they are made of the distinct shapes (``ways``), as places where numbers stand and what a reading
would cost, and joined to the texts; numbers, ranges, regions and scores are then evaluated for each text. Results are
those of ``parse_columns``, which parses UTM texts, long ones and those that are not plain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from trailmark import constants as C
from trailmark.operators import parse as P, parse_columns as N
from trailmark.operators.parse_columns import let

LONGEST = 300  # code points; a longer text has a shape of its own as a rule
LIGHT = "struct<lat:double,lon:double,score:double,region:double,way:int>"


def _spot(t: Column, starts: Column) -> Column:
    """Where a number stands in the text (from 1), its length, that of its whole part, and its decimals."""
    p = F.get(starts, t["at"]) + F.when(t["neg"], 2).otherwise(1)
    return F.struct(p.alias("p"), F.length(t["text"]).alias("n"), F.length(F.substring_index(t["text"], ".", 1)).alias("h"), t["dec"].alias("dec"), t["symbol"].alias("symbol"))


def _reading(fmt: str, pen, doubt, *parts: tuple[Column, Column], zero: Column | None = None) -> Column:
    """Degrees, minutes and seconds by place and length (0: none), and the place where a 0 must stand."""
    spots = [*parts, *[(F.lit(0), F.lit(0))] * (3 - len(parts))]
    out = [x.cast("int").alias(f"{k}{i}") for i, s in enumerate(spots, 1) for k, x in zip("pn", s)]
    pen, doubt = (x if isinstance(x, Column) else F.lit(x) for x in (pen, doubt))
    return F.struct(*out, (F.lit(0) if zero is None else zero).cast("int").alias("zero"), F.lit(fmt).alias("fmt"), pen.cast("double").alias("pen"), doubt.cast("string").alias("doubt"))


def _readings(g: Column, starts: Column) -> Column:
    """``parse.readings`` of a group of tokens, without what its digits decide."""

    def found(a: Column, b: Column, c: Column) -> Column:
        n = F.size(g)
        few = lambda many, some, none: F.when(a["dec"] >= 3, many).when(a["dec"] > 0, some).otherwise(none)
        glued = (a["p"] + a["h"] - 2, a["n"] - a["h"] + 2)
        single = F.array(
            F.when(~a["symbol"].isin("'", '"'), _reading("DD", few(F.lit(0.0), F.lit(float(C.DD_SHORT)), F.lit(float(C.DD_INTEGER))), few(F.lit(None).cast("string"), F.lit("few_decimals"), F.lit("whole_degrees")), (a["p"], a["n"]))),
            F.when((a["symbol"] == "") & (a["h"] >= 3), _reading("NMEA", C.NMEA, "glued", (a["p"], a["h"] - 2), glued)),
            F.when(a["h"] >= 4, _reading("DMM", C.DEGREE_AS_ZERO, "degree_as_zero", (a["p"], a["h"] - 3), glued, zero=a["p"] + a["h"] - 3)),
        )
        on = [(a["symbol"] == "'", "symbol_degree"), ((b["symbol"] == '"') & ~((a["symbol"] == "°") & (b["dec"] >= 3)), "symbol_minutes"), (b["dec"] < 3, "short_minutes")]
        doubts = F.filter(F.array(*[F.when(x, name) for x, name in on]), lambda x: x.isNotNull())
        pair = let(doubts, lambda d: F.array(F.when(a["dec"] == 0, _reading("DMM", C.DMM_FIX * F.size(d), F.when(F.size(d) > 0, F.array_join(d, ",")), (a["p"], a["n"]), (b["p"], b["n"])))))
        triple = F.array(F.when((a["dec"] == 0) & (b["dec"] == 0), _reading("DMS", 0.0, None, *((x["p"], x["n"]) for x in (a, b, c)))))
        return F.filter(F.when(n == 1, single).when(n == 2, pair).when(n == 3, triple).otherwise(F.array()), lambda r: r.isNotNull())

    return let(F.transform(g, lambda t: _spot(t, starts)), lambda s: found(*(F.get(s, F.lit(i)) for i in range(3))))


def _pairs(way: Column, spare: Column, first: Column, last: Column, starts: Column) -> Column:
    """``parse_columns.order_candidates`` of a shape: readings of both axes and what they score before their region."""
    hemi, swapped = way["hemi"], way["swapped"]
    symbols = F.size(F.filter(way["la"], lambda t: t["symbol"] != "")) + F.size(F.filter(way["lo"], lambda t: t["symbol"] != ""))
    base = F.when(hemi, C.HEMI).otherwise(0.0) + F.least(F.lit(C.SYMBOL_MOST), symbols) * C.SYMBOL
    turned = lambda g, on: F.when(on | F.get(g, F.lit(0))["neg"], -1.0).otherwise(1.0)
    start = F.get(starts, first)

    def pair(a: Column, b: Column, base: Column) -> Column:
        same = a["fmt"] == b["fmt"]
        score = base + F.when(same, C.SAME_FORMAT).otherwise(0.0) - (a["pen"] + b["pen"])
        notes = N._notes((swapped, F.lit("swapped")), (a["doubt"].isNotNull(), F.concat(F.lit("lat:"), a["doubt"])), (b["doubt"].isNotNull(), F.concat(F.lit("lon:"), b["doubt"])))
        fields = {
            "a": a, "b": b, "south": turned(way["la"], way["ha"] == "S"), "west": turned(way["lo"], way["hb"].isin("W", "O")), "score": score.cast("double"),
            "less": F.when(swapped, C.SWAPPED).otherwise(0.0).cast("double"), "unused": (spare * C.UNUSED).cast("double"), "hemi": hemi, "notes": notes, "mixed": ~same,
            "fmt": F.when(same, a["fmt"]).otherwise(F.concat(a["fmt"], F.lit(" / "), b["fmt"])), "at": start + 1, "size": F.get(starts, last + 1) - start,
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    sides = F.struct(_readings(way["la"], starts).alias("la"), _readings(way["lo"], starts).alias("lo"), base.alias("base"))
    return let(sides, lambda g: F.flatten(F.transform(g["la"], lambda a: F.transform(g["lo"], lambda b: pair(a, b, g["base"])))))


def ways(shape: Column) -> Column:
    """The ways to read texts of a shape as a position, in the order of ``parse``."""

    def of_lexemes(lex: Column) -> Column:
        starts = F.aggregate(lex, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(s))))
        return let(starts, lambda at: let(N.tokens(lex), lambda t: F.flatten(F.transform(N.runs(t), lambda r: N.run_candidates(r, lambda way, spare, first, last: _pairs(way, spare, first, last, at))))))

    return let(N.lexemes(shape), of_lexemes)


def _value(numbers: Column, r: Column, most: float, sign: Column) -> Column:
    """What a reading says, or null where its numbers rule it out."""
    part = lambda i: F.when(r[f"p{i}"] > 0, F.substr(numbers, r[f"p{i}"], r[f"n{i}"]).cast("double")).otherwise(0.0)
    holds = lambda q: (q["d"] <= most) & (q["m"] < 60) & (q["s"] < 60) & ((r["zero"] == 0) | (F.substr(numbers, r["zero"], F.lit(1)) == "0"))
    return let(F.struct(part(1).alias("d"), part(2).alias("m"), part(3).alias("s")), lambda q: F.when(holds(q), sign * (q["d"] + q["m"] / 60 + q["s"] / 3600)))


def parse_shape(norm: Column, known: Column) -> Column:
    """The parse of a normalised text by the ways of its shape."""

    def candidate(w: Column, k: Column, numbers: Column) -> Column:
        def scored(p: Column) -> Column:
            score = w["score"] + p["region"] - w["less"] - w["unused"]
            globe = (F.abs(p["y"]) <= 90) & (F.abs(p["x"]) <= 180) & ~((p["y"] == 0) & (p["x"] == 0))
            return F.when(globe, F.struct(p["y"].alias("lat"), p["x"].alias("lon"), score.alias("score"), p["region"].alias("region"), k.alias("way")).cast(LIGHT))

        at = F.struct(_value(numbers, w["a"], 90.0, w["south"]).alias("y"), _value(numbers, w["b"], 180.0, w["west"]).alias("x"))
        return let(let(at, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"), N.region_score(p["y"], p["x"]).alias("region"))), scored)

    def write(m: Column) -> Column:
        def one(w: Column) -> Column:
            notes = F.concat(N._notes((m["region"] == 0, F.lit("outside"))), w["notes"], N._notes((w["hemi"] & (m["lon"] < 0), F.lit("west")), (w["mixed"], F.lit("mixed_formats"))))
            seg = F.trim(F.regexp_replace(F.substr(norm, w["at"], w["size"]), f"[{N.SPACES}]+", " "))
            return F.struct(m["lat"].alias("lat"), m["lon"].alias("lon"), w["fmt"].alias("fmt"), m["score"].alias("score"), notes.alias("notes"), w["hemi"].alias("hemi"), seg.alias("seg")).cast(N.CANDIDATE)

        return let(F.get(known, m["way"]), one)

    made = let(F.translate(norm, ",", "."), lambda numbers: F.filter(F.transform(known, lambda w, k: candidate(w, k, numbers)), lambda m: m.isNotNull()))
    return let(made, lambda found: F.when(F.size(found) == 0, N.nothing(False, norm)).otherwise(N.chosen(norm, found, LIGHT, write)))


def parse_texts(texts: DataFrame, text: str = "text", parser: Callable[[Column], Column] = N.parse_strict) -> DataFrame:
    """text, p: the parse of each row; ``parser`` takes what has no shape to share.

    ``texts`` is read twice: for its shapes, and for the rows. Spark broadcasts the shapes if they are few by their size.
    """
    c = F.col(text)
    short = N.plain(c) & c.isNotNull() & (F.length(c) <= LONGEST)
    shape = lambda n: F.when(n.rlike(r"\d\D+\d") & ~n.rlike(N.UTM), F.regexp_replace(n, "[0-9]", "9"))
    split = let(F.when(short, N.normalise(c)), lambda n: F.struct(n.alias("norm"), shape(n).alias("shape")))
    # generators are evaluated where they stand, see ``parse.parse_once``
    rows = texts.select(text, F.explode(F.array(split)).alias("s")).select(text, "s.norm", "s.shape")
    shapes = rows.where("shape is not null").select(F.col("shape").alias("of")).distinct()
    shapes = shapes.select("of", F.explode(F.array(ways(F.col("of")))).alias("known"))
    # a text without a shape meets none, and is not sent to one task with all others
    met = rows.join(shapes, F.coalesce("shape", F.xxhash64(text).cast("string")) == F.col("of"), "left")
    p = F.when(F.col("known").isNotNull(), parse_shape(F.col("norm"), F.col("known"))).otherwise(parser(c))
    return met.select(text, F.explode(F.array(p)).alias("p"))


def all_positions(df: DataFrame, text: str = "text", parser: Callable[[Column], Column] = N.parse_strict) -> DataFrame:
    """``parse.all_positions``, with shapes parsed once."""
    return P.all_positions(df, text, parser, parse_texts)
