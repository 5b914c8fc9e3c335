"""The parser as column expressions: no Python, no shuffle, no explode.

A text is normalised by regular expressions, cut into lexemes that cover it, and its
tokens, runs and windows are arrays; candidates are made, scored and compared in
them. The grammar and its constants are those of ``parse``, which stays the parser of
texts that Unicode's compatibility forms would change: ``plain`` tells the others.

A lambda's body is evaluated where it stands, so what is used twice is bound by ``let``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from trailmark import constants as C
from trailmark.functions.geo import haversine_m, utm_position
from trailmark.operators import parse as P

SPACES = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = "A-Za-z0-9_"
CANDIDATE, RESULT = P.CANDIDATE, P.RESULT
TEXTS = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _simple_forms() -> tuple[str, str, str]:
    """Characters whose compatibility form is one character, as a pattern class; and those to be replaced, by what."""
    known = [*range(0x250), *range(0x2010, 0x2060), *map(ord, P.APOSTROPHES + P.QUOTES + P.DEGREES + "\u1680\u2028\u2029\u3000\ufeff€")]
    signs = {**dict.fromkeys(P.APOSTROPHES, "'"), **dict.fromkeys(P.QUOTES, '"'), **dict.fromkeys(P.DEGREES, "°")}
    ranges, source, target = [], "", ""
    for c in sorted(set(known)):
        form = unicodedata.normalize("NFKC", chr(c))
        if len(form) != 1 or unicodedata.combining(form):
            continue
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
        final = " " if P.BLANKS.match(form) else signs.get(form, form)
        if final != chr(c):
            source, target = source + chr(c), target + final
    return "".join(f"\\x{{{a:x}}}-\\x{{{z:x}}}" for a, z in ranges), source, target


_PLAIN, _FROM, _TO = _simple_forms()


def plain(text: Column) -> Column:
    """Whether each character stands for itself, or for one other, under compatibility normalisation."""
    return text.isNull() | text.rlike(f"^[{_PLAIN}]*$")


def normalise(text: Column) -> Column:
    """``parse.normalise`` of a plain text."""
    out = F.translate(text, _FROM, _TO)
    for pattern, by in [
        ("''", '"'),
        (f"(?i)(?<![{WORD}])(?:deg(?:res?|r[éÉ]s)?(?![{WORD}])|degr[éÉ](?=[{WORD}]))", "°"),
        (r"(\d)\s*\*", "$1°"),
        (r"(?<![A-Za-z0-9.,])[oO][oO](?=\d)", "00"),
        (r"(?<![A-Za-z0-9.,])[oO](?=\d)", "0"),
        (r"(?<![\d.,])(\d{1,3})[oO](?=\s?\d{1,2}(?:[.,][\dOo]|\s*'|\s+\d))", "$1°"),
    ]:
        out = F.regexp_replace(out, pattern, by)

    def repaired(t: Column) -> Column:
        done = t
        for _ in range(3):
            for pattern, by in [(r"(?<=\d)[oO](?=[\d.,°'\"])", "0"), (r"(?<=[\d.,])[oO](?=\d)", "0"), (r"(?<=\d)[lI|](?=[\d.,])", "1"), (r"(?<=[\d.,])[lI|](?=\d)", "1")]:
                done = F.regexp_replace(done, pattern, by)
        return F.when(t.rlike(r"[\d.,][oOlI|]"), done).otherwise(t)

    return let(out, repaired)


def lexemes(norm: Column) -> Column:
    """The pieces of a normalised text, white space included: together they are the text."""
    forms = [rf"-?\d+(?:{mark}\d+)?|[°'\"]|[A-Za-zÀ-ÿ]+|\s+|\S" for mark in (r"\.", "[.,]")]
    return F.when(norm.rlike(r"\d\.\d"), F.regexp_extract_all(norm, F.lit(forms[0]), F.lit(0))).otherwise(F.regexp_extract_all(norm, F.lit(forms[1]), F.lit(0)))


NEUTRAL_CLASS = "[" + "".join("\\" + c for c in ",;/:()[]=@&?#+_|!.~*-") + r"\s]+"


def kinds(lex: Column) -> Column:
    """array<struct<kind, text, at>> of the lexemes that mean something; ``at`` counts lexemes from 0."""
    hemi = F.create_map(*[F.lit(x) for kv in P.HEMISPHERES.items() for x in kv])
    skipped = F.array(*[F.lit(w) for w in sorted(P.SKIPPED)])

    def one(s: Column, i: Column) -> Column:
        low = F.lower(s)
        kind = (
            F.when(s.rlike(r"^-?\d"), "num")
            .when(s.isin("°", "'", '"'), "sym")
            .when(s.rlike("^" + NEUTRAL_CLASS + "$"), "")
            .when(s.rlike("^[A-Za-zÀ-ÿ]"), F.when(F.array_contains(skipped, low), "").when(F.element_at(hemi, low).isNotNull(), "hemi").otherwise("word"))
            .otherwise("word")
        )
        return F.struct(kind.alias("kind"), s.alias("text"), i.alias("at"))

    return F.filter(F.transform(lex, one), lambda x: x["kind"] != "")


def tokens(lex: Column) -> Column:
    """Numbers with their symbol, hemispheres and words: kind, text, neg, symbol, at, end, same (line as the one before)."""
    hemi = F.create_map(*[F.lit(x) for kv in P.HEMISPHERES.items() for x in kv])
    breaks = F.filter(F.transform(lex, lambda s, i: F.when(s.contains("\n"), i)), lambda x: x.isNotNull())

    def made(sig: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after = F.get(sig, i + 1)
            symbol = F.when((x["kind"] == "num") & (after["kind"] == "sym"), after["text"])
            text = F.when(x["kind"] == "num", F.translate(F.regexp_replace(x["text"], "^-", ""), ",", ".")).when(x["kind"] == "hemi", F.element_at(hemi, F.lower(x["text"])))
            return F.struct(x["kind"].alias("kind"), text.alias("text"), F.startswith(x["text"], F.lit("-")).alias("neg"), symbol.alias("symbol"), x["at"].alias("at"), F.when(symbol.isNotNull(), after["at"]).otherwise(x["at"]).alias("end"))

        return F.filter(F.transform(sig, one), lambda t: t["kind"] != "sym")

    def placed(toks: Column, nl: Column) -> Column:
        def one(t: Column, i: Column, head: Column) -> Column:
            before, n = F.get(toks, i - 1)["at"], F.length(head)
            fields = {
                "kind": t["kind"], "text": t["text"], "neg": t["neg"], "symbol": F.coalesce(t["symbol"], F.lit("")), "at": t["at"], "end": t["end"],
                "same": (i > 0) & ~F.exists(nl, lambda k: (k > before) & (k < t["at"])),
                "v": F.when(n > 0, t["text"].cast("double")), "dec": F.greatest(F.lit(0), F.length(t["text"]) - n - 1),
                "glued": F.when(n >= 3, F.substr(t["text"], n - 1).cast("double")),
                "high": F.when(n >= 3, F.substr(head, F.lit(1), n - 2).cast("double")),
                "far": F.when((n >= 4) & (F.substr(head, n - 2, F.lit(1)) == "0"), F.substr(head, F.lit(1), n - 3).cast("double")),
            }
            return F.struct(*[v.alias(k) for k, v in fields.items()])

        return F.transform(toks, lambda t, i: let(F.when(t["kind"] == "num", F.substring_index(t["text"], ".", 1)), lambda head: one(t, i, head)))

    return let(let(kinds(lex), made), lambda toks: let(breaks, lambda nl: placed(toks, nl)))


def runs(toks: Column) -> Column:
    """Stretches of numbers and hemispheres between words, those with two numbers or more."""
    cuts = F.concat(F.array(F.lit(-1)), F.filter(F.transform(toks, lambda t, i: F.when(t["kind"] == "word", i)), lambda i: i.isNotNull()), F.array(F.size(toks)))
    cut = let(cuts, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda r: F.slice(toks, F.get(c, r - 1) + 2, F.get(c, r) - F.get(c, r - 1) - 1)))
    return F.filter(cut, lambda r: F.size(F.filter(r, lambda t: t["kind"] == "num")) >= 2)


READING = "struct<v:double,fmt:string,pen:double,doubt:string>"
#: What a candidate is compared by; its notes, format and text are written out for those that are kept.
LIGHT = f"struct<lat:double,lon:double,score:double,region:double,a:{READING},b:{READING},swapped:boolean,hemi:boolean,at:int,end:int,utm:string>"


def _reading(v: Column, fmt: str, pen, doubt) -> Column:
    return F.struct(v.alias("v"), F.lit(fmt).alias("fmt"), (pen if isinstance(pen, Column) else F.lit(float(pen))).alias("pen"), (doubt if isinstance(doubt, Column) else F.lit(doubt).cast("string")).alias("doubt"))


def readings(g: Column, most: float) -> Column:
    """``parse.readings`` of a group of one to three numbers."""
    a, b, c = (F.get(g, F.lit(i)) for i in range(3))
    n, lit = F.size(g), F.lit(most)
    short = F.when(a["dec"] >= 3, 0.0).when(a["dec"] > 0, C.DD_SHORT).otherwise(C.DD_INTEGER)
    why = F.when(a["dec"] >= 3, F.lit(None).cast("string")).when(a["dec"] > 0, "few_decimals").otherwise("whole_degrees")
    single = F.array(
        F.when((a["v"] <= lit) & ~a["symbol"].isin("'", '"'), _reading(a["v"], "DD", short, why)),
        F.when((a["symbol"] == "") & (a["high"] <= lit) & (a["glued"] < 60), _reading(a["high"] + a["glued"] / 60, "NMEA", C.NMEA, "glued")),
        F.when((a["far"] <= lit) & (a["glued"] < 60), _reading(a["far"] + a["glued"] / 60, "DMM", C.DEGREE_AS_ZERO, "degree_as_zero")),
    )
    doubts = F.filter(
        F.array(
            F.when(a["symbol"] == "'", "symbol_degree"),
            F.when((b["symbol"] == '"') & ~((a["symbol"] == "°") & (b["dec"] >= 3)), "symbol_minutes"),
            F.when(b["dec"] < 3, "short_minutes"),
        ),
        lambda x: x.isNotNull(),
    )
    pair = let(doubts, lambda d: F.array(F.when((a["dec"] == 0) & (a["v"] <= lit) & (b["v"] < 60), _reading(a["v"] + b["v"] / 60, "DMM", C.DMM_FIX * F.size(d), F.when(F.size(d) > 0, F.array_join(d, ","))))))
    triple = F.array(F.when((a["dec"] == 0) & (b["dec"] == 0) & (a["v"] <= lit) & (b["v"] < 60) & (c["v"] < 60), _reading(a["v"] + b["v"] / 60 + c["v"] / 3600, "DMS", 0.0, None)))
    found = F.when(n == 1, single).when(n == 2, pair).when(n == 3, triple).otherwise(F.array().cast(f"array<{READING}>"))
    found = F.filter(found, lambda r: r.isNotNull())
    return F.when(a["neg"], F.transform(found, lambda r: F.struct((-r["v"]).alias("v"), r["fmt"].alias("fmt"), r["pen"].alias("pen"), r["doubt"].alias("doubt")))).otherwise(found)


def region_score(lat: Column, lon: Column) -> Column:
    inside = lambda b: (lat >= b[0]) & (lat <= b[1]) & (lon >= b[2]) & (lon <= b[3])
    return F.when(inside(C.ALPS), C.IN_ALPS).when(inside(C.FRANCE), C.IN_FRANCE).otherwise(0.0)


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _notes(*pairs: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*[F.when(on, name) for on, name in pairs]), lambda x: x.isNotNull()).cast(TEXTS)


def order_candidates(way: Column, spare: Column, first: Column, last: Column) -> Column:
    """Candidates of a latitude group and a longitude group, as ``LIGHT``."""
    hemi, swapped = way["hemi"], way["swapped"]
    symbols = F.size(F.filter(way["la"], lambda t: t["symbol"] != "")) + F.size(F.filter(way["lo"], lambda t: t["symbol"] != ""))
    base = F.when(hemi, C.HEMI).otherwise(0.0) + F.least(F.lit(C.SYMBOL_MOST), symbols) * C.SYMBOL

    def pair(a: Column, b: Column, base: Column) -> Column:
        y = F.when(way["ha"] == "S", -F.abs(a["v"])).otherwise(a["v"])
        x = F.when(way["hb"].isin("W", "O"), -F.abs(b["v"])).otherwise(b["v"])

        def scored(p: Column) -> Column:
            score = base + F.when(a["fmt"] == b["fmt"], C.SAME_FORMAT).otherwise(0.0) - (a["pen"] + b["pen"]) + p["region"] - F.when(swapped, C.SWAPPED).otherwise(0.0) - spare * C.UNUSED
            return F.struct(p["y"].alias("lat"), p["x"].alias("lon"), score.alias("score"), p["region"].alias("region"), a.alias("a"), b.alias("b"), swapped.alias("swapped"), hemi.alias("hemi"), first.alias("at"), last.alias("end"), F.lit(None).cast("string").alias("utm"))

        return let(F.struct(y.alias("y"), x.alias("x"), region_score(y, x).alias("region")), scored)

    sides = F.struct(readings(way["la"], 90.0).alias("la"), readings(way["lo"], 180.0).alias("lo"), base.alias("base"))
    return let(sides, lambda g: F.flatten(F.transform(g["la"], lambda a: F.transform(g["lo"], lambda b: pair(a, b, g["base"])))))


def written(m: Column, lex: Column) -> Column:
    """A kept candidate with its format, notes and text."""
    a, b, plain_ = m["a"], m["b"], m["utm"].isNull()
    same = a["fmt"] == b["fmt"]
    notes = _notes(
        (m["region"] == 0, F.when(plain_, "outside").otherwise("outside_utm")), (m["swapped"], F.lit("swapped")), (a["doubt"].isNotNull(), F.concat(F.lit("lat:"), a["doubt"])), (b["doubt"].isNotNull(), F.concat(F.lit("lon:"), b["doubt"])),
        (plain_ & m["hemi"] & (m["lon"] < 0), F.lit("west")), (~same, F.lit("mixed_formats")),
    )
    seg = F.coalesce(m["utm"], F.array_join(F.slice(lex, m["at"] + 1, m["end"] - m["at"] + 1), ""))
    seg = F.trim(F.regexp_replace(seg, f"[{SPACES}]+", " "))
    fmt = F.when(same, a["fmt"]).otherwise(F.concat(a["fmt"], F.lit(" / "), b["fmt"]))
    return F.struct(m["lat"].alias("lat"), m["lon"].alias("lon"), fmt.alias("fmt"), m["score"].alias("score"), notes.alias("notes"), m["hemi"].alias("hemi"), seg.alias("seg")).cast(CANDIDATE)


def window_candidates(run: Column, i: Column, j: Column, spare: Column, made: Callable = order_candidates) -> Column:
    """Candidates of the tokens i..j-1 of a run, each way to read it by ``made``."""
    size = j - i

    def ways(w: Column, numbers: Column, hemis: Column) -> Column:
        """array<struct<la, lo, la_hemi, lo_hemi, swapped, hemi>>: the ways to read a window as two groups."""
        way = lambda la, lo, ha, hb, swapped, hemi: F.struct(la.alias("la"), lo.alias("lo"), ha.alias("ha"), hb.alias("hb"), F.lit(swapped).alias("swapped"), F.lit(hemi).alias("hemi"))
        none = F.lit("")
        n = F.size(numbers)
        marks = F.filter(F.transform(numbers, lambda t, k: F.when(t["symbol"] == "°", k)), lambda k: k.isNotNull())
        degree = let(marks, lambda m: F.when((F.size(m) == 2) & (F.get(m, F.lit(0)) == 0), F.get(m, F.lit(1))))
        even = F.when(n % 2 == 0, (n / 2).cast("int"))
        halves = let(degree, lambda d: F.filter(F.array(d, F.when(d.isNull() | (even != d), even)), lambda k: k.isNotNull()))
        bare = F.flatten(F.transform(halves, lambda k: F.array(way(F.slice(numbers, F.lit(1), k), F.slice(numbers, k + 1, n - k), none, none, False, False), way(F.slice(numbers, k + 1, n - k), F.slice(numbers, F.lit(1), k), none, none, True, False))))
        p, q = F.get(hemis, F.lit(0)), F.get(hemis, F.lit(1))
        before, after = F.get(run, i - 1), F.get(run, j)
        cut_after = F.coalesce((after["kind"] == "num") & after["same"], F.lit(False))
        cut_before = F.coalesce((before["kind"] == "num") & F.get(w, F.lit(0))["same"], F.lit(False))
        ahead, behind = (p == 0) & ~cut_after, (p != 0) & (q == size - 1) & ~cut_before
        ga = F.when(ahead, F.slice(w, F.lit(2), F.greatest(F.lit(0), q - 1))).otherwise(F.slice(w, F.lit(1), F.greatest(F.lit(0), p)))
        gb = F.when(ahead, F.slice(w, q + 2, F.greatest(F.lit(0), size - q - 1))).otherwise(F.slice(w, p + 2, F.greatest(F.lit(0), q - p - 1)))
        ha, hb = F.get(w, p)["text"], F.get(w, q)["text"]
        north = ha.isin("N", "S")
        apart = north != hb.isin("N", "S")
        groups = F.when((ahead | behind) & apart, F.when(north, F.array(way(ga, gb, ha, hb, False, True))).otherwise(F.array(way(gb, ga, hb, ha, False, True))))
        return F.when(F.size(hemis) == 0, bare).when(F.size(hemis) == 2, F.filter(F.coalesce(groups, F.array()), lambda g: (F.size(g["la"]) > 0) & (F.size(g["lo"]) > 0)))

    def of_window(w: Column) -> Column:
        numbers = F.filter(w, lambda t: t["kind"] == "num")
        hemis = F.filter(F.transform(w, lambda t, k: F.when(t["kind"] == "hemi", k)), lambda k: k.isNotNull())
        found = let(F.struct(numbers.alias("n"), hemis.alias("h")), lambda x: ways(w, x["n"], x["h"]))
        first, last = F.get(w, F.lit(0))["at"], F.get(w, size - 1)["end"]
        return F.flatten(F.transform(F.coalesce(found, F.array()), lambda g: made(g, spare, first, last)))

    return let(F.slice(run, i + 1, size), of_window)


def run_candidates(run: Column, made: Callable = order_candidates) -> Column:
    """Candidates of all windows of two to ten tokens with two to six numbers and no or two hemispheres, by their first token."""
    n = F.size(run)
    # how many numbers are ahead of each token; the rest are hemispheres
    ahead = F.transform(F.sequence(F.lit(0), n), lambda k: F.size(F.filter(F.slice(run, F.lit(1), k), lambda t: t["kind"] == "num")))

    def of_run(c: Column) -> Column:
        def from_first(i: Column) -> Column:
            ends = F.when(n - i >= 2, F.sequence(i + 2, F.least(i + 10, n))).otherwise(_none("int"))
            inside = lambda j: F.get(c, j) - F.get(c, i)
            kept = F.filter(ends, lambda j: inside(j).between(2, 6) & (j - i - inside(j)).isin(0, 2))
            return F.flatten(F.transform(kept, lambda j: window_candidates(run, i, j, F.get(c, n) - inside(j), made)))

        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), from_first))

    return let(ahead, of_run)


UTM = r"(?:^|[^\dA-Za-z])((\d{1,2})\s?([C-HJ-NP-X])(?![A-Za-z])\s*(?:E\s*:?\s*)?(\d{6,7})(?:[.,]\d+)?\s*(?:m(?![A-Za-z0-9_])\s*)?(?:E(?![A-Za-z0-9_])\s*)?(?:N\s*:?\s*)?(\d{7})(?:[.,]\d+)?)"


def utm_candidates(norm: Column) -> Column:
    part = lambda g: F.regexp_extract_all(norm, F.lit(UTM), F.lit(g))

    def one(m: Column) -> Column:
        zone, band = m["zone"].cast("int"), m["band"]
        found = utm_position(zone, band, m["east"].cast("double"), m["north"].cast("double"), let)

        def made(at: Column) -> Column:
            region = region_score(at["lat"], at["lon"])
            form = _reading(F.lit(0.0), "", 0.0, None).withField("fmt", F.concat(F.lit("UTM "), zone.cast("string"), band))
            c = F.struct(at["lat"].alias("lat"), at["lon"].alias("lon"), (F.lit(C.UTM_BASE) + region).alias("score"), region.alias("region"), form.alias("a"), form.alias("b"), F.lit(False).alias("swapped"), F.lit(True).alias("hemi"), F.lit(0).alias("at"), F.lit(0).alias("end"), m["seg"].alias("utm"))
            return F.when(zone.between(1, 60) & (F.abs(at["lat"]) <= 84), c.cast(LIGHT))

        # rounded metres may lie a little beyond the date line
        lon = lambda x: F.when(x < -180, F.when(x >= -180 - C.DATE_LINE_SLACK, x + 360).otherwise(x)).when((x > 180) & (x <= 180 + C.DATE_LINE_SLACK), x - 360).otherwise(x)
        return let(let(found, lambda at: F.struct(at["lat"].alias("lat"), lon(at["lon"]).alias("lon"))), made)

    zipped = F.arrays_zip(part(1).alias("seg"), part(2).alias("zone"), part(3).alias("band"), part(4).alias("east"), part(5).alias("north"))
    return F.when(norm.rlike(UTM), F.filter(F.transform(zipped, one), lambda c: c.isNotNull())).otherwise(_none(LIGHT))


def candidates(norm: Column, lex: Column) -> Column:
    made = F.concat(utm_candidates(norm), let(tokens(lex), lambda t: F.flatten(F.transform(runs(t), lambda r: run_candidates(r)))))
    return F.filter(made, lambda m: (F.abs(m["lat"]) <= 90) & (F.abs(m["lon"]) <= 180) & ~((m["lat"] == 0) & (m["lon"] == 0)))


def nothing(empty: bool, norm: Column) -> Column:
    """The parse of a text without a position."""
    return F.struct(F.lit(False).alias("ok"), F.lit(empty).alias("empty"), norm.alias("norm"), F.lit(None).alias("conf"), F.lit(None).alias("best"), F.array().alias("alts")).cast(RESULT)


def chosen(norm: Column, made: Column, light: str, write: Callable[[Column], Column]) -> Column:
    """The parse of a text by its candidates, which ``write`` writes out."""
    top = F.array_max(F.transform(made, lambda m: m["score"]))
    # the best, of equals the first made, then those that come close to it
    close = let(top, lambda t: F.filter(F.transform(made, lambda m, i: F.struct((-m["score"]).alias("o"), i.alias("i"), m.alias("m"))), lambda x: -x["o"] >= t - C.ALT_GAP))
    apart = lambda a, b: haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]) > C.ALT_METRES
    keep = lambda acc, x: F.when(F.forall(acc, lambda y: apart(x["m"], y)), F.concat(acc, F.array(x["m"]))).otherwise(acc)

    def result(kept: Column) -> Column:
        best = write(F.get(kept, F.lit(0)))
        alts = F.transform(F.slice(kept, 2, 2), write)
        return let(
            best, lambda b: F.struct(F.lit(True).alias("ok"), F.lit(False).alias("empty"), norm.alias("norm"), F.when((F.size(b["notes"]) > 0) | (F.size(kept) > 1), "check").otherwise("ok").alias("conf"), b.alias("best"), alts.alias("alts")).cast(RESULT)
        )

    return let(F.aggregate(F.array_sort(close), _none(light), keep), result)


def parse_plain(text: Column | str) -> Column:
    """``parse.parse`` of a plain text, as a struct of the same type; null for a text that is not plain."""
    text = F.col(text) if isinstance(text, str) else text
    empty = text.isNull() | text.rlike(f"^[{SPACES}]*$")

    def of_norm(norm: Column) -> Column:
        return let(lexemes(norm), lambda lex: let(candidates(norm, lex), lambda made: F.when(F.size(made) == 0, nothing(False, norm)).otherwise(chosen(norm, made, LIGHT, lambda m: written(m, lex)))))

    # without two numbers there is no position
    found = let(normalise(text), lambda norm: F.when(norm.rlike(r"\d\D+\d"), of_norm(norm)).otherwise(nothing(False, norm)))
    return F.when(empty, nothing(True, F.lit(None))).when(plain(text), found)


def parse_strict(text: Column | str) -> Column:
    """``parse_plain`` for sources whose texts are all plain: another text is an error. No Python in the plan."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(parse_plain(text), F.when(~plain(text), F.raise_error(F.lit("a text that is not plain needs parse_position"))).cast(RESULT))


def parse_any(text: Column | str) -> Column:
    """The parse of any text: in columns where it is plain, by ``parse_position`` where it is not."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(parse_plain(text), P.parse_position(F.when(~plain(text), text)))


def parse_positions(df: DataFrame, text: str = "text", parser: Callable[[Column], Column] = parse_strict) -> DataFrame:
    """``df`` with the parse ``p`` of a column, one row a text."""
    return df.withColumn("p", parser(F.col(text)))


def parse_once(df: DataFrame, text: str = "text", parser: Callable[[Column], Column] = parse_any) -> DataFrame:
    """``parse.parse_once``, in columns where a text is plain."""
    return P.parse_once(df, text, parser)


TOKENS = P.TOKENS


def token_rows(text: Column | str) -> Column:
    """``parse.token_rows`` of a plain text; null for another."""
    text = F.col(text) if isinstance(text, str) else text

    def made(lex: Column, toks: Column) -> Column:
        upto = lambda k: F.coalesce(F.length(F.array_join(F.slice(lex, F.lit(1), k), "")), F.lit(0))
        lines = lambda k: F.length(F.regexp_replace(F.array_join(F.slice(lex, F.lit(1), k), ""), r"[^\n]", ""))
        words = lambda i: F.size(F.filter(F.slice(toks, F.lit(1), i + 1), lambda t: t["kind"] == "word"))
        one = lambda t, i: F.struct(t["kind"].alias("kind"), upto(t["at"]).alias("start"), upto(t["end"] + 1).alias("end"), lines(t["at"]).alias("line"), F.coalesce(t["text"], F.lit("")).alias("text"), ((t["kind"] == "num") & t["neg"]).alias("negative"), t["symbol"].alias("symbol"), words(i).alias("run"))
        return F.transform(toks, one).cast(TOKENS)

    return F.when(text.isNotNull() & plain(text), let(lexemes(normalise(text)), lambda lex: let(tokens(lex), lambda toks: made(lex, toks))))
