"""Requests to services as state machines: relief of a path, memo of answers, points that stay.

Each has a stream, whose state is a few values a key, and a table form that folds or
looks ahead in the order of (t, seq). A stream that is fed in order gives the table's
rows, also across a restart from its checkpoint.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from trailmark import constants as C
from trailmark.streaming.state import _in_order


def _ms(t) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


# Relief of a path: unknown, asked, known or failed. ``sig`` is the path's signature (``relief_key``).
RELIEF = "owner long, seq long, sig string, how string"


def relief_requests(stream: DataFrame) -> DataFrame:
    """What each event of a path's relief does: owner, seq, sig, how.

    Events: owner, seq, t, kind, sig, online, req, ok. A ``show`` of another signature than the one at hand asks for its
    relief (``ask``), or leaves it unknown where the device is offline (``unknown``); of the same, nothing happens
    (``kept``). An ``answer`` to the request that is open makes it ``known``, or ``failed``, after which the next show
    asks again; an answer to any other request, which was superseded, is ``stale``. ``req`` is the seq of the show that asked.
    """

    def run(key, batches, state):
        sig, req = state.get if state.exists else ("", None)
        out = []
        for r in _in_order(batches):
            if r["kind"] == "show":
                how = "kept" if r["sig"] == sig else "ask" if r["online"] else "unknown"
                if how != "kept":
                    sig, req = r["sig"], int(r["seq"]) if how == "ask" else None
            elif req is None or int(r["req"]) != req:
                how = "stale"
            else:
                how, req = "known" if r["ok"] else "failed", None
                sig = sig if how == "known" else ""
            out.append((key[0], int(r["seq"]), r["sig"], how))
        state.update((sig, req))
        yield pd.DataFrame(out, columns=["owner", "seq", "sig", "how"])

    return stream.groupBy("owner").applyInPandasWithState(run, RELIEF, "sig string, req long", "append", GroupStateTimeout.NoTimeout)


def relief_requests_table(events: DataFrame) -> DataFrame:
    """``relief_requests`` over a table: one fold an owner, whose state is the signature at hand and the open request."""
    item = F.struct("t", "seq", "kind", "sig", "online", "req", "ok")
    kind = "struct<sig:string,req:bigint,how:string>"

    def step(states, r):
        last = F.element_at(states, -1)
        show, same, mine = r["kind"] == "show", r["sig"] == last["sig"], F.coalesce(r["req"] == last["req"], F.lit(False))
        how = F.when(show, F.when(same, "kept").when(r["online"], "ask").otherwise("unknown")).otherwise(F.when(~mine, "stale").when(r["ok"], "known").otherwise("failed"))
        sig = F.when(show & ~same, r["sig"]).when(~show & mine & ~r["ok"], "").otherwise(last["sig"])
        req = F.when(show & ~same, F.when(r["online"], r["seq"])).when(~show & mine, F.lit(None)).otherwise(last["req"])
        return F.concat(states, F.array(F.struct(sig.alias("sig"), req.alias("req"), how.alias("how")).cast(kind)))

    start = F.array(F.struct(F.lit("").alias("sig"), F.lit(None).alias("req"), F.lit("").alias("how")).cast(kind))
    rows = events.groupBy("owner").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    steps = F.slice(F.aggregate("xs", start, step), F.lit(2), F.size("xs"))
    return rows.select("owner", F.explode(F.arrays_zip(F.col("xs").alias("x"), steps.alias("s"))).alias("z")).select("owner", "z.x.seq", "z.x.sig", "z.s.how")


def memo_stream(requests: DataFrame, ttl_s: float = 30.0) -> DataFrame:
    """Which requests reach a service (``state.memo`` as a stream): kind, key, seq, fails.

    requests: kind, key, seq, t, fails. A success stays for good. With a watermark on ``t`` a failure's state goes when it
    may be tried again; without one it stays, to the same effect.
    """

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, failed = state.get if state.exists else (None, True)
        out = []
        for r in _in_order(batches):
            ms = _ms(r["t"])
            if last is None or (failed and ms - last >= ttl_s * 1000):
                last, failed = ms, bool(r["fails"])
                out.append((*key, int(r["seq"]), failed))
        state.update((last, failed))
        if failed and state.getCurrentWatermarkMs() > 0:
            state.setTimeoutTimestamp(max(last + int(ttl_s * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["kind", "key", "seq", "fails"])

    timeout = GroupStateTimeout.EventTimeTimeout if _has_watermark(requests) else GroupStateTimeout.NoTimeout
    return requests.groupBy("kind", "key").applyInPandasWithState(run, "kind string, key string, seq long, fails boolean", "ms long, fails boolean", "append", timeout)


def _has_watermark(df: DataFrame) -> bool:
    return "EventTimeWatermark" in df._jdf.queryExecution().analyzed().toString()


def recorded_stream(events: DataFrame, seconds: float = C.HISTORY_DWELL_S) -> DataFrame:
    """Points that a history records: owner, seq, ms (when). Events: owner, seq, t (with a watermark), kind.

    A ``point`` is recorded when it has been the current one for ``seconds``, by an event-time timer, or at once by a
    ``flush``; another point or a ``cancel`` before that drops it.
    """
    wait = int(seconds * 1000)

    def run(key, batches, state):
        seq, due = state.get if state.exists else (None, None)
        out = []
        if not state.hasTimedOut:
            for r in _in_order(batches):
                ms = _ms(r["t"])
                if seq is not None and ms >= due:
                    out.append((key[0], seq, due))
                elif seq is not None and r["kind"] == "flush":
                    out.append((key[0], seq, ms))
                seq, due = (int(r["seq"]), ms + wait) if r["kind"] == "point" else (None, None)
        now = state.getCurrentWatermarkMs()
        if seq is not None and (state.hasTimedOut or due <= now):
            out.append((key[0], seq, due))
            seq = None
        if seq is None:
            if state.exists:
                state.remove()
        else:
            state.update((seq, due))
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame(out, columns=["owner", "seq", "ms"])

    return events.groupBy("owner").applyInPandasWithState(run, "owner long, seq long, ms long", "seq long, due long", "append", GroupStateTimeout.EventTimeTimeout)


def recorded(events: DataFrame, seconds: float = C.HISTORY_DWELL_S) -> DataFrame:
    """``recorded_stream`` over a table: a look at the next event; the last point stays and is recorded."""
    w = Window.partitionBy("owner").orderBy("t", "seq")
    ms, wait = F.unix_millis("t"), int(seconds * 1000)
    rows = events.select("owner", "seq", "kind", ms.alias("ms"), F.lead("kind").over(w).alias("next"), F.lead(ms).over(w).alias("next_ms")).where("kind = 'point'")
    stays = F.col("next_ms").isNull() | (F.col("next_ms") - F.col("ms") >= wait)
    return rows.where(stays | (F.col("next") == "flush")).select("owner", "seq", F.when(stays, F.col("ms") + wait).otherwise(F.col("next_ms")).alias("ms"))


def history_of(recordings: DataFrame, kept: int = C.HISTORY_KEPT) -> DataFrame:
    """owner, place, k, src, ms: the last ``kept`` different positions of each owner, the latest first.

    recordings: owner, ms, seq, k (position text), src. A position recorded again moves to the front.
    """
    last = recordings.groupBy("owner", "k").agg(F.max_by(F.struct("ms", "seq", F.substring("src", 1, C.HISTORY_CHARS).alias("src")), F.struct("ms", "seq")).alias("x")).select("owner", "k", "x.*")
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("ms"), F.desc("seq"))).alias("place")
    return last.select("owner", place, "k", "src", "ms").where(F.col("place") <= kept)
