"""Photo files: capture dates from EXIF, and the records of a batch."""

from __future__ import annotations

import struct
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailmark.functions.text import shot_key

HEAD_BYTES = 131_072
ORIGINAL, MODIFIED, EXIF_POINTER, ORIENTATION = 0x9003, 0x0132, 0x8769, 0x0112


def parse_date(text: str | None) -> int | None:
    """Milliseconds of ``YYYY:MM:DD HH:MM:SS`` read as UTC; days past a month's end roll over."""
    import re

    m = re.match(r"([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})", text or "")
    if not m:
        return None
    y, mo, d, h, mi, s = map(int, m.groups())
    if y == 0 or not 1 <= mo <= 12 or not 1 <= d <= 31:
        return None
    t = datetime(y, mo, 1, tzinfo=timezone.utc) + timedelta(days=d - 1, hours=h, minutes=mi, seconds=s)
    return int(t.timestamp()) * 1000


def exif_segment(data: bytes) -> bytes | None:
    """The TIFF part of a JPEG's first Exif segment."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 2
        elif marker in (0xDA, 0xD9):
            return None
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xE1 and data[at + 4 : at + 8] == b"Exif":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    return None


def exif_tags(data: bytes | None) -> dict[int, str | int]:
    """The date texts and the orientation that a JPEG's Exif segment holds."""
    tiff = exif_segment(data or b"")
    if tiff is None or len(tiff) < 8:
        return {}
    order = "<" if tiff[:2] == b"II" else ">"
    u16 = lambda at: struct.unpack_from(order + "H", tiff, at)[0]
    u32 = lambda at: struct.unpack_from(order + "I", tiff, at)[0]
    if u16(2) != 42:
        return {}
    found: dict[int, str | int] = {}
    todo, done = [u32(4)], set()
    while todo:
        base = todo.pop(0)
        if base in done or base + 2 > len(tiff):
            continue
        done.add(base)
        for i in range(u16(base)):
            at = base + 2 + 12 * i
            if at + 12 > len(tiff):
                break
            tag, kind, count = u16(at), u16(at + 2), u32(at + 4)
            if tag == EXIF_POINTER and kind == 4 and len(done) == 1:
                todo.append(u32(at + 8))
            elif tag == ORIENTATION and kind == 3 and len(done) == 1 and 1 <= u16(at + 8) <= 8:
                found[tag] = u16(at + 8)
            elif tag in (ORIGINAL, MODIFIED) and kind == 2 and count >= 19:
                start = u32(at + 8)
                if start + 19 <= len(tiff):
                    text = tiff[start : start + 19].decode("latin-1")
                    found[tag] = text if tag == ORIGINAL else found.get(tag, text)
    return found


def exif_date(data: bytes | None) -> int | None:
    """When a JPEG was taken, else changed, in milliseconds; None where it does not say."""
    found = exif_tags(data)
    return parse_date(found.get(ORIGINAL)) or parse_date(found.get(MODIFIED))


def exif_orientation(content: Column | str) -> Column:
    """1 to 8, how a photo is to be turned to stand upright; 1 where it does not say."""

    def turns(heads: pd.Series) -> pd.Series:
        return heads.map(lambda x: exif_tags(bytes(x)).get(ORIENTATION, 1) if x is not None else 1).astype("int32")

    turns.__annotations__ = {"heads": pd.Series, "return": pd.Series}
    c = F.col(content) if isinstance(content, str) else content
    return F.pandas_udf(turns, "int")(F.substring(c, 1, HEAD_BYTES))


def exif_millis(content: Column | str) -> Column:
    """``exif_date`` of the head of a binary column; only the head goes to Python."""

    def dates(heads: pd.Series) -> pd.Series:
        return heads.map(lambda x: exif_date(bytes(x)) if x is not None else None).astype("Int64")

    dates.__annotations__ = {"heads": pd.Series, "return": pd.Series}
    c = F.col(content) if isinstance(content, str) else content
    return F.pandas_udf(dates, "long")(F.substring(c, 1, HEAD_BYTES))


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """One record a file: key, name, t (ms), src, st; dated by EXIF, else by the file. Only heads of files are read."""
    from trailmark.sources.heads import read_heads

    return new_shots(read_heads(spark, path))


def new_shots(files: DataFrame) -> DataFrame:
    """Records of (name, size, modified, content) rows, waiting to be read; ``by_date`` puts them in order."""
    rows = files.withColumn("exif", exif_millis("content"))
    t = F.coalesce("exif", F.nullif("modified", F.lit(0)), F.unix_millis(F.current_timestamp()))
    src = F.when(F.col("exif").isNotNull(), "exif").when(F.coalesce("modified", F.lit(0)) != 0, "file").otherwise("now")
    return rows.select(shot_key("name", "size", "modified").alias("key"), "name", t.alias("t"), t.alias("t0"), src.alias("src"), F.lit("wait").alias("st"))


def by_date(shots: DataFrame) -> DataFrame:
    """Records in the order of their dates, of equal dates by key."""
    return shots.orderBy("t", "key")
