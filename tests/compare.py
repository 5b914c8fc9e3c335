"""DuckDB beside Spark: the same query on the same Parquet files, rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TRAILMARK_TESTDATA", "/root/testdata/sf0.001")


def oracle_rows(sql: str, data: str = DATA) -> tuple[list[str], list[tuple]]:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = db.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def same_rows(frame, sql: str, data: str = DATA) -> None:
    names, rows = oracle_rows(sql, data)
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=key)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=key)
    assert len(got) == len(want)
    different = [(g, w) for g, w in zip(got, want) if g != w]
    assert not different, different[:3]
