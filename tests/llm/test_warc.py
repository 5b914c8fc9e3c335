import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from trailmark.llm import warc

BIG = "<p>" + "x" * 120 + "</p>"
ROWS = [
    (5, "http://a.example.org/x", BIG), (3, "http://b.example.org/y#frag", BIG), (9, "HTTP://User@B.Example.org:80/y?q=1", BIG), (4, "http://a.example.org/x", "short"), (6, None, "short"),
    (7, "not a url with\nline", None), (8, "", "é" * 50), (10, "http://a.example.org/x", "é" * 50), (11, "http://a.example.org/x", "z" * 200000), (9, "HTTP://User@B.Example.org:80/y?q=1", BIG), (None, "http://c/", BIG),
]


def make(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", b"x") for r in rows], "page_id long, url string, html string, archive string, warc binary")


def test_collection_reads_back_whole(spark):
    blocks = warc.write_archives(make(spark), block_records=2, partitions=3)
    rows = warc.lookup_many(blocks, make(spark).select(*warc.one_key(warc.key_column())).distinct()).collect()
    got = {(r.page_id, r.url): r for r in rows}
    assert len(rows) == len(ROWS)
    for page, url, html in ROWS:
        r = got[page, url if url is None else warc.clean(url)]
        payload = (html or "").encode()
        first = min((p for p, _, h in ROWS if p is not None and (h or "").encode() == payload), default=None)
        revisit = len(payload) >= 100 and page is not None and page > first
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
        assert r.html == (None if revisit else payload)
    keys = [x for b in blocks.orderBy("first_key").collect() for x in warc.cdx_lines(b.cdx)[0]]
    assert keys == sorted(keys) and sorted(keys) == sorted(warc.capture_key(u, p) for p, u, _ in ROWS)


def test_blocks_concatenate_to_one_gzip_file(spark):
    blocks = warc.write_archives(make(spark), block_records=3, partitions=1).orderBy("base").collect()
    assert [b.base for b in blocks] == [sum(len(x.warc) for x in blocks[:i]) for i in range(len(blocks))]
    assert gzip.decompress(b"".join(b.warc for b in blocks)).count(b"WARC/1.1\r\n") == len(ROWS)


def test_lookup_searches_both_levels(spark):
    blocks = warc.write_archives(make(spark), block_records=1, partitions=4)
    pages = lambda url: sorted(r.page_id for r in warc.lookup(blocks, url).collect())
    assert pages("http://a.example.org/x") == [4, 5, 10, 11] and pages("http://b.example.org:80/y?q=1") == [9, 9]
    assert pages("http://a.example.org/") == [] and pages("http://zzz.example/") == []
    wanted = spark.createDataFrame([("", "~"), ("a", "a"), ("org,", "org,~")], "low string, high string")
    every = sorted(warc.capture_key(u, p) for p, u, _ in ROWS)
    want = sum("" <= k < "~" for k in every) + sum("org," <= k < "org,~" for k in every)
    assert warc.lookup_many(blocks, wanted).count() == want


def test_what_the_index_does_not_list_is_not_found(spark, monkeypatch):
    """The query reads through directory, index block and byte range: it ends with their errors."""
    whole = warc.write_archives

    def damaged(pages, **options):
        return whole(pages, **options).withColumn("cdx", F.lit(warc.zlib.compress(b'nothing [0,1,"response",""]')))

    monkeypatch.setattr(warc, "write_archives", damaged)
    assert warc.op2_warc_capture_index(spark, "/root/testdata/sf0.001").collect() == []


def test_exported_files_are_warc(spark, tmp_path):
    blocks = warc.write_archives(make(spark), block_records=2, partitions=2)
    warc.export_archives(blocks, f"file://{tmp_path}/out")
    found = []
    for file in (tmp_path / "out").glob("part-*"):
        data = file.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            found.append((fields["WARC-Record-ID"], rest[:size].partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None))
            data = rest[size + 4 :]
    assert sorted(x for x, _ in found) == sorted(f"<urn:page:{p}>" for p, _, _ in ROWS)
    assert ("<urn:page:11>", b"z" * 200000) in found and ("<urn:page:8>", ("é" * 50).encode()) in found


def test_key_column_equals_key_function(spark):
    rows = make(spark).select("page_id", "url", warc.key_column().alias("k")).collect()
    assert all(r.k == warc.capture_key(r.url, r.page_id) for r in rows)


def test_empty_table(spark):
    blocks = warc.write_archives(make(spark).where(F.lit(False)))
    assert blocks.collect() == [] and warc.lookup(blocks, "http://a/").collect() == []


def test_ranges_of_any_width_meet_their_blocks_without_groups_of_an_archive(spark):
    import random

    rng = random.Random(9)
    rows = [(i, f"http://h{rng.randint(0, 5)}.org/{rng.randint(0, 30)}", f"<p>{i}</p>" * rng.randint(1, 30)) for i in range(400)]
    blocks = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), block_records=7, partitions=3)
    keys = sorted(warc.capture_key(u, i) for i, u, _ in rows)
    ranges = {tuple(sorted(rng.sample(keys, 2))) for _ in range(40)} | {(k, k + "\x00") for k in rng.sample(keys, 60)} | {("", "~"), ("zz", "~"), (keys[0], keys[0])}
    found = warc.lookup_many(blocks, spark.createDataFrame(sorted(ranges), "low string, high string"))
    want = sorted(i for low, high in ranges for i, u, _ in rows if low <= warc.capture_key(u, i) < high)
    assert sorted(r.page_id for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "FlatMapGroups" not in plan


def test_damaged_records_are_named(spark):
    data = warc.record(1, "http://a.org/", b"x" * 200, 200, "0" * 64, None)
    with pytest.raises(ValueError, match="payload digest"):
        warc.read_record(data)
