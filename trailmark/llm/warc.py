"""WARC archives with a two-level capture index.

Records are written in the order of their capture keys (URL with the host
reversed, then page id), so one block of the index covers one contiguous run
of bytes of one archive. The ``blocks`` table makes a collection:

* archive, block, base (offset of the block in its archive), first and last key,
  ``cdx`` (zlib-compressed, sorted index lines) and ``warc`` (the records, one
  gzip member each; the blocks of an archive concatenated are a .warc.gz file);
* the sparse directory is its lines without the two contents, one per block.

``lookup_many`` answers ranges of keys, any number of them: a range finds its
archives by binary search in the list of archives (one line a write task, on the
driver; a task writes about a gigabyte of html at most, or one key), meets the
directory lines of its archive in a merge by keys, which holds what is open at a key
and no more, and then the blocks, whose index lines are binary-searched for offsets;
records are range-read from the bytes of the block, and nothing else is unpacked.

Records are compressed before they are shuffled into key order by range, so html
moves once and compressed. Deduplication moves ids only: the smallest page id of
each digest that occurs twice is joined back on the digest, a join whose hot
digests Spark can split, and the decisions travel in the same range shuffle. Keys
end in the page id, so a host or URL with a third of all rows is spread over many
ranges.

Defined results: null html is an empty payload; payloads under
``least_bytes`` are never revisits; a null url has an empty key; a null page id
sorts first and is kept as null; of repeated rows of one page id each gets its
record, and they are responses or revisits alike (a row that equals the
response's page id is a response); an empty table gives an empty collection;
extra columns are not read. A damaged record, or one whose payload is not that of its
digest, stops the reading with an error that names what is wrong.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailmark.llm.shared import lean, stage, table
from trailmark.llm.telephony import slices

LEAST_BYTES = 100
BLOCK_RECORDS, BLOCK_BYTES, ARCHIVE_BYTES = 500, 2 << 20, 1 << 30
CAPTURE = {"key": "string", "page_id": "long", "url": "string", "digest": "binary", "payload_bytes": "long", "member": "binary", "refers_to": "long"}
BLOCKS = "archive string, block int, base long, first_key string, last_key string, records int, cdx binary, warc binary"


URL = r"(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)"
BLANK = r"[\x00-\x20\x7f]"


def capture_key(url: str | None, page_id: int | None) -> str:
    """com,example,www)/path?query and the page id, so that hosts of a domain sort together."""
    m = re.match(URL, url or "")
    host, rest = (m[1].lower(), (m[2] or "") + ")" + m[3]) if m else ("", ")" + (url or ""))
    return re.sub(BLANK, "_", ",".join(reversed(host.split("."))) + rest) + f" {0 if page_id is None else page_id + 2**63:020d}"


def key_column() -> Column:
    """``capture_key`` by built-in functions, which order bytes as code points."""
    part = [F.regexp_extract(F.coalesce("url", F.lit("")), URL, i) for i in (1, 2, 3)]
    rest = F.when(F.coalesce("url", F.lit("")).rlike(URL), F.concat(part[1], F.lit(")"), part[2])).otherwise(F.concat(F.lit(")"), F.coalesce("url", F.lit(""))))
    number = F.coalesce(F.col("page_id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)"), F.lit(0)).cast("decimal(20,0)")
    text = F.concat(F.array_join(F.reverse(F.split(F.lower(part[0]), r"\.")), ","), rest)
    return F.concat(F.regexp_replace(text, BLANK, "_"), F.lit(" "), F.lpad(number.cast("string"), 20, "0"))


def clean(value: object) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", str(value))


def record(page_id, url: str | None, payload: bytes, payload_bytes: int, digest: str, refers_to) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names one."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", clean(url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", payload_bytes)]
    if refers_to is None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(body))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n", 4, mtime=0)


def read_record(member: bytes) -> dict:
    """Headers and payload of one record; raises ValueError where it is damaged."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not match")
    page = lambda name: None if fields[name] == "<urn:page:None>" else int(fields[name][10:-1])
    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload": payload, "payload_digest": digest,
        "payload_bytes": len(payload) if payload is not None else int(fields["X-Payload-Length"]), "refers_to": page("WARC-Refers-To") if "WARC-Refers-To" in fields else None,
    }


def revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """key, digest -> refers_to for captures whose payload a smaller page id has."""
    long = pages.where(F.octet_length("html") >= least_bytes).select("page_id", key_column().alias("key"), F.unhex(F.sha2(F.encode("html", "UTF-8"), 256)).alias("digest"))
    long = stage(long, "warc-digests")
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    # Both sides of this join are small rows; Spark splits the partitions of hot digests.
    return long.join(first.select("digest", "refers_to"), "digest").where("page_id > refers_to").select("key", "digest", "refers_to")


def write_archives(pages: DataFrame, *, least_bytes: int = LEAST_BYTES, block_records: int = BLOCK_RECORDS, block_bytes: int = BLOCK_BYTES, partitions: int | None = None) -> DataFrame:
    """The ``blocks`` table of page_id, url, html, written to the shared folder and read back."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    n = partitions
    if n is None:  # archives of a bounded size, whatever the number of partitions
        size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
        n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // ARCHIVE_BYTES))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3):
            digests, sizes, members = [], [], []
            for page, url, html in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                payload = (html or "").encode()
                digests.append(hashlib.sha256(payload).digest())
                sizes.append(len(payload))
                members.append(record(page, url, payload, len(payload), digests[-1].hex(), None))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(members, pa.binary()), pa.nulls(b.num_rows, pa.int64())], [*CAPTURE])

    captures = pages.select(key_column().alias("key"), "page_id", "url", "html").mapInArrow(lean(compress), ", ".join(map(" ".join, CAPTURE.items())))
    # The decisions travel in the same range shuffle as the records and sort before them.
    known = revisits(pages, least_bytes)
    known = known.select(*[F.col(c) if c in known.columns else F.lit(None).cast(kind).alias(c) for c, kind in CAPTURE.items()])
    rows = captures.unionByName(known).repartitionByRange(n, "key").sortWithinPartitions("key", F.col("refers_to").asc_nulls_last())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, block, base, lines, members = uuid.uuid4().hex, 0, 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal block, base, lines, members
            text = "\n".join(f"{k} {json.dumps(v, separators=(',', ':'))}" for k, v in lines)
            warc = b"".join(members)
            out = {"archive": pa.array([archive]), "block": pa.array([block], pa.int32()), "base": pa.array([base], pa.int64()), "first_key": pa.array([lines[0][0]]), "last_key": pa.array([lines[-1][0]])}
            out |= {"records": pa.array([len(lines)], pa.int32()), "cdx": pa.array([zlib.compress(text.encode())], pa.binary()), "warc": pa.array([warc], pa.binary())}
            block, base, lines, members = block + 1, base + len(warc), [], []
            return pa.RecordBatch.from_arrays([*out.values()], [*out])

        size, at, decided = 0, None, {}
        for b in batches:
            for i in range(b.num_rows):
                key, page, url, digest, payload_bytes, member, refers = (b.column(c)[i].as_py() for c in range(7))
                if key != at:
                    at, decided = key, {}
                if refers is not None:
                    decided[digest] = refers
                    continue
                refers = decided.get(digest)
                if refers is not None:
                    member = record(page, url, b"", payload_bytes, digest.hex(), refers)
                if lines and (len(lines) >= block_records or size + len(member) > block_bytes):
                    yield close()
                    size = 0
                lines.append((key, [size, len(member), "response" if refers is None else "revisit", digest.hex()[:16]]))
                members.append(member)
                size += len(member)
        if lines:
            yield close()

    return stage(rows.mapInArrow(lean(build), BLOCKS), "warc")


def directory(blocks: DataFrame) -> DataFrame:
    """The sparse upper level: one line per block."""
    return blocks.select("first_key", "last_key", "archive", "block", "base")


def cdx_lines(cdx: bytes) -> tuple[list[str], list[list]]:
    """Keys and [offset, length, type, digest start] of an index block."""
    parts = [x.rsplit(" ", 1) for x in zlib.decompress(cdx).decode().split("\n")]
    return [k for k, _ in parts], [json.loads(v) for _, v in parts]


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary"


def lookup_many(blocks: DataFrame, wanted: DataFrame, *, keep_html: bool = True) -> DataFrame:
    """The records whose capture keys lie in ranges (low, high) of ``wanted``, high excluded; once for each such range."""
    lines = blocks.groupBy("archive").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).collect()  # one line a write task
    archives = sorted((r.first, r.last, r.archive) for r in lines)
    starts = [x[0] for x in archives]

    def route(batches):
        for b in batches:
            out = []
            for low, high in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for _, last, archive in archives[max(0, bisect.bisect_right(starts, low) - 1) : bisect.bisect_left(starts, high)]:
                    if last >= low:
                        out.append((archive, low, high))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], ["archive", "low", "high"])

    def meet(batches):
        """Directory lines and ranges of an archive in the order of keys: what is open at a key is all that is held."""
        archive, blocks_open, wanted_open = None, [], []
        for b in batches:
            out = []
            for at, key, end, block in zip(*(b.column(i).to_pylist() for i in range(4))):
                if at != archive:
                    archive, blocks_open, wanted_open = at, [], []
                blocks_open = [x for x in blocks_open if x[1] >= key]
                wanted_open = [x for x in wanted_open if x[1] > key]
                if block is None:
                    out += [(at, n, key, end) for n, _ in blocks_open]
                    wanted_open.append((key, end))
                else:
                    out += [(at, block, low, high) for low, high in wanted_open]
                    blocks_open.append((block, end))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], ["archive", "block", "low", "high"])

    def read(batches):
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        for b in slices(batches, 1, 1 << 20):
            rows = []
            for cdx, warc, ranges in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                body, (keys, values) = memoryview(warc.as_buffer()), cdx_lines(cdx.as_py())
                for r in ranges:
                    for at, n, *_ in values[bisect.bisect_left(keys, r["low"]) : bisect.bisect_left(keys, r["high"])]:
                        rows.append(read_record(bytes(body[at : at + n])))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] if keep_html or c != "payload" else None for r in rows], k) for c, k in kinds.items()], [*kinds][:-1] + ["html"])

    routed = wanted.select("low", "high").mapInArrow(lean(route), "archive string, low string, high string")
    lines = directory(blocks).select("archive", F.col("first_key").alias("key"), F.col("last_key").alias("end"), "block")
    both = lines.unionAll(routed.select("archive", F.col("low").alias("key"), F.col("high").alias("end"), F.lit(None).cast("int").alias("block")))
    met = both.repartition("archive").sortWithinPartitions("archive", "key", F.col("block").asc_nulls_last()).mapInArrow(lean(meet), "archive string, block int, low string, high string")
    met = met.groupBy("archive", "block").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    return blocks.join(met, ["archive", "block"]).select("cdx", "warc", "ranges").mapInArrow(lean(read), RECORDS)


def one_key(key: Column) -> list[Column]:
    """The range that holds one capture key only."""
    return [key.alias("low"), F.concat(key, F.lit("\x00")).alias("high")]


def lookup(blocks: DataFrame, url: str) -> DataFrame:
    """All captures of a URL."""
    prefix = capture_key(url, None).rsplit(" ", 1)[0]
    return lookup_many(blocks, blocks.sparkSession.createDataFrame([(prefix + " ", prefix + "!")], "low string, high string"))


def export_archives(blocks: DataFrame, folder: str) -> None:
    """Uncompressed WARC files in ``folder``, one a partition, records in the order of their keys.

    Spark's text writer ends each row with the newline that a record ends with.
    """

    def unpack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip.decompress(x.as_py())[:-1] for x in b.column(0)], pa.binary())], ["value"])

    ordered = blocks.repartition("archive").sortWithinPartitions("archive", "block").select("warc")
    ordered.mapInArrow(lean(unpack), "value binary").select(F.col("value").cast("string")).write.text(folder)


def op2_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    wanted = pages.select(*one_key(key_column())).distinct()
    return lookup_many(write_archives(pages), wanted, keep_html=False).drop("html", "url")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
