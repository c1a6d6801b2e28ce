"""WARC archives as a PySpark Python data source, and archives with revisit records.

Writing makes one gzip member a record, with the member's length in its header (the "sl" extra
field), and notes in the manifest where a new piece of a file may begin. Reading plans one
partition for each piece (for foreign archives: each file), takes filters on the header columns,
inflates a record's headers first, and seeks past a record that the filters drop or whose payload
isn't wanted (option ``payload`` = false). Foreign members without a length are inflated in
small steps and thrown away; plain .warc files are read by Content-Length.

``archive`` writes a record for each page: of the pages with equal payloads of at least
``LEAST`` bytes the one with the smallest id is the response, the others revisit it. A null
payload is empty; a null id is written as "null", sorts last and comes back null; a null url
has no header. Rows that share an id and a payload are all responses. Empty tables give empty
archives; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from ranklode.llm import store
from ranklode.session import cut, shared_dir, ship

LEAST = 100
PIECE_BYTES = 16 << 20
STEP = 64 << 10
LEVEL = 3
#: Revisit lists of at most so many pages are broadcast (some 30 MB); beyond, Spark shuffles.
BROADCAST_REVISITS = 200_000
SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_length long, payload binary"
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_ARROW = pa.schema([*((k, pa.string()) for k in HEADERS), ("payload_length", pa.int64()), ("payload", pa.binary())])


def member(data: bytes) -> bytes:
    """A gzip member that says its own length."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    length = row["payload_length"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (row["payload"] or b"" if row["warc_type"] == "response" else b"")
    names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
    head = ["WARC/1.1", *(f"{names[k]}: {re.sub('[\r\n]', ' ', row[k])}" for k in names if row[k] is not None)]
    if row["warc_type"] == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class _Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        out, name, at, cuts = None, "", 0, [0]
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, out = store.create(self.path, ".warc.gz")
                data = member(record(row))
                if at - cuts[-1] >= PIECE_BYTES:
                    cuts.append(at)
                out.write(data)
                at += len(data)
        if out is None:
            return _Written([])
        out.close()
        return _Written([{"name": name, "size": at, "cuts": cuts}])

    def commit(self, messages):
        store.commit(self.path, [f for m in messages if m for f in m.files])

    def abort(self, messages):
        store.remove(self.path, [f["name"] for m in messages if m for f in m.files])


class _Piece(InputPartition):
    def __init__(self, name, start, end):
        self.name, self.start, self.end = name, start, end


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.want = str(options.get("payload", "true")).lower() != "false"
        self.tests = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", {f.value}))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", set(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", f.value))
            else:
                yield f

    def partitions(self):
        out = []
        for f in store.listing(self.path, (".warc", ".warc.gz")):
            cuts = f.get("cuts", [0])
            out += [_Piece(f["name"], a, b) for a, b in zip(cuts, [*cuts[1:], f["size"]], strict=True)]
        return out or [_Piece(None, 0, 0)]

    def passes(self, row: dict) -> bool:
        return all(row[c] is not None and (row[c] in v if how == "in" else row[c].startswith(v)) for c, how, v in self.tests)

    def read(self, partition):
        if partition.name is None:
            return
        rows, size = [], 0
        with store.open_file(self.path, partition.name) as f:
            for row in self.records(f, partition):
                rows.append(row)
                size += len(row["payload"] or b"")
                if size >= 4 << 20 or len(rows) >= 1024:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def records(self, f, partition):
        at = partition.start
        while at < partition.end:
            f.seek(at)
            first = f.read(24)
            if first[:2] == b"\x1f\x8b":
                length = struct.unpack("<I", first[16:20])[0] if len(first) == 24 and first[3] == 4 and first[10:14] == b"\x0c\0sl" else 0
                f.seek(at)
                source = _Member(f, at, length)
            else:
                f.seek(at)
                source = _Plain(f, at)
            head = source.until(b"\r\n\r\n")
            if not head.strip():
                at = source.end(0)
                continue
            lines = head.decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, s, v in (x.partition(":") for x in lines[1:]) if s}
            row = {k: fields.get(v) for k, v in HEADERS.items()}
            left = int(fields.get("content-length", 0))
            if self.passes(row):
                http, http_size = b"", 0
                if fields.get("content-type", "").startswith("application/http") and left:
                    http = source.until(b"\r\n\r\n", left)
                    http_size = len(http)
                said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                row["payload_length"] = int(said[1]) if said else left - http_size
                whole = self.want and row["warc_type"] != "revisit"
                row["payload"] = source.take(left - http_size) if whole else None
                left = left - http_size - len(row["payload"] or b"")
                yield row
            at = source.end(left + 4)


class _Member:
    """A gzip member, inflated only as far as asked."""

    def __init__(self, f, start, length):
        self.f, self.start, self.length = f, start, length
        self.z, self.have, self.fed = zlib.decompressobj(31), b"", 0

    def more(self, limit=STEP) -> bool:
        data = self.z.unconsumed_tail
        if not data and not self.z.eof:
            size = min(STEP, self.length - self.fed) if self.length else STEP
            data = self.f.read(size) if size > 0 else b""
            self.fed += len(data)
        if self.z.eof or not data:
            return False
        self.have += self.z.decompress(data, limit)
        return True

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        at = self.have.find(mark)
        while at < 0 and (most is None or len(self.have) < most) and self.more(4096):
            at = self.have.find(mark)
        at = at + len(mark) if at >= 0 else 0 if most is not None else len(self.have)
        out, self.have = self.have[:at], self.have[at:]
        return out

    def take(self, n: int) -> bytes:
        parts, got = [self.have], len(self.have)
        self.have = b""
        while got < n and self.more(max(STEP, n - got)):
            parts.append(self.have)
            got += len(self.have)
            self.have = b""
        data = b"".join(parts)
        self.have = data[n:]
        return data[:n]

    def end(self, _left: int) -> int:
        if self.length:
            return self.start + self.length
        while self.more():
            self.have = b""
        return self.start + self.fed - len(self.z.unused_data)


class _Plain:
    """An uncompressed record."""

    def __init__(self, f, start):
        self.f, self.at, self.have = f, start, b""

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        while self.have.find(mark) < 0 and (most is None or len(self.have) < most) and (data := self.f.read(STEP)):
            self.have += data
        at = self.have.find(mark)
        return self.take(at + len(mark) if at >= 0 else 0 if most is not None else len(self.have))

    def take(self, n: int) -> bytes:
        if len(self.have) < n:
            self.have += self.f.read(n - len(self.have))
        out, self.have = self.have[:n], self.have[n:]
        self.at += len(out)
        return out

    def end(self, left: int) -> int:
        return self.at + left


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def write(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    records.select(*names).write.format("warc").mode("append").option("path", path).save()


def archive(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as response and revisit records."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    digests = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(body, 256).alias("d"), F.octet_length(body).alias("n")).filter(F.col("n") >= LEAST)
    # nulls last among equal payloads
    first = digests.groupBy(F.col("d").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 and _first is not null").select("_digest", "_first")
    first = cut(first, "revisits")
    if first.count() <= BROADCAST_REVISITS:
        first = F.broadcast(first)
    page = F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit("null"))
    full = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("body")).withColumn("_d", F.sha2("body", 256)).withColumn("_len", F.octet_length("body").cast("long"))
    full = full.join(first, (F.col("_d") == F.col("_digest")) & (F.col("_len") >= LEAST), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").cast("long").eqNullSafe(F.col("_first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    rows = full.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"), name(page).alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.concat(F.lit("sha256:"), F.col("_d")).alias("payload_digest"), F.when(again, name(F.col("_first").cast("string"))).alias("refers_to"),
        F.col("_len").alias("payload_length"), F.when(~again, F.col("body")).alias("payload"),
    )
    write(rows, path)


def summary(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of read records; length
    and digest of a response are taken from its payload, those of a revisit from its headers."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return records.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages in the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    archive(pages, path)
    return summary(read(spark, path))


#: DuckDB SQL of ``round_trip``'s result over pages.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
