"""ARC archives (versions 1 and 2) and their conversion to WARC.

An ARC record is a header line and as many bytes as the line's last field says. The first record of a file describes
it and names the version; version 2 lines carry five more fields. Each record becomes a WARC record with what ARC lacks:
an identifier made of the record's own facts (the same on every run), a W3C date, a type (warcinfo for the description,
response for HTTP answers, resource for the rest, revisit for payloads stored elsewhere) and digests of block and
payload. Records are gzip members of their own, so one can be read by its offset; plain files, in which one record follows
the other, are read as well.

Of HTTP answers with equal payloads of at least `REVISIT_BYTES` bytes the one with the largest key is the response; the
others refer to it and keep only their HTTP head. Payloads never travel between tasks: only digests are joined, and
each task converts whole ARC files.

A null payload is empty, a null URL is `unknown:`; blanks and non-ASCII characters in URLs are percent-encoded. A null
key is kept as null, counts as the smallest and is never referred to by key. Repeated keys each give a record. A page whose
URL begins like a description's is a page; only the record at a file's start describes it. Other columns are left out. A task
holds one record at a time, so a very long payload must fit in its memory. A header line that cannot be read, or a record shorter than it says, raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import SharedFile, open_shared, small_batches, stage

REVISIT_BYTES = 1000
ROLL_BYTES, READ_BYTES, LEVEL = 32 << 20, 1 << 20, 1
DATE = "20240101000000"
# Fixed values of the two formats.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PRINTABLE = "".join(chr(i) for i in range(33, 127))
KEY = "X-Record-Key"
GZIP = b"\x1f\x8b"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(file) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, content) of each gzip member."""
    at, rest, size = 0, b"", file.size()
    read = 0
    while read < size or rest:
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not rest:
                rest = file.read_at(min(READ_BYTES, size - read), read)
                read += len(rest)
                if not rest:
                    raise ValueError("the last record is cut off")
            parts.append(unpacker.decompress(rest))
            used += len(rest) - len(unpacker.unused_data)
            rest = unpacker.unused_data
        yield at, used, b"".join(parts)
        at += used


def plain_records(file) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, content) of each record of a file that is not compressed."""
    at, end = 0, file.size()
    while at < end:
        line = b""
        while b"\n" not in line and at + len(line) < end:
            line += file.read_at(min(4096, end - at - len(line)), at + len(line))
        head = line.partition(b"\n")[0]
        if not head:  # the line end behind a body
            at += 1
            continue
        length = head.rsplit(b" ", 1)[-1]
        if not length.isdigit():
            raise ValueError(f"no ARC header line: {head[:200]!r}")
        size = len(head) + 1 + int(length)
        if at + size > end:
            raise ValueError("the last record is cut off")
        yield at, size, file.read_at(size, at)
        at += size


def records_of(file) -> Iterator[tuple[int, int, bytes]]:
    """(offset, stored size, content) of each record, compressed or not."""
    return members(file) if file.read_at(min(2, file.size()), 0) == GZIP else plain_records(file)


def stored(data: bytes) -> bytes:
    """The content of a record as it lies in its file."""
    return zlib.decompress(data, 31) if data.startswith(GZIP) else data


def arc_record(version: int, url: str, date: str, kind: str, body: bytes, status: int, name: str, offset: int) -> bytes:
    values = {
        "URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": str(status),
        "Checksum": hashlib.md5(body).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name,
        "Archive-length": str(len(body)),
    }
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def description(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 faultline\n{' '.join(FIELDS[version])}\n".encode()
    values = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        values += ["200", "-", "-", "0", name]
    return " ".join([*values, str(len(body))]).encode() + b"\n" + body + b"\n"


def parse_record(data: bytes, version: int | None) -> tuple[dict[str, str], bytes]:
    """(header fields, body) of an ARC record; the version is unknown for the first record, whose line tells it."""
    line, _, rest = data.partition(b"\n")
    values = line.decode("latin-1").split(" ")
    fields = FIELDS.get(version) or next((f for f in FIELDS.values() if len(f) == len(values)), None)
    if fields is None or len(fields) != len(values) or not values[-1].isdigit() or not re.fullmatch(r"\d{8,14}", values[2]):
        raise ValueError(f"no ARC header line: {line[:200]!r}")
    length = int(values[-1])
    if len(rest) < length:
        raise ValueError(f"{values[0]} has {len(rest)} of {length} bytes")
    return dict(zip(fields, values, strict=True)), rest[:length]


def version_of(body: bytes) -> int:
    """The version that a file's first record names."""
    found = body.split(b" ", 1)[0]
    if found not in (b"1", b"2"):
        raise ValueError(f"unknown ARC version {found[:20]!r}")
    return int(found)


def http_parts(body: bytes) -> tuple[bytes, bytes] | None:
    """(head with its blank line, payload) of an HTTP answer."""
    if not body.startswith(b"HTTP/"):
        return None
    head, mark, payload = body.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark else None


def head_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("latin-1").strip() if found else None


def record_id(url: str, date: str, digest: str, own: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {own}')}>"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: str) -> str:
    d = date.ljust(8, "0").ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if sha1(block) != headers["WARC-Block-Digest"]:
        raise ValueError(f"{headers['WARC-Record-ID']}: the block is not the one written")
    return headers, block


# Spark jobs -----------------------------------------------------------------------------------------------------------


def _rows(batches, schema, each):
    """Run `each` on every row of the batches and give its rows in bounded batches."""
    out = []
    for batch in batches:
        for row in batch.to_pylist():
            for found in each(row):
                out.append(found)
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


ARCHIVES = pa.schema([("archive", pa.string()), ("records", pa.int64())])


def write_arc(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write page_id, url, html rows as ARC files, versions 1 and 2 in turn; gives archive, records."""
    small_batches(pages.sparkSession)

    def work(batches):
        out, count, turn = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    version = 1 + turn % 2
                    out, count, turn = SharedFile(folder, f"pages-v{version}", ".arc.gz"), 0, turn + 1
                    out.write(member(description(version, out.name, date)))
                payload = (row["html"] or "").encode()
                key = f"{KEY}: {row['page_id']}\r\n" if row["page_id"] is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(payload)}\r\n\r\n"
                url = quote(row["url"], safe=PRINTABLE) if row["url"] else "unknown:"
                out.write(member(arc_record(version, url, date, "text/html", head.encode() + payload, 200, out.name, out.position)))
                count += 1
                if out.position >= ROLL_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"archive": out.name, "records": count}], schema=ARCHIVES)
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"archive": out.name, "records": count}], schema=ARCHIVES)

    return stage(pages.select("page_id", "url", "html").mapInArrow(work, "archive string, records long"), "arc")


RECORDS = pa.schema([
    ("archive", pa.string()), ("version", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("key", pa.int64()),
    ("payload_bytes", pa.int64()), ("digest", pa.string()), ("record_id", pa.string()),
])
RECORDS_SQL = "archive string, version int, offset long, size long, key long, payload_bytes long, digest string, record_id string"


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def scan_arc(archives: DataFrame, folder: str) -> DataFrame:
    """One row per ARC record with its place, key and payload digest; the payload stays in the file."""

    def each(row):
        with open_shared(folder, row["archive"]) as file:
            version = None
            for offset, size, data in records_of(file):
                fields, body = parse_record(data, version)
                if version is None:
                    version = version_of(body)
                parts = http_parts(body)
                payload = parts[1] if parts else body
                key = head_value(parts[0], KEY) if parts else None
                digest = sha1(payload)
                own = key if key is not None else f"{row['archive']} {offset}"
                yield {
                    "archive": row["archive"], "version": version, "offset": offset, "size": size,
                    "key": int(key) if key is not None else None, "payload_bytes": len(payload) if parts else None, "digest": digest,
                    "record_id": record_id(fields["URL"], fields["Archive-date"], digest, f"{own} {offset}"),
                }

    spread = archives.select("archive").repartition(_parts(archives.sparkSession), "archive")
    return stage(spread.mapInArrow(lambda b: _rows(b, RECORDS, each), RECORDS_SQL), "arc-records")


def decide(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Records with the key and record id of the response they repeat, if any. Equal payloads are counted before the
    shuffle; only digests that occur more than once are joined, and a hot digest's rows are split by the join."""
    large = records.where(F.col("payload_bytes") >= least)
    best = F.max(F.struct("key", "record_id")).alias("best")
    again = stage(large.groupBy("digest").agg(best, F.count("*").alias("n")).where("n > 1").select(
        F.col("digest").alias("same"), F.col("best.key").alias("to_key"), F.col("best.record_id").alias("to_id")), "arc-repeated")
    joined = records.join(again, (F.col("digest") == F.col("same")) & (F.col("payload_bytes") >= least), "left")
    own = F.col("record_id") == F.col("to_id")
    return joined.withColumn("to_key", F.when(~own, F.col("to_key"))).withColumn("to_id", F.when(~own, F.col("to_id"))).drop("same")


def convert(decided: DataFrame, folder: str) -> DataFrame:
    """Write a WARC file for each ARC file; gives archive, records."""

    def work(batches):
        out, archive, file, count = None, None, None, 0

        def done():
            out.close()
            file.close()
            return pa.RecordBatch.from_pylist([{"archive": out.name, "records": count}], schema=ARCHIVES)

        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != archive:
                    if out is not None:
                        yield done()
                    archive, count = row["archive"], 0
                    file = open_shared(folder, archive)
                    out = SharedFile(folder, archive.removesuffix(".gz").removesuffix(".arc"), ".warc.gz")
                data = stored(file.read_at(row["size"], row["offset"]))
                fields, body = parse_record(data, row["version"])
                out.write(member(to_warc(fields, body, row)))
                count += 1
        if out is not None:
            yield done()

    columns = ["archive", "version", "offset", "size", "digest", "record_id", "to_key", "to_id"]
    ordered = decided.select(*columns).repartition(_parts(decided.sparkSession), "archive").sortWithinPartitions("archive", "offset")
    return stage(ordered.mapInArrow(work, "archive string, records long"), "warc")


def to_warc(fields: dict[str, str], body: bytes, row: dict) -> bytes:
    """The WARC record of an ARC record."""
    headers = {
        "WARC-Type": "resource", "WARC-Record-ID": row["record_id"], "WARC-Date": warc_date(fields["Archive-date"]),
        "WARC-Target-URI": fields["URL"], "WARC-IP-Address": fields["IP-address"], "Content-Type": fields["Content-type"],
        "WARC-Payload-Digest": row["digest"],
    }
    parts = http_parts(body)
    if row.get("offset") == 0:
        headers |= {"WARC-Type": "warcinfo", "Content-Type": "text/plain"}
        del headers["WARC-Target-URI"]
    elif parts:
        headers |= {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response"}
        if row["to_id"]:
            headers |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": row["to_id"]}
            if row["to_key"] is not None:
                headers[f"{KEY}-Referred"] = str(row["to_key"])
            body = parts[0]
    return warc_record(headers | {"WARC-Block-Digest": sha1(body)}, body)


READ = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()),
])


def read_warc(archives: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every HTTP answer in the files."""

    def each(row):
        with open_shared(folder, row["archive"]) as file:
            for _, _, data in members(file):
                headers, block = parse_warc(data)
                kind, parts = headers["WARC-Type"], http_parts(block)
                if kind not in ("response", "revisit") or not parts:
                    continue
                if kind == "response" and sha1(parts[1]) != headers["WARC-Payload-Digest"]:
                    raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not the one written")
                key, to = head_value(parts[0], KEY), headers.get(f"{KEY}-Referred")
                yield {
                    "page_id": int(key) if key is not None else None,
                    "payload_bytes": len(parts[1]) if kind == "response" else int(head_value(parts[0], "Content-Length")),
                    "payload_digest": base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
                    "record_type": kind, "refers_to": int(to) if to is not None else None,
                }

    spread = archives.select("archive").repartition(_parts(archives.sparkSession), "archive")
    sql = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spread.mapInArrow(lambda b: _rows(b, READ, each), sql)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC files say."""
    records = scan_arc(write_arc(pages, folder), folder)
    return read_warc(convert(decide(records), folder), folder)
