"""ARC to WARC.

``read_arc`` parses legacy ARC files: the version block says whether URL
records carry the 5 fields of version 1 or the 10 of version 2; each header
line ends with the declared length of what follows. ``to_warc`` synthesises of
a record the equivalent WARC record: an identifier made from the record's
address, the 14-digit date as ISO time, the type and the SHA-1 digests.
``convert_pages`` sends pages through both and writes WARC files, one gzip
member a record, in which equal payloads from ``MIN_REVISIT`` bytes on are
kept once: the record with the largest page id is the response, the others
are revisits that refer to it. ``read_warc_files`` reads them back.

A null html is an empty payload; a null url is written as ``-``; white space
in urls is percent-encoded. A null page id takes no part in revisits (type
response). Repeated rows with the group's largest id are all responses. An
empty table writes no file. Columns other than the three named are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.llm.common import AtomicFile, fs_of, read_table, utf8, work_dir

MIN_REVISIT = 1000
#: Parts into which a group of equal payloads is dealt for the join.
SALTS = 32
#: The ARC formats' field names.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_SPACE = uuid.UUID("9c1f0e0a-5d5b-5c38-8a55-0d7a3f1b2c44")


class ArcError(ValueError):
    """The bytes aren't an ARC file of version 1 or 2."""


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    content: bytes
    offset: int
    status: int | None = None


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 vellumetry\n{' '.join(ARC_FIELDS[version])}\n".encode()
    extra = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, content: bytes, *, ip: str = "0.0.0.0", content_type: str = "text/html", status: int = 200, offset: int = 0, name: str = "-") -> bytes:
    extra = "" if version == 1 else f" {status} - - {offset} {name}"
    return f"{url} {ip} {date} {content_type}{extra} {len(content)}\n".encode() + content + b"\n"


def read_arc(f: BinaryIO) -> Iterator[ArcRecord]:
    """The URL records of an ARC file (the version block is read, not given)."""
    at, version = 0, 0
    while line := f.readline():
        start, at = at, at + len(line)
        if line in (b"\n", b"\r\n"):
            continue
        fields = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        try:
            length = int(fields[-1])
        except ValueError:
            raise ArcError(f"no declared length at byte {start}") from None
        content = f.read(length)
        if len(content) != length:
            raise ArcError(f"the record at byte {start} ends before its declared length")
        at += length
        if not version:
            lead = content.split(b"\n", 1)[0].split(b" ")
            if not fields[0].startswith("filedesc://") or lead[0] not in (b"1", b"2"):
                raise ArcError("no version block of version 1 or 2")
            version = int(lead[0])
            continue
        if len(fields) != len(ARC_FIELDS[version]):
            raise ArcError(f"{len(fields)} fields at byte {start}; version {version} has {len(ARC_FIELDS[version])}")
        status = int(fields[4]) if version == 2 and fields[4].isdigit() else None
        yield ArcRecord(fields[0], fields[1], fields[2], fields[3], content, start, status)


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*of) -> str:
    return f"<urn:uuid:{uuid.uuid5(ID_SPACE, chr(0).join(map(str, of)))}>"


def iso_time(date: str) -> str:
    """ARC's 14 digits, or fewer, as WARC's time."""
    full = date + "00000101000000"[len(date) :] if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000"
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload. Content without a status line is all payload."""
    if content.startswith(b"HTTP/"):
        head, blank, body = content.partition(b"\r\n\r\n")
        if blank:
            return head + blank, body
    return b"", content


def to_warc(record: ArcRecord, own_id: str, refers_to: tuple[str, dict] | None = None, extra: dict | None = None) -> bytes:
    """The equivalent WARC record; a revisit if ``refers_to`` gives another's id and fields."""
    head, payload = split_http(record.content)
    fields = {"WARC-Type": "revisit" if refers_to else "response" if head else "resource", "WARC-Record-ID": own_id, "WARC-Date": iso_time(record.date), "WARC-Target-URI": record.url, "WARC-IP-Address": record.ip}
    block = record.content
    if refers_to:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to[0]} | refers_to[1]
        block = head
    fields["WARC-Payload-Digest"] = sha1_base32(payload)
    fields["WARC-Block-Digest"] = sha1_base32(block)
    fields["Content-Type"] = "application/http; msgtype=response" if head else record.content_type
    fields |= extra or {}
    fields["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed WARC stream."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := f.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(":")
            fields[k] = v.strip()
        yield fields, f.read(int(fields["Content-Length"]))


def _page_url(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


def _convert(rows: Iterable[tuple], version: int, name: str) -> Iterator[bytes]:
    """WARC records of (page_id, url, payload, response's page id or None), by way of an ARC file of the version."""
    rows, date = list(rows), "20000101000000"
    arc = io.BytesIO()
    arc.write(arc_version_block(name, version, date))
    for page, url, payload, _ in rows:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        arc.write(arc_record(version, _page_url(url), date, head + payload, offset=arc.tell(), name=name))
    arc.seek(0)
    for (page, _, _, first), record in zip(rows, read_arc(arc), strict=True):
        to = (record_id("page", first), {"X-Refers-To-Page-Id": first}) if first is not None else None
        yield to_warc(record, record_id("page", page), to, {"X-Page-Id": "" if page is None else page})


def convert_pages(df: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> list[int]:
    """Writes ``part-N.warc.gz`` and returns the Ns."""
    rows = df.select(F.col(page_id).cast("long").alias("p"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(html), F.lit("")).alias("h"))
    keyed = rows.withColumns({"d": F.unhex(F.sha1(F.col("h").cast("binary"))), "salt": F.pmod(F.xxhash64("p", "u"), F.lit(SALTS))})
    groups = keyed.where((F.octet_length("h") >= MIN_REVISIT) & F.col("p").isNotNull()).groupBy("d").agg(F.max("p").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select(F.col("d").alias("gd"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("gs"))
    joined = keyed.join(groups, (F.col("d") == F.col("gd")) & (F.col("salt") == F.col("gs")), "left")
    first = F.when(F.col("p") < F.col("first"), F.col("first"))

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        begun = next(batches, None)
        if begun is None:
            return
        n = 0
        with AtomicFile(folder, f"part-{part:06d}.warc.gz") as out:
            for batch in (b for first_then in ([begun], batches) for b in first_then):
                for lo in range(0, batch.num_rows, 256):
                    b = batch.slice(lo, 256)
                    own = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(utf8, b.column(2).to_pylist()), b.column(3).to_pylist())
                    for record in _convert(own, 1 + (lo // 256) % 2, f"part-{part:06d}.arc"):
                        z = zlib.compressobj(4, wbits=31)
                        out.write(z.compress(record) + z.flush())
                        n += 1
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [n]})

    return sorted(r.part for r in joined.select("p", "u", "h", first.alias("first")).mapInArrow(write, "part long, n long").collect())


def read_warc_files(spark: SparkSession, folder: str, parts: list[int]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record.

    A response's payload is checked against its digest; a revisit's length is
    that of its HTTP header.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches):
        for part in (p for b in batches for p in b.column(0).to_pylist()):
            fs, base = fs_of(folder)
            out: dict[str, list] = {x.split()[0]: [] for x in schema.split(", ")}
            with fs.open_input_file(f"{base}/part-{part:06d}.warc.gz") as raw, gzip.GzipFile(fileobj=raw) as f:
                for fields, block in read_warc(f):
                    head, payload = split_http(block)
                    digest = fields["WARC-Payload-Digest"]
                    kind = fields["WARC-Type"]
                    if kind != "revisit" and digest != sha1_base32(payload):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                    length = int(re.search(rb"Content-Length: (\d+)", head)[1]) if kind == "revisit" else len(payload)
                    page, to = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
                    for c, v in zip(out.values(), (int(page) if page else None, length, base64.b32decode(digest[5:]).hex(), kind, int(to) if to else None)):
                        c.append(v)
                    if len(out["page_id"]) == 4096:
                        yield _batch(out, schema)
                        out = {k: [] for k in out}
            yield _batch(out, schema)

    if not parts:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(p,) for p in parts], "part long").repartition(len(parts)).mapInArrow(read, schema)


def _batch(cols: dict, schema: str) -> pa.RecordBatch:
    types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in schema.split(", ")]
    return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(cols.items(), types)})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    return read_warc_files(spark, folder, convert_pages(read_table(spark, sf_dir, "pages"), folder))


OP10_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, CASE WHEN n >= {MIN_REVISIT} AND page_id IS NOT NULL THEN max(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM g
"""
