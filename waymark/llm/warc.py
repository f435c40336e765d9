"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Writing.  Payloads of at least ``least`` bytes that are equal share one
``response`` record (smallest id) which the others ``revisit``.  Each record is
a gzip member of its own.  Spark's text writer puts the members one after
another; the line separator is an empty gzip member, so every file is a valid
multi-member gzip file in any store that Spark can write.

Reading.  Files come through Spark's ``binaryFile`` reader.  A member or record
that fails a check (inflation, version line, header, length, digest) is left
out; reading goes on at the next valid gzip member or version line, and the
bytes in between are logged as a gap.  Within a member, and within what a broken
one did inflate, reading goes on at the next version line; the gap is then that
member's place in the file.  Records of a damaged member that have no digest to
check come as ``unverified``.  Digests of unknown algorithms are not checked.
Files are bounded by ``per_file`` bytes of records, so one file fits one task.

Null html is an empty payload.  Null urls become an empty target.  A null id
stays null.  Rows that repeat the smallest id of a group are responses, too.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import durable, join_spread

_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_PREFIX = "urn:waymark:page:"
_MAGIC, _VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: Archives take the digest of such a body with or without its chunk marks, so it is not checked.
_CHUNKED = re.compile(rb"(?im)^Transfer-Encoding:[^\r\n]*chunked")
_HTTP_LENGTH = re.compile(rb"(?im)^Content-Length:[ ]*([0-9]+)\r?$")


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head (and so the payload's length) without the payload."""
    name = lambda i: f"<{_PREFIX}{'' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = re.sub(r"[\r\n]", "", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def digest_fits(named: str, data: bytes) -> bool | None:
    """Whether a digest header (``algorithm:value`` in hex, base 32 or base 64) fits; null if it can't be checked."""
    algorithm, _, value = named.strip().partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha384", "sha512") or not value:
        return None
    raw, value = hashlib.new(algorithm, data).digest(), value.rstrip("=")
    return value.lower() == raw.hex() or value.upper() == base64.b32encode(raw).decode().rstrip("=") or value == base64.b64encode(raw).decode().rstrip("=")


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``; ValueError names the check that failed."""
    if not _VERSION.match(data, at):
        raise ValueError("version line")
    body = data.find(b"\r\n\r\n", at)
    if body < 0:
        raise ValueError("header end")
    headers = {}
    for line in data[at:body].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line")
        headers[key.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise ValueError("content length")
    start, end = body + 4, body + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record end")
    block = data[start:end]
    if digest_fits(headers.get("warc-block-digest", ""), block) is False:
        raise ValueError("block digest")
    return headers, block, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the gzip member at ``at`` inflates to, its end (null: broken) and why it is broken."""
    worker, out, place, step, last = zlib.decompressobj(31), [], at, 65536, len(data)
    while not worker.eof:
        if place >= last:
            return b"".join(out), None, "member cut short"
        part = data[place : min(place + step, last)]
        try:
            out.append(worker.decompress(part))
        except zlib.error as error:
            if step == 1:
                return b"".join(out), None, f"member: {error}"
            # what the failing part inflates to before the error comes only byte by byte
            worker, out, step, last = zlib.decompressobj(31), [], 1, place + len(part)
            if place > at:
                out.append(worker.decompress(data[at:place]))
            continue
        place += len(part)
    return b"".join(out), place - len(worker.unused_data), ""


def _records(data: bytes) -> tuple[list[tuple[dict[str, str], bytes]], str]:
    """The records of inflated bytes that pass, and why the first of the others failed."""
    got, why, place = [], "", 0
    while place < len(data):
        try:
            headers, block, place = parse_record(data, place)
            got.append((headers, block))
        except ValueError as error:
            why = why or str(error)
            following = _VERSION.search(data, place + 1)
            place = following.start() if following else len(data)
    return got, why


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """``(state, offset, length, headers, block)``: state ``ok``, ``unverified``, or the reason why these bytes are quarantined."""
    at, bad, why = 0, None, ""
    while at < len(data):
        got, end, failed, torn = [], None, "", False
        if data.startswith(_MAGIC, at):
            inner, end, failed = _inflate(data, at)
            torn = failed.startswith("member:")  # what precedes a mere cut is whole
            got, inner_failed = _records(inner)
            failed = failed or inner_failed
        else:
            try:
                headers, block, end = parse_record(data, at)
                got.append((headers, block))
            except ValueError as error:
                failed = str(error)
        following = end
        if following is None:
            found = _START.search(data, at + 1)
            following = found.start() if found else len(data)
        if bad is not None and (got or not failed):
            yield why, bad, at - bad, {}, b""
            bad = None
        for headers, block in got:
            proven = not torn or digest_fits(headers.get("warc-block-digest", ""), block)
            yield "ok" if proven else "unverified", at, following - at, headers, block
        if failed and bad is None:
            bad, why = at, failed
        at = following
    if bad is not None:
        yield why, bad, len(data) - bad, {}, b""


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """``page_id, url, html, payload_digest, record_type, refers_to`` by payload digest."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("*", F.sha2(F.col("html").cast("binary"), 256).alias("payload_digest")).withColumn("__digest", F.when(F.octet_length("html") >= least, F.col("payload_digest")))
    firsts = rows.where("__digest is not null").groupBy("__digest").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1 and __first is not null")
    joined = join_spread(rows, durable(firsts), "__digest", "__n", pages.count())
    again = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select("page_id", "url", "html", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("__first")).alias("refers_to"))


def write(planned: DataFrame, path: str, *, per_file: int = 256 << 20, level: int = 6) -> None:
    """Write planned records as files of gzip members.

    A task's members are counted into parts of ``per_file`` bytes before
    compression; each part is a file (a longer record is a file of its own).
    """

    def run(batches):
        number, filled = 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                out, parts = [], []
                for page_id, url, html, digest, kind, refers in zip(*(part[n] for n in ("page_id", "url", "html", "payload_digest", "record_type", "refers_to"))):
                    record = build_record(page_id, url, html.encode(), digest, refers, kind == "revisit")
                    if filled and filled + len(record) > per_file:
                        number, filled = number + 1, 0
                    filled += len(record)
                    out.append(gzip.compress(record, level, mtime=0))
                    parts.append(number)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(parts, pa.int32())], ["member", "part"])

    # numbers rise within a task, so rows come sorted by part and each part is written as one file after another
    members = planned.mapInArrow(run, "member binary, part int")
    writer = members.select("part", F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1"))
    writer.partitionBy("part").text(path)


RECORD = "file string, state string, offset bigint, length bigint, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row for each record (state ``ok``) and each quarantined gap of the archives below ``path``."""

    def page(value: str | None) -> int | None:
        number = (value or "").strip("<>").removeprefix(_PREFIX)
        return int(number) if re.fullmatch(r"-?[0-9]+", number) else None

    def rows_of(file: str, data: bytes):
        for state, offset, length, headers, block in salvage(data):
            kind = headers.get("warc-type")
            cut = block.find(b"\r\n\r\n") if headers.get("content-type", "").lower().startswith("application/http") else -1
            head, payload = (block[:cut], block[cut + 4 :]) if cut >= 0 else (b"", block)
            digest, size = headers.get("warc-payload-digest", "").partition(":")[2], len(payload)
            if state == "ok" and kind == "revisit":
                size = int(m[1]) if (m := _HTTP_LENGTH.search(head)) else None
            elif state == "ok" and digest_fits(headers.get("warc-payload-digest", ""), payload) is False and not _CHUNKED.search(head):
                state = "payload digest"
            yield file, state, offset, length, page(headers.get("warc-record-id")), headers.get("warc-target-uri"), kind, size if state == "ok" else None, digest or None, page(headers.get("warc-refers-to")), payload if payloads and kind != "revisit" else None

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [f.split(" ")[0] for f in RECORD.split(", ")]
        full = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                held = []
                for row in rows_of(file.as_py(), data.as_py()):
                    held.append(row)
                    if len(held) == 256:
                        yield full(held)
                        held = []
                if held:
                    yield full(held)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")
    return files.mapInArrow(run, RECORD)
