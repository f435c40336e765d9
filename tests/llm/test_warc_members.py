"""Salvage within gzip members, and archives of other writers."""

import base64
import gzip
import hashlib
import zlib

from waymark.llm import warc


def records(n):
    bodies = [hashlib.sha256(b"%d" % i).hexdigest().encode() * 40 for i in range(n)]
    return [warc.build_record(i, f"http://x/{i}", b, hashlib.sha256(b).hexdigest(), None, False) for i, b in enumerate(bodies)]


def states(data):
    return [h["warc-record-id"].split(":")[-1].strip(">") if s == "ok" else s for s, _, _, h, _ in warc.salvage(data)]


def test_one_member_of_many_records():
    parts = records(6)
    whole = gzip.compress(b"".join(parts))
    assert states(whole) == list("012345")
    hurt = [p if i != 2 else p.replace(b"Content-Length: 2", b"Content-Length: 9") for i, p in enumerate(parts)]
    assert states(gzip.compress(b"".join(hurt))) == [*"01345", "record end"]
    cut = states(whole[: len(whole) * 2 // 3])
    assert cut[:3] == list("012") and cut[-1] == "member cut short"
    crc = whole[:-8] + bytes(4) + whole[-4:]
    assert states(crc)[:6] == list("012345") and states(crc)[6].startswith("member: ")
    bare = [p.replace(b"WARC-Block-Digest: sha256", b"X-Other: sha256") for p in parts]
    damaged = gzip.compress(b"".join(bare))
    assert states(damaged[:-8] + bytes(4) + damaged[-4:])[:6] == ["unverified"] * 6
    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    head = packer.compress(b"".join(parts[:4])) + packer.flush(zlib.Z_FULL_FLUSH)
    broken = head + b"\xff" * 50  # an invalid block after four whole records
    assert states(broken + gzip.compress(parts[4]))[:4] == list("0123") and states(broken + gzip.compress(parts[4]))[-1] == "4"


def test_other_digests(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    sha1 = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()

    def record(kind, block, *more, http=True):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", *more, f"Content-Type: {'application/http' if http else 'text/plain'}", f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    members = [record("warcinfo", b"software: x\r\n\r\ny", http=False), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("response", body), record("response", body, f"WARC-Payload-Digest: sha1:{sha1(b'hello')}"), record("response", body, "WARC-Payload-Digest: blake9:abc"), record("response", body, f"WARC-Payload-Digest: sha1:{sha1(b'other')}")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    assert [r.state for r in warc.read(spark, str(tmp_path)).collect()] == ["ok"] * 5 + ["payload digest"]
