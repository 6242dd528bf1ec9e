import base64
import gzip
import hashlib
import io
import random

from pyspark.sql import types as T

from colonnade.llm import warc
from colonnade.session import new_path

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("digest", T.StringType()), T.StructField("file", T.StringType())])


def test_ranges_own_every_record_once():
    r = random.Random(1)
    bodies = [("<p>é" + "x" * r.randint(0, 3000) + str(r.random())).encode() for _ in range(60)]
    data = b"".join(warc.record(i, f"http://a/{i}", b, None, hashlib.sha1(b).hexdigest()) for i, b in enumerate(bodies))
    for split in (1, 13, 500, 4096, len(data) + 1):
        got = [row for at in range(0, len(data), split) for row in warc.records_in(io.BytesIO(data), at, at + split)]
        assert [(int(row[0]), row[6]) for row in got] == list(enumerate(bodies))


def test_chance_magic_is_no_record():
    body = warc.MAGIC + b"\x00WARC/1.1" + bytes(random.Random(2).randbytes(5000)) + warc.MAGIC
    inner = warc.record(9, None, b"inner", None, hashlib.sha1(b"inner").hexdigest())
    one = warc.record(1, "http://a\r\nb", body, None, hashlib.sha1(body).hexdigest())
    data = one + warc.record(2, None, b"", None, hashlib.sha1(b"").hexdigest()) + warc.MAGIC[:2]
    assert [row[0] for row in warc.records_in(io.BytesIO(one + inner), 0, 10**6)] == ["1", "9"]
    assert [row[0] for row in warc.records_in(io.BytesIO(data), 0, 10**6)][:1] == ["1"]


def test_operator(spark):
    long, copy = "<p>ü" * 700, "y" * 1000
    rows = [(1, "http://a/", long), (2, None, long), (3, "http://b/\n", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
            (8, "u", copy), (8, "u", copy), (9, "u", "y" * 999), (10, "u", "y" * 999), (None, "u", copy), (None, None, "z" * 2000), (None, None, "z" * 2000)]
    pages = spark.createDataFrame([(*r, "d", "f") for r in rows], PAGES)
    archives = warc.write(pages.repartition(3), new_path(spark, "warc"))
    assert archives.count() <= 3
    for split in (warc.SPLIT, 200):
        got = warc.read(archives, split=split).collect()
        assert len(got) == len(rows)
        by = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0, r["payload_digest"]) for r in got)
        want = []
        for page, _, html in rows:
            data = (html or "").encode()
            same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
            revisit = len(data) >= 1000 and bool(same) and page != max(same)
            want.append((page or 0, len(data), "revisit" if revisit else "response", max(same) if revisit else 0, hashlib.sha1(data).hexdigest()))
        assert by == sorted(want)
        texts = {r["page_id"]: r["payload"] for r in got if r["record_type"] == "response"}
        assert bytes(texts[3]).decode() == long and bytes(texts[6]) == b"" and next(r["url"] for r in got if r["page_id"] == 3) == "http://b/%0A"
    empty = warc.write(pages.limit(0), new_path(spark, "warc"))
    assert warc.read(empty).collect() == []


def foreign(version, fields, block, ends=b"\r\n\r\n"):
    head = f"{version}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + ends)


def test_archives_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    body = b"<html>hello</html>"
    sha = hashlib.sha1(body)
    plain = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://x/")]
    length = ("Content-Length", len(http + body))
    members = [
        foreign("WARC/1.0", [("WARC-Type", "warcinfo"), ("Content-Length", 4)], b"a: b"),
        foreign("WARC/1.0", [*plain, length], http + body),
        foreign("WARC/1.0", [("Warc-Type", "Response"), ("WARC-Record-ID", "<urn:uuid:2>"), ("warc-payload-digest", "sha1:" + sha.hexdigest()), length], http + body),
        foreign("WARC/1.1", [*plain, ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(b"other").digest()).decode()), length], http + body),
        foreign("WARC/1.1", [*plain, ("WARC-Payload-Digest", "md5:xyz"), ("Content-Length", 10**6)], http + body, b""),
        foreign("WARC/1.0", [("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:3>"), ("WARC-Refers-To", "<urn:uuid:1>"), ("Content-Length", len(http))], http),
        foreign("WARC/1.0", [("WARC-Type", "response"), ("Content-Length", "many")], http + body),
        foreign("WARC/1.0", [("WARC-Type", "request"), ("Content-Length", 3)], b"GET"),
        warc.record(7, "u", body, None, sha.hexdigest())]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(members))
    archives = spark.createDataFrame([(str(tmp_path / "x.warc.gz"), sum(map(len, members)))], "file string, bytes long")
    for split in (warc.SPLIT, 100):
        got = {(r["record_id"], r["page_id"], r["record_type"], r["refers_to_id"], r["payload_bytes"], r["payload_digest"], r["damaged"]) for r in warc.read(archives, split).collect()}
        digest = sha.hexdigest()
        assert got == {("<urn:uuid:1>", None, "response", None, 18, digest, False), ("<urn:uuid:2>", None, "response", None, 18, digest, False),
                       ("<urn:uuid:1>", None, "response", None, 18, digest, True), ("<urn:uuid:3>", None, "revisit", "<urn:uuid:1>", None, None, False),
                       ("<urn:page:7>", 7, "response", None, 18, digest, False)}
        assert warc.read(archives, split).where("damaged").count() == 2
