"""WARC archives: writer with revisit records, and a splittable reader over byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.registry import query, table
from colonnade.session import new_path, stage

MAGIC, CHUNK = b"\x1f\x8b\x08", 1 << 16
SPLIT = 8 << 20  # bytes of an archive that one task owns
LEAST_REVISIT = 1000  # bytes of a payload from which copies are revisit records
RECORDS = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary, record_id string, refers_to_id string, damaged boolean"


def _files(path: str):
    """File system and path of a URI on any storage that Arrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit of `refers_to` without one. The payload's SHA-1 and size stand in the
    header of both. Line breaks in a url become percent codes."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
              ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n") + packer.flush()


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds digest and refers_to: of rows with equal payloads of at least LEAST_REVISIT bytes the one with the largest page_id is
    the response (all rows with that id, if it repeats; none revisits anything if no row has an id), the others revisit it.

    Only groups with several rows come back to the pages: a table that Spark broadcasts or, if large, joins and splits by its size."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    groups = keyed.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response"))
    copies = stage(groups.where("n > 1").select("digest", "response"), "copies")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return keyed.join(copies, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, path: str) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) into archives below `path`, one per task, and returns the table of files
    (file, bytes). Each attempt of a task has a file name of its own and only names of finished tasks are in the table, so lost
    or repeated tasks neither lose nor double a record. Null html is an empty payload, null urls have no target field; repeated rows are
    records each; no rows make no files."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size, name = None, 0, f"{path}/{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for page, url, html, digest, refers in zip(b["page_id"], b["url"], b["html"], b["digest"], b["refers_to"]):
                if out is None:
                    files, place = _files(path)
                    files.create_dir(place, recursive=True)
                    out = files.open_output_stream(f"{place}/{name.rpartition('/')[2]}", compression=None)  # members are gzip already
                data = record(None if pd.isna(page) else int(page), url, (html or "").encode(), None if pd.isna(refers) else int(refers), digest)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "bytes": [size]})
    rows = with_revisits(pages.select("page_id", "url", "html"))
    # ids travel as text: pandas has no null among integers
    return stage(rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")}).mapInPandas(run, "file string, bytes long"), "archives")


class Window:
    """Bytes of a file from any position, read in chunks and dropped when passed."""

    def __init__(self, source, start: int):
        self.source, self.start, self.held, self.ended = source, start, b"", False
        source.seek(start)

    def upto(self, end: int) -> None:
        """Holds the bytes before position `end`, if there are so many."""
        while not self.ended and self.start + len(self.held) < end:
            more = self.source.read(max(CHUNK, end - self.start - len(self.held)))
            self.ended = not more
            self.held += more

    def drop(self, at: int) -> None:
        self.held, self.start = self.held[at - self.start:], at

    def find(self, at: int, end: int) -> int:
        """Position of the next gzip magic that starts in [at, end), or -1."""
        while at < end:
            self.drop(at)
            self.upto(min(end, at + CHUNK) + len(MAGIC) - 1)
            found = self.held.find(MAGIC)
            if 0 <= found < end - at:
                return at + found
            if len(self.held) < len(MAGIC):
                return -1
            at += len(self.held) - len(MAGIC) + 1
        return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """Content and end of the gzip member at a position; None if it is no WARC record. The header is decoded
        first, so that a chance magic costs a few bytes; then the whole member with its checksum, and what follows must be another member or the end."""
        self.drop(at)
        decoder, out, used = zlib.decompressobj(31), [], 0
        try:
            while not decoder.eof:
                self.upto(at + used + 1)
                piece = self.held[used:used + CHUNK]
                if not piece:
                    return None
                used += len(piece)
                out.append(decoder.decompress(piece))
                begin = b"".join(out[:8])[:5] if len(out) <= 8 else b"WARC/"
                if not b"WARC/".startswith(begin):
                    return None
        except zlib.error:
            return None
        end = at + used - len(decoder.unused_data)
        self.upto(end + len(MAGIC))
        follows = self.held[end - at:end - at + len(MAGIC)]
        return (b"".join(out), end) if follows in (b"", MAGIC) else None


def _digest(value: str) -> str | None:
    """Hex of a SHA-1 written as sha1:BASE32 or sha1:hex; None for other algorithms and malformed ones."""
    kind, _, text = value.strip().partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return (bytes.fromhex(text) if len(text) == 40 else base64.b32decode(text.upper())).hex()
    except ValueError:
        return None


def _page(name: str) -> str | None:
    """Page number of an id that `record` wrote."""
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return number if name.startswith("<urn:page:") and number.lstrip("-").isdigit() else None


def parse(data: bytes) -> tuple | None:
    """A record's row of RECORDS, or None if it is no response or revisit, or its header cannot be read.

    Records of other writers keep their ids as text and have no page_id; digest and size that a header lacks are those of the payload (null for
    revisits, which have none). A response whose payload is cut short or differs from its SHA-1 is `damaged`."""
    head, split, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, found, v in (line.partition(":") for line in lines[1:]) if found}
    kind, length = fields.get("warc-type", "").lower(), fields.get("content-length", "")
    if not split or not lines[0].startswith("WARC/") or kind not in ("response", "revisit") or not (length.isascii() and length.isdigit()):
        return None
    block = rest[:int(length)]
    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
    written, size = _digest(fields.get("warc-payload-digest", "")), fields.get("x-payload-length", "")
    size = int(size) if size.isascii() and size.isdigit() else None
    if kind == "revisit":
        damaged, own, payload = len(block) < int(length), written, None
    else:
        own = hashlib.sha1(payload).hexdigest()
        damaged = len(block) < int(length) or written not in (None, own) or size not in (None, len(payload))
        size = len(payload)
    names = [fields.get(f, "") for f in ("warc-record-id", "warc-refers-to")]
    return _page(names[0]), kind, _page(names[1]), fields.get("warc-target-uri"), size, own, payload, names[0] or None, names[1] or None, damaged


def records_in(source, start: int, end: int) -> Iterator[tuple]:
    """Rows of the records that start in bytes [start, end) of an open file; the last may reach beyond."""
    window, at = Window(source, start), start
    while (at := window.find(at, end)) >= 0:
        found = window.member(at)
        if found is None:
            at += 1
            continue
        row = parse(found[0])
        at = found[1]
        if row is not None:
            yield row


def read(archives: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """Records of the files of a table (file, bytes): page_id, record_type, refers_to, url, payload_bytes, payload_digest, payload (null for
    revisits), the ids as they are written, and whether the record is damaged. Records of other kinds, and members that are no readable record, are left out. Files are cut into ranges of `split` bytes, so one large archive is read by many tasks. A range
    owns the records that start in it and finds the first by the gzip magic; a task holds one record at a time."""
    ranges = archives.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split))).alias("start"))
    tasks = archives.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1  # one number

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORDS.split(", ")]
        for b in batches:
            for file, start in zip(b["file"], b["start"]):
                files, place = _files(file)
                with files.open_input_file(place) as source:
                    out, size = [], 0
                    for row in records_in(source, int(start), int(start) + split):
                        out.append(row if payloads else (*row[:6], None, *row[7:]))
                        size += len(row[6] or b"") + 100 if payloads else 100
                        if size > 4 << 20:
                            yield pd.DataFrame(out, columns=columns)
                            out, size = [], 0
                    if out:
                        yield pd.DataFrame(out, columns=columns)
    text = RECORDS.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")
    found = ranges.repartition(int(tasks)).mapInPandas(run, text)
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


@query("op3_splittable_warc", """
WITH keyed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
groups AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM keyed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to FROM groups""")
def op3_splittable_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    archives = write(table(spark, folder, "pages"), new_path(spark, "warc"))
    return read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
