"""WARC archives written and read as a chunked record table.

A payload is a run of chunks, each a row (record, chunk number, bytes) and each a WARC record of its own: the first a
`response`, the others `continuation` segments of it. Every chunk carries the digest of its bytes and the digest of the
payload so far, carried on from chunk to chunk both when written and when read back; the last segment's header has the
whole payload's. Chunks leave in batches of about BATCH bytes, so beyond the one copy of a payload that Spark's own cell
is, a task holds a batch of chunks and no second copy of a record. Spark's text writer and reader move the archives, so
they may lie in any store that Spark reaches; gzip files, one member each, aren't split, so a file's lines arrive in
order and the records' lengths, not the lines, say where a record ends.

Records with equal payloads of `LEAST` bytes or more are written once, by the page with the largest id; the others
become `revisit` records that refer to it. Smaller payloads, empty and null ones included, are all written in full.
Rows repeated with the same id and payload count as one page and are all written in full. A null id is written as
`null`. Line breaks in addresses are percent-encoded.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import shared_folder

CHUNK = 64 << 10
BATCH = 4 << 20
LEAST = 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NAME = "urn:factloom:page:"

CHUNKS = (
    "page_id long, record_type string, chunk_no int, chunk binary, chunk_sha1 string, sha1_so_far string,"
    " bytes_so_far long, last boolean, declared_sha1 string, declared_bytes long, refers_to long"
)


def decided(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a page with a larger id has as well."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    marked = pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes")).filter(F.col("bytes") >= LEAST)
    first = marked.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    first = first.filter(F.col("refers_to") > F.col("least"))
    return marked.join(first, "digest").filter(F.col("page_id") < F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()


def _cut(data: memoryview, size: int):
    """Chunks of about `size` bytes that end between code points."""
    start = 0
    while True:
        stop = min(start + size, len(data))
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        yield data[start:stop]
        start = stop
        if start >= len(data):
            return


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


WRITTEN = (
    "page_id long, url string, refers_to long, chunk_no int, chunk binary, payload_sha1 string, bytes_so_far long, last boolean"
)


def _chunked(size: int):
    """Batches of pages in, batches of chunk rows out, of about BATCH bytes each."""

    def run(batches):
        names = [c.split()[0] for c in WRITTEN.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
        rows, held = [], 0

        def taken():
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(k) for k in ("page_id", "url", "html", "refers_to"))):
                page, url, refers = page.as_py(), url.as_py(), refers.as_py()
                data = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                sha, total = hashlib.sha1(), 0
                for k, chunk in enumerate(_cut(data, size)):
                    sha.update(chunk)
                    total += len(chunk)
                    if refers is None:
                        rows.append((page, url, None, k, bytes(chunk), sha.hexdigest(), total, total == len(data)))
                        held += len(chunk) + 200
                    if held >= BATCH:
                        yield taken()
                        rows, held = [], 0
                if refers is not None:
                    rows.append((page, url, refers, 0, b"", sha.hexdigest(), total, True))
                    held += 200
        if rows:
            yield taken()

    return run


def chunks(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of pages (page_id, url, html, refers_to), to be written: a row for each chunk of each payload.

    payload_sha1 is the digest of the payload up to the chunk's end. Payloads of revisits have one row without bytes.
    """
    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(_chunked(size), WRITTEN)


def _record(date: str):
    """A row of text for each chunk: the WARC record but for its last line feed, which the text writer adds."""

    def run(batches):
        for batch in batches:
            rows = []
            for page, url, refers, k, chunk, sha1, total, last in zip(*batch.to_pydict().values()):
                name = f"<{NAME}{'null' if page is None else page}>"
                url = None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
                digest = [("WARC-Payload-Digest", f"sha1:{sha1}" if last else None)]
                common = [("WARC-Target-URI", url), ("WARC-Date", date), *digest]
                if refers is not None:
                    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Refers-To", f"<{NAME}{refers}>")]
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    rows.append(_head([*fields, ("X-Payload-Length", total), ("Content-Length", 0)]) + b"\r\n\r")
                    continue
                block = (HTTP if k == 0 else b"") + chunk
                fields = [("WARC-Type", "continuation" if k else "response"), ("WARC-Record-ID", name if not k else f"{name[:-1]}:{k + 1}>"), *common]
                if k or not last:
                    fields += [("WARC-Segment-Number", k + 1), ("WARC-Segment-Origin-ID", name if k else None)]
                    fields += [("WARC-Segment-Total-Length", len(HTTP) + total if last else None)]
                fields += [("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}")]
                fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
                rows.append(_head(fields) + block + b"\r\n\r")
            yield pa.record_batch([pa.array(rows, pa.binary()).cast(pa.string())], names=["value"])

    return run


def write(pages: DataFrame, folder: str, chunk: int = CHUNK, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of pages (page_id, url, html) as gzip files in a folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    refers = decided(rows).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    on = (F.col("page_id") == F.col("p")) & (F.sha1(F.coalesce("html", F.lit(""))) == F.col("d"))
    marked = rows.join(refers, on, "left").drop("p", "d")
    table, record = _chunked(chunk), _record(date)
    # chunk rows become records where they are made: passed on by Spark they would be gathered in batches by number, not size
    lines = marked.select("page_id", "url", "html", "refers_to").mapInArrow(lambda batches: record(table(batches)), "value string")
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(folder)


class _Reader:
    """Lines of archives in, chunk rows out; what is held is the record of one chunk."""

    def __init__(self, payload: bool):
        self.payload, self.rows = payload, []
        self.state, self.fields, self.block, self.left = "start", {}, [], 0
        self.sha, self.total, self.number = None, 0, 0

    def line(self, line: bytes) -> None:
        if self.state == "start":
            if line.startswith(b"WARC/"):
                self.state, self.fields = "head", {}
        elif self.state == "head":
            if line == b"\r\n":
                self.state, self.block, self.left = "block", [], int(self.fields["content-length"])
                if not self.left:
                    self.record()
            else:
                k, _, v = line.decode().partition(":")
                self.fields[k.lower()] = v.strip()
        else:
            self.block.append(line[: self.left])
            self.left -= min(self.left, len(line))
            if not self.left:
                self.record()

    def record(self) -> None:
        f, block = self.fields, b"".join(self.block)
        self.state, self.block = "start", []
        page = lambda x: None if x is None or x.strip("<>").split(":")[3] == "null" else int(x.strip("<>").split(":")[3])
        kind = f["warc-type"]
        if kind != "continuation":
            self.sha, self.total, self.number = hashlib.sha1(), 0, 0
            block = block.partition(b"\r\n\r\n")[2]
        self.sha.update(block)
        self.total += len(block)
        last = kind == "revisit" or "warc-segment-number" not in f or "warc-segment-total-length" in f
        self.rows.append((
            page(f["warc-record-id"]), "revisit" if kind == "revisit" else "response", self.number, block if self.payload else None,
            hashlib.sha1(block).hexdigest() if self.payload else None, self.sha.hexdigest(), self.total, last,
            f.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(f["x-payload-length"]) if kind == "revisit" else None,
                page(f.get("warc-refers-to")),
        ))
        self.number += 1

    def taken(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in CHUNKS.split(",")]
        columns = [pa.array([r[k] for r in self.rows], t) for k, t in enumerate(kinds)]
        self.rows = []
        return pa.record_batch(columns, names=names)


def read(spark, folder: str, payload: bool = True) -> DataFrame:
    """The chunk table of the archives in a folder; without payload, only numbers and digests."""

    def run(batches):
        reader = _Reader(payload)
        for batch in batches:
            for line in batch.column("value"):
                reader.line((line.as_buffer().to_pybytes() if line.is_valid else b"") + b"\n")
                if len(reader.rows) >= 256:
                    yield reader.taken()
        yield reader.taken()

    return spark.read.option("lineSep", "\n").text(folder).mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages written as archives and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    last = read(spark, folder, payload=False).filter("last")
    # of a response the digest is what was read; a revisit has no payload of its own, so its header tells
    return last.select(
        "page_id",
        F.coalesce("declared_bytes", "bytes_so_far").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("declared_sha1")).otherwise(F.col("sha1_so_far")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
