"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: each task packs its rows as gzip members, one a record, into a file of its own in a shared folder. Of payloads
that are equal and have ``least`` bytes or more, the one with the largest id is written as response and the others as
revisit records without their payload.

Reading: files are dealt out as byte ranges. A task scans its range for the gzip magic, takes a candidate for a member if
its first bytes decode to a WARC version line, then decodes member after member and owns those that start inside its
range, reading past its end to finish the last one. A damaged member is passed over and the scan goes on behind it.

Defined cases: a null payload counts as empty; a null id or url is a record without that header and reads back as null;
rows with one id and payload are all responses where that id is the largest; line breaks in a url are percent-encoded; an
empty table gives no archive and no records; other columns are ignored. Paths may be of any store pyarrow opens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BIN, LONG, STR, quoted, schema, scratch_path, spread, written

MAGIC, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
RECORD = schema(id=LONG, url=STR, record_type=STR, refers_to=LONG, payload_bytes=LONG, header_digest=STR, payload=BIN, path=STR, offset=LONG)
RECORD_ARROW = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("header_digest", pa.string()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])


def member(head: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in head.items() if v is not None), f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + END + block + END) + pack.flush()


def page_record(id_: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """Response, or revisit if ``refers_to`` names another record. A revisit keeps the HTTP header, hence the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    again = refers_to is not None
    head = {
        "WARC-Type": "revisit" if again else "response",
        "WARC-Record-ID": None if id_ is None else f"<urn:page:{id_}>",
        "WARC-Target-URI": None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if again else None,
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if again else None,
        "Content-Type": "application/http; msgtype=response",
    }
    return member(head, http if again else http + payload)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """Writes the archives; (path, bytes, records) of each file, as a written table, so that no retry writes again."""
    rows = spread(pages.select(quoted(id_col).cast("long").alias("id"), quoted(url_col).cast("string").alias("url"), F.coalesce(quoted(payload_col), F.lit("")).cast("binary").alias("payload")))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("digest", "last")
    rows = rows.join(groups, "digest", "left").select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, n, size = None, 0, 0
        for batch in batches:
            for id_, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    store, at = pyarrow.fs.FileSystem.from_uri(path)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(at, compression=None)
                    size += out.write(member({"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields"}, b"software: quillspark\r\n"))
                size += out.write(page_record(id_.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

    return written(rows.mapInArrow(pack, schema(path=STR, bytes=LONG, records=LONG)), "manifest")


class Members:
    """The gzip members of a file that start in [start, end)."""

    def __init__(self, file: pa.NativeFile, start: int, end: int, chunk: int = 1 << 18):
        self.file, self.size, self.start, self.end, self.chunk = file, file.size(), start, min(end, file.size()), chunk

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at)) if at < self.size else b""

    def first_from(self, at: int) -> int | None:
        """The first offset in [at, end) where a member with a WARC version line begins."""
        while at < self.end:
            part = self.read(at, self.chunk + 2)
            k = part.find(MAGIC)
            while k >= 0:
                if at + k >= self.end:
                    return None
                try:
                    if zlib.decompressobj(31).decompress(self.read(at + k, 1024), 16).startswith(VERSION):
                        return at + k
                except zlib.error:
                    pass
                k = part.find(MAGIC, k + 1)
            at += self.chunk
        return None

    def whole(self, at: int) -> tuple[bytes, int]:
        """The content of the member at ``at``, and where it ends."""
        unpack, out, here = zlib.decompressobj(31), [], at
        while not unpack.eof:
            part = self.read(here, self.chunk)
            if not part:
                raise zlib.error("the member is cut off")
            here += len(part)
            out.append(unpack.decompress(part))
        return b"".join(out), here - len(unpack.unused_data)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        at = self.first_from(self.start)
        while at is not None and at < self.end:
            try:
                content, after = self.whole(at)
            except zlib.error:
                at = self.first_from(at + 1)
                continue
            yield at, content
            at = after if self.read(after, 3) == MAGIC else self.first_from(after)


def parsed(content: bytes) -> dict | None:
    """Fields of a response or revisit record; None for other records and for what isn't one."""
    top, _, block = content.partition(END)
    lines = top.decode("utf-8", "replace").split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind = head.get("warc-type")
    if not lines[0].startswith("WARC/1.") or kind not in ("response", "revisit"):
        return None
    block = block[: int(head["content-length"])]
    http, _, payload = block.partition(END)
    length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    page = lambda v: int(v.strip("<>").rpartition(":")[2]) if v else None
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return {"id": page(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": page(head.get("warc-refers-to")), "payload_bytes": length, "header_digest": digest, "payload": payload if kind == "response" else None}


def read_warc(files: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """A row per response or revisit record of the files (path, bytes), read by byte ranges of ``split_bytes``."""
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    parts = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    rows, held = [], 0
                    for offset, content in Members(file, start, start + split_bytes):
                        if row := parsed(content):
                            rows.append(row | {"path": path, "offset": offset})
                            held += len(content)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)

    return ranges.repartition(parts).mapInArrow(scan, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """The records of a table of pages, written to the shared folder and read back."""
    return read_warc(write_warc(pages, scratch_path(spark, "warc")), split_bytes)
