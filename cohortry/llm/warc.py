"""WARC archives of pages: written by Spark tasks to the shared folder, one gzip member per record, and read back in sequence.

Records follow WARC/1.1. The page with the largest id of those with equal payloads (of at least ``least`` bytes) is a ``response``
record with the payload; the others are ``revisit`` records without it, which name the response. Both keep the HTTP head, so both
state the payload's length and digest. Reading inflates a member piece by piece, takes the block by its content length, and computes
the payload digest as the bytes come, so a reader holds one record at most, or none of it if payloads aren't asked for.

Null html is an empty payload; null url leaves the target out. A null id is its own group with the id left out, largest last. Rows
that repeat the id of a response are responses too. An empty table gives no archive and no rows. Other columns play no part. An
archive is named by a random part, and only archives in the manifest are read, so a task that runs twice does no harm. Records that
are cut off, lack a length, or end elsewhere than their member are errors; a digest that does not hold shows in ``verified``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.tables import SLOTS, slots_of, spread, stage
from cohortry.session import folder as staged_folder

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a task begins another archive, and the bytes read at a time.
ARCHIVE, PIECE = 64 << 20, 1 << 16


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and host that Spark takes it to have, so that tasks write where Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", uri)


def file_system(uri: str) -> tuple:
    """File system and path of a qualified folder or file."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def head(fields: dict[str, str]) -> bytes:
    return b"".join(f"{name}: {value}\r\n".encode() for name, value in fields.items()) + b"\r\n"


def record(kind: str, name: str, block: bytes, date: str, fields: dict[str, str]) -> bytes:
    """One record as a gzip member."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": date, **fields,
              "WARC-Block-Digest": f"sha1:{base32(hashlib.sha1(block).digest())}", "Content-Length": str(len(block))}
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(VERSION + b"\r\n" + head(fields) + block + b"\r\n\r\n") + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit without one."""
    block = b"HTTP/1.1 200 OK\r\n" + head({"Content-Type": "text/html; charset=utf-8", "Content-Length": str(size)})
    fields = {"WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)} if url else {}
    fields |= {"WARC-Payload-Digest": f"sha1:{base32(bytes.fromhex(sha1))}", "Content-Type": "application/http; msgtype=response"}
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    if payload is None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
        return record("revisit", name, block, date, fields)
    return record("response", name, block + payload, date, fields)


def plan(pages: DataFrame, least: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows ``(page_id, url, html, size, sha1, refers_to)``, html null for revisits."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("size"), F.sha1("html").alias("sha1"), F.sha2("html", 256).alias("sha256"),
                       slots_of(F.col("page_id")).alias("slot"))
    local = rows.groupBy("sha256", "slot").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    whole = local.groupBy("sha256").agg(F.max("top").alias("top"), F.sum("n").alias("n"), F.expr("bit_or(shiftleft(1L, slot))").alias("slots"))
    # only payloads that occur more than once need be told apart
    shared = spread(whole.where("n > 1").drop("n"), "slots", "slot")
    revisit = (F.col("size") >= least) & (F.col("page_id") != F.col("top"))
    return rows.join(shared, ["sha256", "slot"], "left").select(
        "page_id", "url", F.when(F.coalesce(~revisit, F.lit(True)), F.col("html")).alias("html"), "size", "sha1",
        F.when(revisit, F.col("top")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, least: int = 0, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives into ``folder``; the manifest ``(path, records, bytes)``. By default a folder of the shared one is used, and deleted
    with the staged tables. It must lie on a file system that pyarrow knows: local, hdfs, s3, gs or abfs."""
    folder = qualified(pages.sparkSession, folder or staged_folder(pages.sparkSession, "warc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        done, out, name, records, size = [], None, "", 0, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            columns[2] = columns[2].cast(pa.large_string()).cast(pa.large_binary())
            for row in zip(*(c.to_pylist() for c in columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                    info = record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", date,
                                  {"WARC-Filename": name, "Content-Type": "application/warc-fields"})
                    out.write(info)
                    records, size = 0, len(info)
                member = page_record(*row, date)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE:
                    out.close()
                    done.append((f"{folder}/{name}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         ["path", "records", "bytes"])

    rows = plan(pages, least, id_col, url_col, html_col)
    # written once and kept: the manifest says which archives count
    return stage(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


@dataclass
class Record:
    fields: dict[str, str]
    size: int = 0
    sha1: str = ""
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.split(b"\r\n")
    return {n.strip().lower().decode(): v.strip().decode("utf-8", "replace") for n, _, v in (x.partition(b":") for x in lines[1:]) if n}


class Reader:
    """Records of one archive in their order; the bytes of a record are looked at as they are inflated."""

    def __init__(self, stream, keep_payload: bool = False):
        self.stream, self.keep = stream, keep_payload
        self.raw, self.inflate, self.text = b"", None, b""

    def more(self) -> bool:
        """Inflate another piece of the member; False at its end."""
        while True:
            if self.inflate.eof:
                return False
            if not self.raw and not (raw := self.stream.read(PIECE)):
                raise ValueError("the archive ends within a record")
            elif not self.raw:
                self.raw = raw
            piece = self.inflate.decompress(self.raw, PIECE)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if piece:
                self.text += piece
                return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.text.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record ends within its head")
        found, self.text = self.text[:at], self.text[at + len(mark):]
        return found

    def __iter__(self) -> Iterator[Record]:
        while self.raw or (raw := self.stream.read(PIECE)):
            self.raw = self.raw or raw
            self.inflate, self.text = zlib.decompressobj(31), b""
            opening = self.until(b"\r\n\r\n")
            if not opening.startswith(b"WARC/"):
                raise ValueError("a record does not begin with its version")
            found = Record(parse_head(opening))
            left = int(found.fields["content-length"])
            if "msgtype=response" in found.fields.get("content-type", ""):
                before = self.until(b"\r\n\r\n")
                found.http = parse_head(before)
                left -= len(before) + 4
            digest, kept = hashlib.sha1(), []
            found.size = left
            while left:
                if not self.text and not self.more():
                    raise ValueError("a record ends within its block")
                piece, self.text = self.text[:left], self.text[left:]
                digest.update(piece)
                left -= len(piece)
                if self.keep:
                    kept.append(piece)
            found.sha1 = base32(digest.digest())
            found.payload = b"".join(kept) if self.keep else None
            while self.more():
                pass
            if self.text != b"\r\n\r\n":
                raise ValueError("a record ends elsewhere than its member")
            yield found


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"


def read(archives: DataFrame, with_payload: bool = False, path_col: str = "path") -> DataFrame:
    """One row per response and revisit of the archives listed in ``archives``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_())]
                           + [("payload", pa.binary())] * with_payload)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = file_system(path)
                rows, held = [], 0
                with files.open_input_stream(name, compression=None) as stream:
                    for r in Reader(stream, with_payload):
                        kind = r.fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        stated = r.fields["warc-payload-digest"].removeprefix("sha1:")
                        whole = kind == "response"
                        row = (page_of(r.fields["warc-record-id"]), r.fields.get("warc-target-uri"),
                               r.size if whole else int(r.http["content-length"]), r.sha1 if whole else stated, kind,
                               page_of(r.fields.get("warc-refers-to")), r.sha1 == stated if whole else None)
                        rows.append(row + ((r.payload if whole else None,) if with_payload else ()))
                        held += len(r.payload or b"")
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    # an archive is the unit of work; their list is small and written in few parts
    spread_out = archives.select(path_col).repartition(max(SLOTS, archives.sparkSession.sparkContext.defaultParallelism, archives.count()))
    return spread_out.mapInArrow(run, READ + (", payload binary" if with_payload else ""))
