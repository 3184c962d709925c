"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader hands out byte ranges. A task looks for gzip magic in its range, takes a candidate for a member only if it
decompresses to a WARC header, and owns the records that start inside its range, reading past its end to finish the
last one. So archives of any size are read by many tasks, and a lost task reads its range again.

Archives of others are read too: any record type, any record id, members of several records, header names in any case.
Every record is a row; what is wrong with one is said in its `problem` and doesn't stop the rest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, gone_at_exit, written

_MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: A record. page_id and refers_to are those of our own archives; digest: as declared, whatever its algorithm.
RECORD = "page_id long, record_id string, url string, record_type string, refers_to long, refers_to_id string, payload_bytes long, payload_digest string, digest string, payload binary, problem string"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def _header(text: str | None) -> str:
    """A header's value: control characters are percent-coded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """An uncompressed WARC record. A revisit holds the HTTP header, with the length of the full payload, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    """The named fields of a header, by lower-cased name; a line that starts with white space goes on with the last one."""
    out, name = {}, None
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _blank_line(data: bytes, at: int = 0) -> tuple[int, int]:
    """(end of the header, start of what follows) of the header at data[at:]; (-1, -1) without a blank line."""
    found = re.compile(rb"\r?\n\r?\n").search(data, at)
    return (found.start(), found.end()) if found else (-1, -1)


def _page(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", record_id or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def _same_digest(declared: str, payload: bytes) -> bool | None:
    """Whether a declared digest, base 32 or hexadecimal, is that of payload; None if its algorithm is not known."""
    name, _, value = declared.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    real = hashlib.new(name, payload).digest()
    return value.upper().rstrip("=") == base64.b32encode(real).decode().rstrip("=") or value.lower() == real.hex()


def parse_records(data: bytes, whole: bool = True):
    """Yields the records (see RECORD) of an uncompressed member; whole: the member has not been cut off.

    A payload is the block without its HTTP header, if it is HTTP. payload_digest is the SHA-1 of the payload; of a
    revisit, whose payload is elsewhere, the declared one, and payload_bytes the length that its HTTP header tells."""
    at = 0
    while at < len(data):
        end, start = _blank_line(data, at)
        fields = _fields(data[at:end]) if end >= 0 else {}
        kind, declared = fields.get("warc-type", "unknown").lower(), fields.get("warc-payload-digest")
        length = fields.get("content-length", "")
        problem = None
        if end < 0 or not length.isdigit():
            problem, start, stop = "no length", max(start, at), len(data)
        else:
            stop = start + int(length)
        if stop > len(data) or (problem and not whole):
            problem, stop = "truncated", len(data)
        block = data[start:stop]
        http_end, body = _blank_line(block) if "application/http" in fields.get("content-type", "") or (kind in ("response", "revisit") and block[:5] == b"HTTP/") else (-1, -1)
        payload = block[body:] if http_end >= 0 else (b"" if block[:5] == b"HTTP/" else block)
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        size, digest = len(payload), own
        if kind == "revisit":
            told = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})", block[:http_end] if http_end >= 0 else block)
            size, digest, payload = int(told[1]) if told else None, declared.partition(":")[2] if declared else None, None
        elif declared and not problem and _same_digest(declared, payload) is False:
            problem = "digest"
        identity, refers = fields.get("warc-record-id"), fields.get("warc-refers-to")
        yield {"page_id": _page(identity), "record_id": identity, "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _page(refers), "refers_to_id": refers,
               "payload_bytes": size, "payload_digest": digest, "digest": declared, "payload": payload, "problem": problem}
        # the next record, past the line ends that close this one
        at = stop
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1


def record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, hex (SHA-1 of the payload) and refers_to of every row of pages (page_id, url, html).

    Of rows with equal payloads of min_bytes or more the one with the least page_id gets no refers_to, the others that
    page_id; of rows that repeat that page_id and payload, one. A null html is an empty payload."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("hex", F.sha1(F.col("html").cast("binary")))
    narrow = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "hex")
    firsts = narrow.groupBy("hex").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("hex", "first")
    marks = narrow.distinct().join(firsts, "hex").withColumnRenamed("hex", "of").hint("merge")
    rows = rows.join(marks.withColumnRenamed("page_id", "of_page"), (F.col("page_id") == F.col("of_page")) & (F.col("hex") == F.col("of")), "left")
    again = F.row_number().over(Window.partitionBy("page_id", "hex").orderBy("url"))
    rows = rows.withColumn("again", again)
    return rows.select("page_id", "url", "html", "hex", F.when((F.col("first") < F.col("page_id")) | (F.col("again") > 1), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3) -> DataFrame:
    """Writes pages (page_id, url, html) as gzipped WARC files into folder, one member per record; returns path, bytes and records.

    Each attempt of a task has a file of its own; what is returned are the files of the attempts that succeeded."""
    fs, path = _fs(folder)
    fs.create_dir(path)

    def run(batches):
        fs, base = _fs(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, size, records = None, 0, 0
        for batch in batches:
            for page_id, url, html, hexed, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "hex", "refers_to"))):
                if out is None:
                    fs.create_dir(base)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(page_id, url, html.encode(), digest, refers_to)) + packer.flush()
                out.write(member)
                size, records = size + len(member), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [records]})

    return written(record_types(pages, min_bytes).mapInArrow(run, "path string, bytes long, records long"), "archives")


def _member(file, data: bytes, at: int, rest: int):
    """(content, bytes used, whether whole) of the gzip member at data[at:], or None if there is none; rest: where the
    file goes on after data. A member that ends early, or is damaged after its first header, is not whole."""
    unpack = zlib.decompressobj(31)
    out, used, valid = bytearray(), 0, False
    while not unpack.eof:
        if at + used < len(data):
            chunk = data[at + used : at + used + _STEP]
        else:
            chunk = file.read_at(_STEP, rest + at + used - len(data))
        try:
            if not chunk:
                raise zlib.error("cut off")
            # in steps, so that what comes before the damage is kept
            left, more = chunk, True
            while more and not unpack.eof:
                most = _STEP if valid else 1 << 10
                got = unpack.decompress(left, most)
                out += got
                left = unpack.unconsumed_tail
                more = bool(left) or len(got) == most
                if not valid:
                    if not out.startswith(b"WARC/"[: len(out)]):
                        return None
                    valid = len(out) > 5 and _blank_line(out)[0] >= 0
        except zlib.error:
            return (bytes(out), used, False) if valid else None
        used += len(chunk) - len(unpack.unused_data)
    return (bytes(out), used, True) if valid else None


class _File:
    """read_at of an Arrow file that reports a short read at the end."""

    def __init__(self, fs, path):
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def read_at(self, n: int, offset: int) -> bytes:
        n = min(n, self.size - offset)
        return self.file.read_at(n, offset) if n > 0 else b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def records_in(file: _File, start: int, end: int):
    """The records of the members that start in [start, end)."""
    data = file.read_at(end - start + len(_MAGIC) - 1, start)
    at = 0
    while (at := data.find(_MAGIC, at)) >= 0 and start + at < end:
        got = _member(file, data, at, start + len(data))
        if got is None:
            at += 1
            continue
        content, used, whole = got
        yield from parse_records(content, whole)
        # behind a damaged member the next one is looked for
        at += used if whole else 1


_TYPES = pa.schema([
    ("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string()),
])


def archive_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, bytes) of archives that Spark can list; globs are allowed."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """All records of the gzipped archives files (path, bytes), whoever wrote them; see RECORD for the columns.

    problem is null, or truncated (the file ends, or is damaged, within the record), no length, or digest (the payload is
    not what its digest says). A revisit has no payload. Bytes that belong to no member are passed over."""
    total = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    ranges = files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"), F.col("bytes")).repartition(max(1, min(int(total), 100_000)))

    def run(batches):
        for batch in batches:
            for path, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "bytes"))):
                fs, inner = _fs(path)
                rows, held = [], 0
                with _File(fs, inner) as file:
                    for record in records_in(file, start, min(start + split_bytes, size)):
                        rows.append(record)
                        held += len(record["payload"] or b"")
                        if held > 16 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)

    return ranges.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0, split_bytes: int = 8 << 20) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in the shared folder and returns the records that are read back.

    Every row becomes one record; a record that comes back with a problem is an error. Null and empty htmls are empty payloads, a null url leaves the header out; rows that
    repeat a page_id and payload are one response and revisits of it; extra columns are ignored; no pages, no records.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    files = write_archives(pages, folder, min_bytes)
    gone_at_exit(spark, folder)
    found = read_archives(spark, files, split_bytes)
    wrong = F.raise_error(F.concat(F.coalesce("record_id", F.lit("a record")), F.lit(": "), F.col("problem"))).cast("string")
    return found.withColumn("problem", F.when(F.col("problem").isNotNull(), wrong))
