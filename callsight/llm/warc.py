"""WARC archives: writing, normalising whole-file gzip streams to one member a record, an offset index (operator 10).

``write_archives`` turns pages into archives whose records stand in one gzip stream a file, as some crawlers leave them.
``normalise_archives`` inflates each such stream once, front to back, writes every record as a gzip member of its own and
beside it an index of the members' offsets, with which single records can be read. ``read_archives`` reads the members
that the index names. Files are read and written as streams; a task holds one record at a time.

Files lie in a folder that all executors share, under names with a part of their own for each attempt of a task. Only
files in the manifest, a table written when a step has ended, count; what a lost executor left is not in it.

Defined cases: a null html is an empty payload, as is an empty one; a null url is written as an empty target; a null
page_id is written and read back as null, is never referred to, and its copies refer to the largest id that is not null;
rows equal in page_id and payload are written each and have the same type; a very long html is one record; an empty table gives no files and no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import landed, shipped

#: A file is closed when its records, before compression, reach this size.
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has no payload of its own and names its length in a header."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
        block, kind = http, "application/http; msgtype=response"
    else:
        block, kind = http + payload, "application/http; msgtype=response"
    head += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with lower-case names, and the block of one record."""
    head, end, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not end or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


class Records:
    """Records of a gzip stream, of one member or several, read front to back; ``read(n)`` gives up to n bytes."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.rest, self.held = read, b"", bytearray()
        self.inflater = zlib.decompressobj(31)
        self.fresh = True  # between members

    def _more(self) -> bool:
        while True:
            data = self.rest or self.read(READ_BYTES)
            self.rest = b""
            if not data:
                if not self.fresh:
                    raise ValueError("the gzip stream is cut off")
                return False
            self.fresh = False
            out = self.inflater.decompress(data, 4 * READ_BYTES)
            self.rest = self.inflater.unconsumed_tail
            if self.inflater.eof:
                self.rest = self.inflater.unused_data
                self.inflater, self.fresh = zlib.decompressobj(31), True
            if out:
                self.held += out
                return True

    def __iter__(self) -> Iterator[bytes]:
        while True:
            while (at := self.held.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.held.strip():
                        raise ValueError("the last record is cut off")
                    return
            size = None
            for line in bytes(self.held[:at]).split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length":
                    size = int(value)
            if size is None:
                raise ValueError("a record without a length")
            whole = at + 4 + size + 4
            while len(self.held) < whole:
                if not self._more():
                    raise ValueError("the last record is cut off")
            yield bytes(self.held[:whole])
            del self.held[:whole]


def _opened(folder: str):
    """The file system of a folder's URL and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _folder(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path.rstrip("/")


def with_references(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): the largest page_id with an equal payload of at least ``least`` bytes, null in that row itself."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.select("*", F.sha2("html", 256).alias("payload"))
    # The payloads themselves stay out of the grouping; copies are summed up before the shuffle.
    largest = keyed.filter(F.octet_length("html") >= least).groupBy("payload").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    copied = largest.filter("n > 1 AND last IS NOT NULL").select("payload", "last")
    of = F.when(F.col("page_id").eqNullSafe(F.col("last")), F.lit(None)).otherwise(F.col("last"))
    return keyed.join(copied, "payload", "left").select("page_id", "url", "html", of.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, level: int = 4, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the pages' records, one gzip stream a file; returns the manifest."""
    folder = _folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, path = _opened(folder)
        where.create_dir(path, recursive=True)
        out = squeeze = None
        name, number, count, size, done = "", 0, 0, 0, []

        def close():
            out.write(squeeze.flush())
            out.close()
            done.append((name, count, size))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz"
                    out, squeeze = where.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                    number, count, size = number + 1, 0, 0
                raw = record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py())
                out.write(squeeze.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield from _manifest(done)

    return landed(with_references(shipped(pages), least).mapInArrow(run, MANIFEST), "warc-manifest")


def _manifest(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])


def _dealt(manifest: DataFrame) -> DataFrame:
    """A task per file, as far as there are files."""
    return shipped(manifest).repartition(max(1, min(manifest.count(), 100_000)))


def normalise_archives(manifest: DataFrame, source: str, folder: str, level: int = 4) -> DataFrame:
    """Rewrites the manifest's files with one member a record and an index beside each (``.idx``); returns the new manifest.

    An index line is a JSON object with the record's type, target, offset and length.
    """
    source, folder = _folder(source), _folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        old, old_path = _opened(source)
        new, path = _opened(folder)
        new.create_dir(path, recursive=True)
        for batch in batches:
            done = []
            for file in batch.column(0).to_pylist():
                name = f"{file.removesuffix('.warc.gz')}-{attempt}.warc.gz"
                at = count = 0
                with old.open_input_stream(f"{old_path}/{file}", compression=None) as stream, new.open_output_stream(f"{path}/{name}", compression=None) as out, new.open_output_stream(f"{path}/{name}.idx", compression=None) as index:
                    for raw in Records(stream.read):
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = squeeze.compress(raw) + squeeze.flush()
                        out.write(member)
                        fields, _ = parse(raw)
                        index.write(json.dumps({"type": fields["warc-type"], "target": fields["warc-target-uri"], "offset": at, "length": len(member)}).encode() + b"\n")
                        at, count = at + len(member), count + 1
                done.append((name, count, at))
            yield from _manifest(done)

    return landed(_dealt(manifest).mapInArrow(run, MANIFEST), "warc-normalised")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record, read at the place that the index names; a payload that contradicts its digest is an error."""
    folder = _folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _opened(folder)
        names = [f.split()[0] for f in ROWS.split(", ")]
        types = [pa.string() if f.endswith("string") else pa.int64() for f in ROWS.split(", ")]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with where.open_input_stream(f"{path}/{file}.idx", compression=None) as index:
                    entries = [json.loads(line) for line in index.read().splitlines()]
                rows = []
                with where.open_input_file(f"{path}/{file}") as archive:
                    for e in entries:
                        fields, block = parse(zlib.decompress(archive.read_at(e["length"], e["offset"]), 31))
                        rows.append((*described(fields, block), file, e["offset"], e["length"]))
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), types)], names)

    return _dealt(manifest).mapInArrow(run, ROWS)


def described(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of a record."""
    head, _, payload = block.partition(b"\r\n\r\n")
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or digest(payload) != said):
        raise ValueError(f"{fields['warc-record-id']}: the payload is not the one that was written")
    number = lambda x: int(x) if x else None
    return number(fields["x-page-id"]), fields["warc-target-uri"], size, said, kind, number(fields.get("x-refers-to-page-id"))
