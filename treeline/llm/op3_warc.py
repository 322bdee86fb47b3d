"""WARC archives as a PySpark Python data source, and their writing with revisit records.

Reading: files are planned into partitions by size, large ones split at the members that a side file of offsets names.
Record types and header values are tested on the parsed headers; the payload of a record that is not wanted, because a
pushed-down predicate fails or because the requested schema has no payload, is not inflated: each gzip member's extra
field holds its compressed length ("sl"), so the reader steps over it. Other members, and those of several records, are
inflated piece by piece, and what isn't wanted is dropped as it comes. Header names are read without case.

Writing: each task writes one archive under a temporary name and the commit renames those of the tasks that succeeded and
removes what others have left. Files are named after the job: an append keeps what is there.

Scale: digests are grouped with partial aggregation; only digests that occur twice are joined back to the pages, by
broadcast if that table is small and else by a join that splits skewed keys. Payloads move once, from the page to the
archive. Memory is bounded by a record.

Defined cases: null html is empty; null url or page_id leaves its header out; of equal payloads the rows with the smallest
page_id are the response (all null: each is); payloads under 100 bytes are never revisits; an empty table gives no record.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from treeline.llm.common import filesystem, fresh_path, saved, table

#: Bytes of archives in a partition, about; bytes between the offsets that the side file names.
PARTITION, MARK = 32 << 20, 4 << 20
#: Smaller payloads are always written whole.
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
#: Columns of a record and the headers they come from.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "url": "WARC-Target-URI", "date": "WARC-Date", "digest": "WARC-Payload-Digest", "page_id": "X-Page-Id", "refers_to": "X-Refers-To-Page-Id", "payload_bytes": "X-Payload-Length"}
SCHEMA = "record_type string, record_id string, url string, date string, digest string, page_id long, refers_to long, payload_bytes long, headers map<string,string>, payload binary"
#: Names as records spell them.
_SPELT = {x.lower(): x for x in (*HEADERS.values(), "Content-Length", "Content-Type", "WARC-Refers-To", "WARC-Profile")}
#: Bytes inflated or looked through at once, and the most that a record's headers may take.
STEP, MOST_HEADERS = 1 << 16, 1 << 24
_HEAD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)")


def _clean(value) -> str:
    return re.sub(r"[\r\n\0]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(headers: dict, block: bytes) -> bytes:
    """A WARC record as one gzip member that names its own length."""
    lines = ["WARC/1.1", *(f"{k}: {_clean(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def page_record(page_id, url, payload: bytes, digest: str, response_id) -> bytes:
    """The record of a page: a revisit of response_id's, if that is given."""
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    kind = "response" if response_id is None else "revisit"
    headers = {"WARC-Type": kind, "WARC-Record-ID": name(page_id), "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-Id": page_id, "X-Payload-Length": len(payload)}
    if response_id is not None:
        headers |= {"WARC-Refers-To": name(response_id), "X-Refers-To-Page-Id": response_id, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    headers["Content-Type"] = "application/http; msgtype=response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(headers, http + (payload if response_id is None else b""))


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of page_id, url, html, digest and response_id. Files are named after the job, so an append keeps those of others; overwriting removes them once the new ones are there."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        store, at = filesystem(self.path)
        store.create_dir(at, recursive=True)
        final = f"{at}/part-{self.job}-{TaskContext.get().partitionId():06d}.warc.gz"
        temporary = f"{at}/.{self.job}-{uuid.uuid4().hex}.tmp"
        marks, place = [0], 0
        with store.open_output_stream(temporary) as out:
            for batch in iterator:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "response_id"))):
                    member = page_record(row[0], row[1], (row[2] or "").encode(), row[3], row[4])
                    if place - marks[-1] >= MARK:
                        marks.append(place)
                    out.write(member)
                    place += len(member)
        with store.open_output_stream(f"{temporary}.idx") as out:
            out.write(json.dumps(marks).encode())
        return Written(temporary, final)

    def commit(self, messages) -> None:
        store, at = filesystem(self.path)
        old = [f for f in _files(store, at) if re.search(r"\.warc(\.gz)?(\.idx)?$", f.path)] if self.overwrite else []
        for m in messages:
            if m is not None:
                store.move(f"{m.temporary}.idx", f"{m.final}.idx")
                store.move(m.temporary, m.final)
        for f in old:
            store.delete_file(f.path)
        self._clean(store, at)

    def abort(self, messages) -> None:
        self._clean(*filesystem(self.path))

    def _clean(self, store, at: str) -> None:
        """Remove what failed or repeated tasks of this job have left."""
        for f in _files(store, at):
            if f.base_name.startswith(f".{self.job}-"):
                store.delete_file(f.path)


def _files(store, at: str) -> list:
    from pyarrow import fs

    found = store.get_file_info(at)
    files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return [f for f in files if f.type == fs.FileType.File]


@dataclass
class Pieces(InputPartition):
    """Byte ranges (file, begin, end) that begin at members."""

    ranges: tuple


class _Input:
    """Bytes of a file from a place on, with what was read ahead."""

    def __init__(self, file, place: int):
        self.file, self.place, self.held = file, place, b""
        file.seek(place)

    def peek(self, n: int) -> bytes:
        if len(self.held) < n:
            self.held += self.file.read(max(n - len(self.held), 1 << 18))
        return self.held

    def skip(self, n: int) -> None:
        self.place += n
        if 0 <= n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.held = b""
            self.file.seek(self.place)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters):
        for f in filters:
            ok = isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS
            if ok:
                values = (f.value,) if isinstance(f, EqualTo) else tuple(f.value)
                self.tests.append((HEADERS[f.attribute[0]], {str(v) for v in values if v is not None}))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, at = filesystem(self.path)
        out, now, size = [], [], 0
        for f in sorted((f for f in _files(store, at) if re.search(r"\.warc(\.gz)?$", f.path)), key=lambda f: f.path):
            marks = [0]
            if f.size > PARTITION and store.get_file_info(f"{f.path}.idx").type == fs.FileType.File:
                with store.open_input_stream(f"{f.path}.idx") as side:
                    marks = json.loads(side.read())
            for a, b in zip(marks, [*marks[1:], f.size]):
                if now and size + b - a > PARTITION:
                    out.append(Pieces(tuple(now)))
                    now, size = [], 0
                now.append((f.path, a, b))
                size += b - a
        return [*out, Pieces(tuple(now))]

    def read(self, partition: Pieces):
        store, _ = filesystem(self.path)
        names = self.schema.fieldNames()
        wants = "payload" in names
        rows, size = [], 0
        for path, begin, end in partition.ranges:
            with store.open_input_file(path) as file:
                for headers, payload in members(_Input(file, begin), end, self._wanted, wants):
                    rows.append((headers, payload))
                    size += 1000 + len(payload or b"")
                    if size > 8 << 20:
                        yield self._batch(rows, names)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows, names)

    def _wanted(self, headers: dict) -> bool:
        return all(headers.get(h) in values for h, values in self.tests)

    def _batch(self, rows: list, names: list[str]) -> pa.RecordBatch:
        columns = []
        for name in names:
            if name == "payload":
                columns.append(pa.array([p for _, p in rows], pa.binary()))
            elif name == "headers":
                columns.append(pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string())))
            elif name in ("page_id", "refers_to", "payload_bytes"):
                columns.append(pa.array([int(h[HEADERS[name]]) if HEADERS[name] in h else None for h, _ in rows], pa.int64()))
            else:
                columns.append(pa.array([h.get(HEADERS[name]) for h, _ in rows], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=names)


class _Bytes:
    """Plain bytes of a source up to a place."""

    def __init__(self, source: _Input, end: int):
        self.source, self.end = source, end

    def peek(self, n: int) -> bytes:
        """At least n bytes, if there are so many."""
        return self.source.peek(n)[: max(0, self.end - self.source.place)]

    def skip(self, n: int) -> None:
        self.source.skip(min(n, max(0, self.end - self.source.place)))


class _Inflated:
    """Bytes of the gzip member at a source's place, inflated as they are asked for; what is skipped isn't kept."""

    def __init__(self, source: _Input):
        self.source, self.inflate, self.held, self.rest = source, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        block = self.rest or self.source.peek(1)[:STEP]
        if not block:
            return False
        if not self.rest:
            self.source.skip(len(block))
        self.held += self.inflate.decompress(block, STEP)
        self.rest = self.inflate.unconsumed_tail
        if self.inflate.eof:  # what follows the member goes back
            self.source.skip(-len(self.inflate.unused_data))
        return True

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        return self.held

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held = b""
            if not self._more():
                return
        self.held = self.held[n:]


def members(source: _Input, end: int, wanted, payloads: bool):
    """(headers, payload) of the wanted records up to a place; the payload is None unless it is asked for and the record holds one."""
    while source.place < end:
        head = source.peek(24)
        if head[:2] != b"\x1f\x8b":
            yield from _records(_Bytes(source, end), wanted, payloads)
            return
        length, raw_length = struct.unpack("<II", head[16:24]) if head[3] == 4 and head[12:14] == b"sl" else (0, 0)
        if length:  # the headers first: as much as they need
            first = source.peek(min(length, 2048))[: min(length, 2048)]
            raw = zlib.decompressobj(31).decompress(first, 4096)
            if (cut := raw.find(b"\r\n\r\n")) >= 0:
                headers = _headers(raw[:cut])
                if not (wanted(headers) and payloads) and _length(headers) + cut + 8 == raw_length:  # the member's only record
                    source.skip(length)
                    if wanted(headers):
                        yield headers, None
                    continue
        inflated = _Inflated(source)
        yield from _records(inflated, wanted, payloads)
        while inflated.peek(1):
            inflated.skip(STEP)


def _records(raw, wanted, payloads: bool):
    """All records of plain bytes; stops where no headers follow."""
    while True:
        while (head := raw.peek(2))[:1] in (b"\r", b"\n"):
            raw.skip(1)
        if not head:
            return
        n = STEP
        while (cut := (have := raw.peek(n)).find(b"\r\n\r\n")) < 0:
            if len(have) < n or n > MOST_HEADERS:
                return
            n *= 2
        headers = _headers(have[:cut])
        raw.skip(cut + 4)
        length = _length(headers)
        if wanted(headers):
            yield headers, _payload(headers, raw.peek(length)[:length]) if payloads else None
        raw.skip(length)


def _length(headers: dict) -> int:
    found = headers.get("Content-Length", "0").strip()
    return int(found) if found.isdigit() else 0


def _headers(raw: bytes) -> dict[str, str]:
    """Headers by name; names are read without case, known ones are spelt as here."""
    return {_SPELT.get(k.decode().lower(), k.decode()): v.decode("utf-8", "replace") for k, v in _HEAD.findall(raw)}


def _payload(headers: dict, block: bytes) -> bytes | None:
    if headers.get("WARC-Type") == "revisit":
        return None
    if headers.get("Content-Type", "").startswith("application/http"):
        return block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
    return block


class WarcDataSource(DataSource):
    """format("warc"): options: path. A schema given by the user, of the default's columns, leaves out what is not needed."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record for each row of page_id, url and html; repeated payloads become revisits."""
    register(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    seen = p.filter(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    twice = saved(seen.filter("n > 1 and first is not null").select(F.col("digest").alias("d"), "first"), "repeated-payloads", small=True)
    joined = p.join(twice, p["digest"] == twice["d"], "left")
    later = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).cast("long")
    joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "digest", later.alias("response_id")).write.format("warc").mode("append").save(path)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    columns = "page_id long, record_type string, refers_to long, payload_bytes long, digest string"
    read = lambda kind, more="": spark.read.format("warc").schema(columns + more).load(path).filter(F.col("record_type") == kind)
    payload = F.col("payload")
    response = read("response", ", payload binary").select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"), "record_type", "refers_to")
    # a revisit is known by its headers alone: the predicate is pushed down, and no payload is inflated
    revisit = read("revisit").select("page_id", "payload_bytes", F.substring_index("digest", ":", -1).alias("payload_digest"), "record_type", "refers_to")
    return response.unionByName(revisit)


#: DuckDB's form of the same result, from the pages themselves.
ORACLE = """
WITH p AS (SELECT page_id::BIGINT AS page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM r
"""
