"""Volume images as Python data sources: `mft` yields file-table entries and spills, `usn` yields journal records.

Both plan byte ranges on the driver and parse in the tasks; a corrupt record is skipped and numbering stays by slot.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeline.operators import forest as F

CHUNK = 4 << 20


class Corrupt(ValueError):
    """Bytes that can't be what they should be."""


@dataclass(frozen=True)
class Boot:
    sector: int
    cluster: int
    mft_cluster: int
    record: int
    serial: int


def _clusters(raw: int, unit: int) -> int:
    """A signed count of clusters; negative: a power of two of bytes."""
    return 1 << (256 - raw) if raw > 0x80 else raw * unit


def parse_boot(b: bytes) -> Boot:
    if len(b) < 512 or b[3:11] != b"NTFS    ":
        raise Corrupt("no boot sector")
    sector = struct.unpack_from("<H", b, 11)[0]
    per = 1 << (256 - b[13]) if b[13] > 0x80 else b[13]
    if sector not in (256, 512, 1024, 2048, 4096) or not per or per & (per - 1):
        raise Corrupt("geometry")
    cluster = sector * per
    mft, _, record, _, serial = struct.unpack_from("<QQbxxxb3xQ", b, 0x30)
    size = 1 << -record if record < 0 else record * cluster
    if not 256 <= size <= 65536 or size % sector:
        raise Corrupt("record size")
    return Boot(sector, cluster, mft, size, serial)


def parse_runs(b: bytes, most: int = 1 << 40) -> list[tuple[int | None, int]]:
    """(first cluster or None if sparse, clusters) of a run list."""
    out, at, place, total = [], 0, 0, 0
    while at < len(b) and b[at]:
        wide, far = b[at] & 15, b[at] >> 4
        if not 1 <= wide <= 8 or far > 8 or at + 1 + wide + far > len(b):
            raise Corrupt("run header")
        n = int.from_bytes(b[at + 1 : at + 1 + wide], "little")
        step = int.from_bytes(b[at + 1 + wide : at + 1 + wide + far], "little", signed=True)
        at += 1 + wide + far
        total += n
        place += step
        if not n or place < 0 or total > most:
            raise Corrupt("run")
        out.append((place if far else None, n))
    return out


def fixed_up(b: bytes, sector: int) -> bytearray:
    """A record whose sectors' last two bytes are restored from its update sequence."""
    at, n = struct.unpack_from("<HH", b, 4)
    if n != len(b) // sector + 1 or at + 2 * n > len(b):
        raise Corrupt("update sequence")
    out = bytearray(b)
    for i in range(1, n):
        end = i * sector - 2
        if out[end : end + 2] != b[at : at + 2]:
            raise Corrupt("torn write")
        out[end : end + 2] = b[at + 2 * i : at + 2 * i + 2]
    return out


@dataclass(frozen=True)
class Attribute:
    kind: int
    name: str
    flags: int
    value: bytes | None  # of a resident one
    runs: bytes
    first_cluster: int
    size: int
    allocated: int

    @property
    def is_unnamed(self) -> bool:
        return not self.name

    @property
    def is_first_fragment(self) -> bool:
        """Sizes stand in the first of an attribute's fragments only."""
        return self.first_cluster == 0

    @property
    def is_sparse_or_compressed(self) -> bool:
        return bool(self.flags & 0x80FF)


def attributes(b: bytes):
    """The attributes of a record up to its end mark, or to the first malformed one."""
    at = struct.unpack_from("<H", b, 20)[0]
    while at + 16 <= len(b):
        kind, length, far, chars, name_at, flags = struct.unpack_from("<IIBBHH", b, at)
        if kind == 0xFFFFFFFF or length < 24 or length % 8 or at + length > len(b):
            return
        one = b[at : at + length]
        name = text_of(one[name_at : name_at + 2 * chars])
        if far:
            if length < 64:
                return
            first, _, runs_at = struct.unpack_from("<QQH", one, 16)
            allocated, size = struct.unpack_from("<QQ", one, 40)
            yield Attribute(kind, name, flags, None, bytes(one[runs_at:]), first, size, allocated)
        else:
            n, value_at = struct.unpack_from("<IH", one, 16)
            if value_at + n > length:
                return
            yield Attribute(kind, name, flags, bytes(one[value_at : value_at + n]), b"", 0, n, -(-n // 8) * 8)
        at += length


def text_of(raw: bytes) -> str:
    return bytes(raw).decode("utf-16-le", "replace")


# Attribute kinds, and the file attributes that become flags.
STANDARD, ATTRIBUTE_LIST, FILE_NAME, DATA, REPARSE_POINT = 0x10, 0x20, 0x30, 0x80, 0xC0
_DOS = {0x1: F.READONLY, 0x2: F.HIDDEN, 0x4: F.SYSTEM, 0x200: F.SPARSE, 0x400: F.REPARSE, 0x800: F.COMPRESSED, 0x4000: F.ENCRYPTED}
_RANK = {3: 4, 1: 3, 0: 2, 2: 1}
_FIRST_USER = 16


def _best_name(attrs: list[Attribute]):
    """(rank, parent record, name, allocated, size) of the best file name; equal ranks: the first."""
    best = None
    for a in attrs:
        if a.kind == FILE_NAME and a.value is not None and len(a.value) >= 66 and a.value[64] and len(a.value) >= 66 + 2 * a.value[64]:
            parent, allocated, size = struct.unpack_from("<Q", a.value)[0], *struct.unpack_from("<QQ", a.value, 40)
            found = (_RANK.get(a.value[65], 0), parent & 0xFFFFFFFFFFFF, text_of(a.value[66 : 66 + 2 * a.value[64]]), allocated, size)
            if found[0] > (best[0] if best else 0):
                best = found
    return best


def parse_record(b: bytes, number: int, sector: int = 512) -> dict | None:
    """A row of a slot of the file table: kind `entry` or `extension`; None if it is unused or has no name."""
    if b[:4] != b"FILE":
        return None
    b = fixed_up(b, sector)
    sequence, links, _, state = struct.unpack_from("<HHHH", b, 16)
    base = struct.unpack_from("<Q", b, 32)[0]
    if not state & 1:
        return None
    attrs = list(attributes(b))
    data = next((a for a in attrs if a.kind == DATA and a.is_unnamed and a.is_first_fragment), None)
    name = _best_name(attrs)
    if base:
        row = {"kind": "extension", "record_no": number, "base": base & 0xFFFFFFFFFFFF, "own_size": data.size if data else None, "own_alloc": data.allocated if data else None}
        return row | ({"name_rank": name[0], "parent_record": name[1], "name": name[2]} if name else {})
    if not name:
        return None
    flags = (F.DIRECTORY if state & 2 else 0) | (F.METADATA | F.SYSTEM if number < _FIRST_USER else 0) | (F.HARD_LINK if links > 1 else 0)
    mtime = 0
    for a in attrs:
        if a.kind == STANDARD and a.value is not None and len(a.value) >= 36:
            mtime, dos = struct.unpack_from("<q", a.value, 8)[0], struct.unpack_from("<I", a.value, 32)[0]
            for bit, flag in _DOS.items():
                flags |= flag if dos & bit else 0
        elif a.kind == DATA:
            flags |= (F.HAS_ADS if a.name else 0) | (F.SPARSE if a.is_sparse_or_compressed else 0)
        elif a.kind == REPARSE_POINT:
            flags |= F.REPARSE
    spilled = any(a.kind == ATTRIBUTE_LIST for a in attrs)
    size, allocated = (data.size, data.allocated) if data else (name[4], name[3]) if spilled else (0, 0)
    if flags & F.DIRECTORY:
        size = allocated = 0
    return {"kind": "entry", "record_no": number, "sequence": sequence, "parent_record": name[1], "name": name[2], "own_size": size, "own_alloc": allocated, "filetime": mtime, "flags": flags, "links": links, "spilled": spilled, "name_rank": name[0]}


@dataclass
class Extent(InputPartition):
    """Records of the file table from a byte on."""

    begin: int
    size: int
    first: int


MFT_SCHEMA = "kind string, record_no long, base long, sequence int, parent_record long, name string, own_size long, own_alloc long, filetime long, flags int, links int, spilled boolean, name_rank int"


class MftReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _boot(self, file) -> Boot:
        file.seek(0)
        return parse_boot(file.read(512))

    def _open(self):
        from pyarrow import fs

        store, at = (fs.FileSystem.from_uri(self.path)) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        return store.open_input_file(at)

    def partitions(self):
        with self._open() as file:
            boot = self._boot(file)
            file.seek(boot.mft_cluster * boot.cluster)
            own = fixed_up(file.read(boot.record), boot.sector)
        runs = next((a.runs for a in attributes(own) if a.kind == DATA and not a.name), None)
        if runs is None:
            raise Corrupt("the file table has no data")
        step = max(1, CHUNK // math.lcm(boot.record, boot.cluster)) * math.lcm(boot.record, boot.cluster)  # whole records and clusters
        out, virtual = [], 0
        for place, n in parse_runs(runs):
            if place is not None and virtual % boot.record == 0:
                size = n * boot.cluster
                out += [Extent(place * boot.cluster + i, min(step, size - i), (virtual + i) // boot.record) for i in range(0, size, step)]
            virtual += n * boot.cluster
        return out

    def read(self, partition: Extent):
        """Arrow batches, one for each partition: a partition is CHUNK bytes of records at most."""
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        fields = [x.split() for x in MFT_SCHEMA.split(", ")]
        rows = []
        with self._open() as file:
            boot = self._boot(file)
            file.seek(partition.begin)
            data = file.read(partition.size)
        for i in range(0, len(data) - boot.record + 1, boot.record):
            try:
                row = parse_record(data[i : i + boot.record], partition.first + i // boot.record, boot.sector)
            except (Corrupt, struct.error):
                continue
            if row:
                rows.append(row)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[k]) for c, k in fields], names=[c for c, _ in fields])


class MftDataSource(DataSource):
    """format("mft").load(image)."""

    @classmethod
    def name(cls) -> str:
        return "mft"

    def schema(self) -> str:
        return MFT_SCHEMA

    def reader(self, schema) -> MftReader:
        return MftReader(self.options["path"])


USN_SCHEMA = "usn long, file_ref long, parent_ref long, reason long, attributes long, name string"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parse_journal(b: bytes):
    """(next usn, records) of a batch: records of version 2; a malformed length ends it."""
    if len(b) < 8:
        raise Corrupt("batch")
    out, at = [], 8
    while at + 4 <= len(b):
        length = struct.unpack_from("<I", b, at)[0]
        if length < 0x3C or length % 8 or at + length > len(b):
            break
        if struct.unpack_from("<H", b, at + 4)[0] == 2:
            file, parent, usn, _, reason = struct.unpack_from("<QQqqI", b, at + 8)
            attrs, n, name_at = struct.unpack_from("<IHH", b, at + 52)
            out.append((usn, _signed(file), _signed(parent), reason, attrs, text_of(b[at + name_at : at + name_at + n])))
        at += length
    return struct.unpack_from("<q", b)[0], out


@dataclass(frozen=True)
class JournalInfo:
    journal_id: int
    first_usn: int
    next_usn: int

    def can_resume_from(self, usn: int) -> bool:
        return can_resume(usn, self.first_usn, self.next_usn)


def parse_journal_info(b: bytes) -> JournalInfo:
    """What a volume tells about its journal: its id, its first record and the next to come."""
    if len(b) < 24:
        raise Corrupt("journal info")
    return JournalInfo(*struct.unpack_from("<Qqq", b))


def can_resume(usn: int, first: int, next_: int) -> bool:
    """Whether a journal that holds [first, next_] still has what follows usn."""
    return first <= usn <= next_


def decode_batches(batches):
    """Journal records of rows with a binary `batch`, through mapInArrow."""
    import pyarrow as pa

    for rows in batches:
        found = [x for b in rows.column("batch").to_pylist() if b for x in parse_journal(b)[1]]
        columns = list(zip(*found)) or [()] * 6
        kinds = [pa.int64()] * 5 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in USN_SCHEMA.split(", ")])


def entries_of(rows, vol_ord: int, drive: str):
    """Entries for the forest from rows of format("mft"): extension records repair their base."""
    from pyspark.sql import functions as S

    from treeline.functions.text import unix_of_filetime
    from treeline.operators.spill import repair

    rows = rows.withColumn("vol_ord", S.lit(vol_ord))
    ext = rows.filter("kind = 'extension'").withColumn("arrival", S.col("record_no"))
    sizes = ext.filter("own_size is not null").select("vol_ord", "base", "arrival", S.col("own_size").alias("size"), S.col("own_alloc").alias("alloc"))
    names = ext.filter("name is not null").select("vol_ord", "base", "arrival", S.col("name_rank").alias("rank"), S.col("parent_record").alias("parent"), "name")
    fixed = repair(rows.filter("kind = 'entry'").drop("kind", "base"), sizes, names)
    return fixed.select("vol_ord", S.lit(drive).alias("drive"), "record_no", "sequence", "parent_record", "name", "flags", "own_size", "own_alloc", unix_of_filetime(S.col("filetime")).alias("mtime_unix"))
