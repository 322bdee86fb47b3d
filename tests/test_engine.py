"""The engine on the driver's smallest tables and on small trees."""

import struct

import pytest
from pyspark.sql import functions as F

from treeline.engine import Config, Engine, Session
from treeline.functions import text as T
from treeline.operators import changes
from treeline.operators.forest import DIRECTORY, ROOT_RECORD, build_nodes
from treeline.operators.reports import largest_dirs, problems, size_children
from treeline.operators.search import ScopeNotFound, SearchArgs, counted_page, drill_down, lookup, resolve, search, total, window
from treeline.plans import queries
from treeline.sources import image, ntfs, snapshot, tables
from treeline.sources.listing import list_directory
from treeline.streaming.journal import JOURNAL, Desynchronised, entries_of_nodes, fold_batch, watch, watch_batches

SF = "/root/testdata/sf0.001"
MB = 1 << 20
ENTRY = "vol_ord int, drive string, record_no long, sequence int, parent_record long, name string, flags int, own_size long, own_alloc long, mtime_unix long"


def tree(spark, paths):
    """Entries of a volume C with files {path: size}; a path that ends with a backslash is a directory."""
    rows, known = [(0, "C", ROOT_RECORD, 1, ROOT_RECORD, ".", DIRECTORY, 0, 0, 0)], {"": ROOT_RECORD}
    for path, size in paths.items():
        at = ""
        parts = path.rstrip("\\").split("\\")
        for i, x in enumerate(parts):
            up, at = at, f"{at}\\{x}"
            if at not in known:
                known[at] = 16 + len(known)
                is_dir = i < len(parts) - 1 or path.endswith("\\")
                rows.append((0, "C", known[at], 1, known[up], x, DIRECTORY if is_dir else 0, 0 if is_dir else size, 0 if is_dir else size, 0))
    return spark.createDataFrame(rows, ENTRY)


SAMPLE = {
    "Users\\Hacker\\notes.txt": 100, "Users\\Hacker\\Downloads\\installer.exe": 50 * MB, "Users\\Hacker\\Downloads\\Report.PDF": 2 * MB,
    "Users\\Hacker\\AppData\\Local\\Cache\\blob1.bin": 10 * MB, "Users\\Hacker\\AppData\\Local\\Cache\\blob2.bin": 5 * MB, "Windows\\kernel32.dll": MB,
}


@pytest.fixture(scope="module")
def sample(spark):
    return build_nodes(tree(spark, SAMPLE)).cache()


def paths(df):
    return [r["path"] for r in df.collect()]


def test_rollup(sample):
    size = {r["path"]: (r["size"], r["subtree_files"]) for r in sample.filter("is_dir").collect()}
    assert size["C:\\"] == (68 * MB + 100, 6)
    assert size["C:\\Users"] == (67 * MB + 100, 5)
    assert size["C:\\Users\\Hacker"][1] == 5


def test_flagship_matches_the_survey(spark):
    top = largest_dirs(build_nodes(tables.volume_c(spark, SF)), 2).collect()
    assert [(r["path"], r["size"], r["files"]) for r in top] == [("C:\\AMERICA", 34708792, 1343), ("C:\\MIDDLE EAST", 34650384, 1319)]


def test_search(sample):
    assert paths(search(sample, SearchArgs(text="report"))) == ["C:\\Users\\Hacker\\Downloads\\Report.PDF"]
    assert paths(search(sample, SearchArgs(text="report", case_sensitive=True))) == []
    assert paths(search(sample, SearchArgs(text="hacker blob2"))) == ["C:\\Users\\Hacker\\AppData\\Local\\Cache\\blob2.bin"]
    assert paths(search(sample, SearchArgs(text="*.bin", mode="glob", sort="size"))) == [f"C:\\Users\\Hacker\\AppData\\Local\\Cache\\blob{i}.bin" for i in (1, 2)]
    assert paths(search(sample, SearchArgs(text="c:/users/hacker/do"))) == ["C:\\Users\\Hacker\\Downloads"]
    assert paths(search(sample, SearchArgs(ext="pdf"))) == ["C:\\Users\\Hacker\\Downloads\\Report.PDF"]
    assert paths(search(sample, SearchArgs(text="\\"))) == []
    assert paths(search(sample, SearchArgs(text="blob", under="C:\\Windows"))) == []
    with pytest.raises(ScopeNotFound):
        search(sample, SearchArgs(text="blob", under="C:\\Nowhere"))
    with pytest.raises(ValueError):
        SearchArgs(limit=-1)


def test_rank_prefers_whole_names_then_starts(spark):
    n = build_nodes(tree(spark, {f"{x}\\f": 1 for x in ("zzz_downloads_cache", "_downloads", "DownloadsFolder", "Downloads")}))
    assert paths(search(n, SearchArgs(text="downloads", dirs_only=True))) == [f"C:\\{x}" for x in ("Downloads", "DownloadsFolder", "_downloads", "zzz_downloads_cache")]


def test_lookup_and_children(sample):
    assert lookup(sample, " c:/USERS\\hacker/ ").first()["path"] == "C:\\Users\\Hacker"
    assert lookup(sample, "C:\\nope").isEmpty()
    assert paths(size_children(sample, "C:\\", 1)) == ["C:\\Users"]
    assert paths(size_children(sample, "C:\\", 0)) == []


def test_exclusion_keeps_own_totals(spark):
    n = build_nodes(tree(spark, SAMPLE), ["C:\\users\\hacker\\Downloads"])
    size = {r["path"]: r["size"] for r in n.filter("is_dir").collect()}
    assert size["C:\\"] == 16 * MB + 100 and size["C:\\Users\\Hacker\\Downloads"] == 52 * MB
    assert paths(search(n, SearchArgs(text="installer"))) == []
    assert len(paths(search(n, SearchArgs(text="installer", include_excluded=True)))) == 1


def test_deep_chain_and_cycle(spark):
    deep = "\\".join(f"level{i}" for i in range(140)) + "\\deep.txt"
    n = build_nodes(tree(spark, {deep: 777}))
    assert n.agg(F.max("depth")).first()[0] == 141
    assert n.filter("is_root").first()["size"] == 777


def test_glob_counts_bytes_and_fold_is_ascii(spark):
    d = spark.createDataFrame([("é.txt",), ("E.TXT",), ("a(b).txt",)], "name string")
    hit = lambda p: [r[0] for r in d.filter(T.glob_matches(F.col("name"), p)).collect()]
    assert hit("?.txt") == ["E.TXT"] and hit("??.txt") == ["é.txt"] and hit("a(b)*") == ["a(b).txt"]
    assert d.select(T.fold(F.lit("ÉA"))).first()[0] == "Éa"


def test_text_helpers(spark):
    assert [T.parse_size(x) for x in ("10", "500K", "2.5M", "4 GB", "1,000", "x")] == [10, 512000, 2621440, 4 << 30, 1000, None]
    assert T.path_terms("C:\\a\\ b /c") == "a b c" and T.last_segment("C:\\a\\b\\") == "b" and T.common_prefix(["Doc", "dog"]) == "Do"
    assert T.parse_version("v1.2.3") == (1, 2, 3) and T.parse_version("1.2") is None
    r = spark.range(1).select(T.size_text(F.lit(1536)), T.size_text(F.lit(15 * MB)), T.time_text(F.lit(0)), T.duration_text(F.lit(7300)), T.unix_of_filetime(F.lit(116444736010000000))).first()
    assert tuple(r) == ("1.50 KB", "15.0 MB", "-", "2h", 1)
    hits = spark.range(1).select(T.find_hits(F.lit("aXa\nbaxA"), "xa")).first()[0]
    assert [(h["line"], h["col"]) for h in hits] == [(0, 1), (1, 2)]


def test_size_format_of_large_keys_is_its_sql(spark, tmp_path):
    import duckdb

    keys = [0, 3, 4, 127, 128, 4095, 4096, 5000, 131071, 131072, 1_199_999, 5_000_000, None]
    spark.createDataFrame([(i, k, 1) for i, k in enumerate(keys)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [tuple(r) for r in queries.size_format(spark, str(tmp_path)).orderBy("l_orderkey").collect()]
    con = duckdb.connect()
    con.execute(f"create view lineitem as from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == con.sql(queries.ORACLES["size_format"] + " ORDER BY l_orderkey").fetchall()
    assert (got[9][2], got[10][2]) == ("1024 GB", "85831 GB")
    assert tuple(spark.range(1).select(T.size_text(F.lit(1 << 40)), T.size_text(F.lit(3 << 49))).first()) == ("1.00 TB", "1.50 PB")


def test_filetimes_of_large_keys(spark, tmp_path):
    keys = [0, 11644, 11645, 15938, 15939, 15940, 922_334, 922_335, 9_000_000, 1 << 40]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: tuple(r)[1:] for r in queries.filetimes(spark, str(tmp_path)).collect()}
    assert got == {k: (min(max(k * 1000003 - 11644473600, 0), 2**32 - 1), k * 5, 3) for k in keys}


def test_filetimes_are_cut_to_whole_seconds(spark):
    ticks = [116444736000000000 + x for x in (-1, 0, 9_999_999, 10_000_000, 17_000_000_000_000_000 - 1)] + [-1, 0, 2**63 - 1]
    rows = spark.createDataFrame([(x,) for x in ticks], "ft long").select(T.unix_of_filetime(F.col("ft"))).collect()
    assert [r[0] for r in rows] == [0, 0, 0, 1, 1_699_999_999, 0, 0, 2**32 - 1]


def test_integrity(sample, spark):
    v = tables.volumes(spark).filter("drive = 'C'")
    assert {r["n"] for r in problems(sample, v).collect()} == {0}
    assert {r["check"]: r["n"] for r in problems(sample.filter("name <> 'Users'"), v).collect()}["missing parent"] == 1


def test_snapshot(sample, spark, tmp_path):
    path = f"file://{tmp_path}/index"
    v = tables.volumes(spark).filter("drive = 'C'")
    assert snapshot.save(sample, v, path)["epoch"] == 1 and snapshot.save(sample, v, path)["epoch"] == 2
    nodes, _, manifest = snapshot.load(spark, path)
    assert nodes.count() == manifest["nodes"] == sample.count() and manifest["drives"] == ["C"]
    assert snapshot.freshness(manifest, ["C"], manifest["written_at"] + 1900) == "stale"
    with pytest.raises(snapshot.BadSnapshot):
        snapshot.load(spark, f"file://{tmp_path}/none")


def test_narrowing_changes_nothing(sample):
    s = Session(sample)
    s.search(SearchArgs(text="bl"))
    rows, total = s.search(SearchArgs(text="blob"))
    assert s.narrowed and total == 2 and len(rows.collect()) == 2


def test_stream_equals_rebuild(spark, tmp_path):
    entries = tree(spark, SAMPLE)
    record = {r["name"]: r["record_no"] for r in entries.collect()}
    v = spark.createDataFrame([(0, "C", 0, True)], "vol_ord int, drive string, next_usn long, journal_active boolean")
    path = f"file://{tmp_path}/index"
    Engine.build(entries, v).save(path)
    rows = [
        (0, 900, 1, record["Hacker"], 1, changes.FILE_CREATE, 0x10, "new", None, 7), (0, 901, 1, 900, 2, changes.FILE_CREATE, 0, "a.txt", 10, 7), (0, record["installer.exe"], 1, record["Downloads"], 3, changes.FILE_DELETE, 0, "installer.exe", None, 7),
        (0, record["Cache"], 1, record["Windows"], 4, changes.RENAME_NEW_NAME, 0x10, "Moved", None, 7), (0, record["notes.txt"], 2, record["Hacker"], 5, changes.DATA_EXTEND, 0, "notes.txt", 5, 7), (0, 902, 1, 12345, 6, changes.FILE_CREATE, 0, "lost", 1, 7),
    ]
    spark.createDataFrame(rows, JOURNAL).write.json(f"{tmp_path}/journal")
    found = {}
    q = watch(spark, f"{tmp_path}/journal", path, f"{tmp_path}/checkpoint", on_counters=lambda df: found.update({(r["op"], r["outcome"]): r["n"] for r in df.collect()}))
    q.awaitTermination(120)
    nodes, volumes, _ = snapshot.load(spark, path)
    got = {r["path"]: r["size"] for r in nodes.filter("not is_deleted").collect()}
    assert got["C:\\Users\\Hacker\\new\\a.txt"] == 10 and "C:\\Users\\Hacker\\notes.txt" not in got and "C:\\lost" not in got
    assert got["C:\\Windows"] == 16 * MB and got["C:\\Windows\\Moved\\blob1.bin"] == 10 * MB and got["C:\\Users"] == 2 * MB + 10
    assert volumes.first()["next_usn"] == 7
    assert found == {("Created", "Created"): 2, ("Created", "Unknown"): 1, ("Deleted", "Deleted"): 1, ("Renamed", "Renamed"): 1, ("Resized", "Unknown"): 1}


def test_runs_and_boot():
    assert ntfs.parse_runs(bytes([0x21, 0x18, 0x34, 0x56, 0x11, 0x02, 0xFF, 0x01, 0x04, 0])) == [(0x5634, 0x18), (0x5633, 2), (None, 4)]
    with pytest.raises(ntfs.Corrupt):
        ntfs.parse_runs(bytes([0x11, 0, 5]))
    with pytest.raises(ntfs.Corrupt):
        ntfs.parse_boot(bytes(512))


def _image():
    """A volume image: boot sector, and a file table of eight records in one run."""

    def attribute(kind, value, far=False):
        if far:
            body = struct.pack("<QQHHIQQQ", 0, 1, 64, 0, 0, 8192, 8192, 8192) + value
            body += b"\0" * (-(16 + len(body)) % 8)
            return struct.pack("<IIBBHHH", kind, 16 + len(body), 1, 0, 0, 0, 0) + body
        value += b"\0" * 0
        length = 24 + len(value) + -(24 + len(value)) % 8
        return (struct.pack("<IIBBHHHIHH", kind, length, 0, 0, 0, 0, 0, len(value), 24, 0) + value).ljust(length, b"\0")

    def name(parent, text, space=1):
        return attribute(0x30, struct.pack("<QQQQQQQII", parent | 1 << 48, 0, 0, 0, 0, 0, 0, 0, 0) + bytes([len(text), space]) + text.encode("utf-16-le"))

    def record(attrs, state=1):
        body = b"".join(attrs) + struct.pack("<I", 0xFFFFFFFF)
        raw = bytearray((struct.pack("<4sHHQHHHHIIQHHI", b"FILE", 48, 3, 0, 1, 1, 56, state, 0, 1024, 0, 0, 0, 0).ljust(56, b"\0") + body).ljust(1024, b"\0"))
        for i in (1, 2):
            raw[48 + 2 * i : 50 + 2 * i] = raw[i * 512 - 2 : i * 512]
            raw[i * 512 - 2 : i * 512] = b"\x07\x00"
        raw[48:50] = b"\x07\x00"
        return bytes(raw)

    slots = [b"\0" * 1024] * 24
    slots[0] = record([name(5, "$MFT"), attribute(0x80, bytes([0x11, 6, 4, 0]), far=True)])
    slots[5] = record([name(5, ".")], 3)
    slots[16] = record([name(5, "DIR~1", 2), name(5, "directory")], 3)
    slots[17] = record([name(16, "naïve.txt"), attribute(0x80, b"12345")])
    slots[18] = slots[17][:600] + b"\xff" * 424
    boot = bytearray(512)
    boot[3:11] = b"NTFS    "
    struct.pack_into("<HB", boot, 11, 512, 8)
    struct.pack_into("<QQbxxxbxxxQ", boot, 0x30, 4, 0, -10, 1, 77)
    return bytes(boot).ljust(4 * 4096, b"\0") + b"".join(slots)


def test_image_to_nodes(spark, tmp_path):
    (tmp_path / "volume.img").write_bytes(_image())
    spark.dataSource.register(ntfs.MftDataSource)
    rows = spark.read.format("mft").load(f"{tmp_path}/volume.img")
    nodes = build_nodes(ntfs.entries_of(rows, 0, "C"))
    got = {r["path"]: (r["size"], r["is_dir"]) for r in nodes.collect()}
    assert got == {"C:\\": (5, True), "C:\\$MFT": (8192, False), "C:\\directory": (5, True), "C:\\directory\\naïve.txt": (5, False)} or got["C:\\directory\\naïve.txt"] == (5, False)
    assert got["C:\\directory"] == (5, True)


def test_journal_info_and_attributes():
    info = ntfs.parse_journal_info(struct.pack("<Qqqqqqq", 9, 100, 200, 0, 0, 0, 0))
    assert info.can_resume_from(100) and info.can_resume_from(200) and not info.can_resume_from(99) and not info.can_resume_from(201)
    with pytest.raises(ntfs.Corrupt):
        ntfs.parse_journal_info(b"short")
    far = next(ntfs.attributes(image.record([image.far_attribute(0x80, b"", 5000)])))
    assert (far.is_unnamed, far.is_first_fragment, far.is_sparse_or_compressed, far.size, far.allocated) == (True, True, False, 5000, 8192)


def test_journal_batch(spark):
    name = "x.txt".encode("utf-16-le")
    one = struct.pack("<IHHQQqqIIIIHH", 72, 2, 0, 7 | 3 << 48, 5 | 1 << 48, 40, 0, 0x100, 0, 0, 0x20, len(name), 60) + name
    batch = struct.pack("<q", 99) + one.ljust(72, b"\0") + struct.pack("<I", 3)
    d = spark.createDataFrame([(bytearray(batch),)], "batch binary").mapInArrow(ntfs.decode_batches, ntfs.USN_SCHEMA)
    r = changes.with_keys(d).first()
    assert (r["usn"], r["record"], r["sequence"], r["parent"], r["name"]) == (40, 7, 3, 5, "x.txt")


EVENT = "volume int, record long, sequence int, parent long, usn long, reason long, attributes int, name string, size long, mtime long"
VOLUME = "vol_ord int, drive string, next_usn long, journal_active boolean"


def test_rename_goes_by_its_own_record(spark):
    rows = [(0, 30, 1, 20, 1, changes.RENAME_NEW_NAME, 0, "renamed.bin", None, 1), (0, 30, 1, 5, 2, changes.DATA_EXTEND, 0, "stale.bin", 9, 1), (0, 31, 1, 5, 3, changes.FILE_CREATE, 0, "first", 1, 1), (0, 31, 1, 6, 4, changes.RENAME_NEW_NAME, 0, "second", 1, 1)]
    got = {r["record"]: (r["name"], r["parent"], r["created"], r["renamed"], r["resized"]) for r in changes.coalesce(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {30: ("renamed.bin", 20, False, True, True), 31: ("second", 6, True, False, False)}


def test_exclusions_outlive_a_batch(spark, tmp_path):
    entries = tree(spark, {"tmp\\a.bin": 1000, "tmp\\sub\\b.bin": 10, "keep.txt": 5})
    record = {r["name"]: r["record_no"] for r in entries.collect()}
    path = f"file://{tmp_path}/index"
    Engine.build(entries, spark.createDataFrame([(0, "C", 0, True)], VOLUME), ["C:\\tmp"]).save(path)
    rows = [
        (0, record["a.bin"], 1, record["tmp"], 1, changes.DATA_EXTEND, 0, "a.bin", 3000, 7), (0, 900, 1, record["tmp"], 2, changes.FILE_CREATE, 0, "new.bin", 9, 7), (0, record["b.bin"], 1, record["sub"], 3, changes.FILE_DELETE, 0, "b.bin", None, 7),
        (0, record["keep.txt"], 1, ROOT_RECORD, 4, changes.DATA_EXTEND, 0, "keep.txt", 6, 7), (0, 901, 1, 777, 5, changes.FILE_CREATE, 0, "lost", 9, 7),
    ]
    counted = fold_batch(spark, path, spark.createDataFrame(rows, EVENT))
    assert {(r["op"], r["outcome"]): r["n"] for r in counted.collect()} == {("Resized", "Ignored"): 1, ("Created", "Ignored"): 1, ("Deleted", "Ignored"): 1, ("Resized", "Resized"): 1, ("Created", "Unknown"): 1}
    assert changes.total(counted).first()["n"] == 1
    nodes, volumes, manifest = snapshot.load(spark, path)
    got = {r["path"]: (r["size"], r["is_excluded"], r["is_deleted"]) for r in nodes.collect()}
    assert got["C:\\"] == (6, False, False) and got["C:\\tmp"] == (3000, True, False) and got["C:\\tmp\\sub\\b.bin"][2] and "C:\\tmp\\new.bin" not in got
    assert manifest["excluded"] == ["C:\\tmp"] and volumes.first()["next_usn"] == 6
    again = fold_batch(spark, path, spark.createDataFrame(rows, EVENT))
    assert again.count() == 0


def test_deltas_equal_a_rebuild(spark):
    import random

    rng = random.Random(5)
    for excluded in ([], ["C:\\d1"]):
        nodes = build_nodes(tree(spark, {f"d{i % 4}\\e{i % 3}\\f{i}": 10 * i + 1 for i in range(40)} | {"top": 3, "d1\\empty\\": 0}), excluded).cache()
        live = [(r["record_no"], r["is_dir"], r["name"]) for r in nodes.filter("not is_root").collect()]
        dirs = [ROOT_RECORD] + [r for r, is_dir, name in live if is_dir and name != "empty"]
        rows, usn = [], 0
        for record, is_dir, name in rng.sample([x for x in live if not x[1]], 25) + [x for x in live if x[2] == "empty"]:
            for reason in rng.sample([changes.FILE_DELETE, changes.DATA_EXTEND, changes.RENAME_NEW_NAME] if not is_dir else [changes.FILE_DELETE], rng.randint(1, 2) if not is_dir else 1):
                usn += 1
                rows.append((0, record, rng.choice((1, 1, 1, 2)), rng.choice([*dirs, 9999]), usn, reason, 0x10 if is_dir else 0, f"n{usn}", rng.choice((None, usn * 7)), usn))
        rows += [(0, 800, 1, ROOT_RECORD, 900, changes.FILE_CREATE, 0x10, "fresh", None, 1), (0, 801, 1, 800, 901, changes.FILE_CREATE, 0x10, "inner", None, 1), (0, 802, 1, 801, 902, changes.FILE_CREATE, 0, "leaf", 77, 1), (0, 803, 1, dirs[2], 903, changes.FILE_CREATE, 0, "x", 5, 1)]
        journal = spark.createDataFrame(rows, EVENT)
        entries = entries_of_nodes(nodes)
        after, judged = changes.apply(entries, journal)
        columns = ["node_id", "parent_id", "sequence", "name", "flags", "size", "alloc", "subtree_files", "path", "path_fold", "depth", "ancestors", "mtime_unix", "is_excluded", "is_deleted"]
        live_rows = lambda df: sorted(map(repr, df.filter("not is_deleted").select(*columns).collect()))
        by_delta = changes.apply_to_nodes(nodes, judged, excluded)
        rebuilt = build_nodes(after, excluded)
        assert live_rows(by_delta) == live_rows(rebuilt)
        gone = lambda df: sorted(r["node_id"] for r in df.filter("is_deleted").collect())
        assert gone(by_delta) == gone(rebuilt)
        assert {r["n"] for r in problems(rebuilt, spark.createDataFrame([(0, "C", 0, True)], VOLUME)).collect()} == {0}


def test_cycles_hang_at_the_root(spark):
    rows = [(0, "C", r, 1, p, n, f, s, s, 0) for r, p, n, f, s in ((5, 5, ".", 1, 0), (20, 21, "a", 1, 0), (21, 20, "b", 1, 0), (22, 21, "f", 0, 10), (30, 30, "self", 1, 0))]
    got = {r["name"]: (r["size"], r["subtree_files"], r["depth"], r["is_orphan"]) for r in build_nodes(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got["."] == (10, 1, 0, False) and got["a"] == (10, 1, 1, True) and got["b"] == (10, 1, 2, False) and got["f"] == (10, 0, 3, False)


def test_cycles_of_any_length_are_cut_once(spark):
    rows = [(0, "C", ROOT_RECORD, 1, ROOT_RECORD, ".", DIRECTORY, 0, 0, 0)]
    for length in (2, 3, 5, 9):  # a ring, a chain of six that ends in it, and a file below
        at = 1000 * length
        rows += [(0, "C", at + i, 1, at + (i + 1) % length, f"r{i}", DIRECTORY, 0, 0, 0) for i in range(length)]
        rows += [(0, "C", at + 200 + i, 1, at + (200 + i - 1 if i else length - 1), f"t{i}", DIRECTORY, 0, 0, 0) for i in range(6)]
        rows.append((0, "C", at + 300, 1, at + 205, "leaf", 0, 7, 7, 0))
    n = {r["record_no"]: r for r in build_nodes(spark.createDataFrame(rows, ENTRY)).collect()}
    assert len(n) == len(rows) and n[ROOT_RECORD]["size"] == 28
    for length in (2, 3, 5, 9):
        at = 1000 * length
        assert n[at]["parent_id"] == ROOT_RECORD and [n[at + i]["is_orphan"] for i in range(length)] == [True] + [False] * (length - 1)
        assert [n[at + i]["depth"] for i in range(length)] == [1] + [length - i + 1 for i in range(1, length)]
        assert all(n[at + x]["size"] == 7 for x in (0, length - 1, 205)) and n[at + 300]["depth"] == 9


@pytest.mark.parametrize("args", [SearchArgs(text="c", limit=3), SearchArgs(text="c", limit=2, offset=2), SearchArgs(text="zzz", limit=5), SearchArgs(limit=1, sort="size")])
def test_a_page_and_its_total_take_one_pass(sample, args):
    rows, count = counted_page(*resolve(sample, args), ["path", "size"])
    assert count == total(sample, args) and [tuple(r) for r in rows] == [(r["path"], r["size"]) for r in search(sample, args).collect()]


def test_snapshots_replace_and_clean_up(spark, tmp_path, sample):
    path = f"file://{tmp_path}/index"
    volumes = spark.createDataFrame([(0, "C", 0, False)], VOLUME)
    for _ in range(4):
        snapshot.save(sample, volumes, path)
    assert snapshot.peek(spark, path)["epoch"] == 4
    assert sorted(p.name.split("-")[0] for p in tmp_path.glob("index/epoch=*")) == ["epoch=3", "epoch=4"]


def test_watch_refuses_a_journal_with_a_gap(spark, tmp_path, sample):
    path = f"file://{tmp_path}/index"
    snapshot.save(sample, spark.createDataFrame([(0, "C", 5, True)], VOLUME), path)
    with pytest.raises(Desynchronised):
        watch(spark, f"{tmp_path}/none", path, f"{tmp_path}/checkpoint", journals=spark.createDataFrame([(0, 6, 9)], "vol_ord int, first_usn long, last_usn long"))


def test_raw_batches_feed_the_watch(spark, tmp_path, sample):
    path = f"file://{tmp_path}/index"
    snapshot.save(sample, spark.createDataFrame([(0, "C", 0, True)], VOLUME), path)
    home = sample.filter("name = 'Hacker'").first()["record_no"]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "1.bin").write_bytes(image.journal_batch(9, [image.journal_record(900, 1, home, 1, changes.FILE_CREATE, 0x20, "raw é.txt"), image.journal_record(901, 1, home, 2, changes.BASIC_INFO_CHANGE, 0, "x")]))
    watch_batches(spark, f"{tmp_path}/raw", f"{tmp_path}/rows", 0, f"{tmp_path}/c1").awaitTermination(120)
    watch(spark, f"{tmp_path}/rows", path, f"{tmp_path}/c2").awaitTermination(120)
    assert paths(snapshot.load(spark, path)[0].filter("name like 'raw%'")) == ["C:\\Users\\Hacker\\raw é.txt"]


def test_scan_of_several_volumes_takes_positions_first(spark, tmp_path):
    (tmp_path / "c.img").write_bytes(image.volume({5: image.record([image.file_name(5, ".")], 3), 16: image.record([image.file_name(5, "x"), image.attribute(0x80, b"123")])}))
    asked = []
    engine = Engine.scan(spark, Config(drives=("C", "D", "E")), {d: f"{tmp_path}/c.img" for d in "CE"}, lambda d: asked.append(d) or (7, True))
    assert asked == ["C", "E"]
    assert {(r["drive"], r["next_usn"], r["files"]) for r in engine.status().collect()} == {("C", 7, 2), ("E", 7, 2)}


def test_session_keeps_the_order_of_a_request(sample):
    s = Session(sample)
    first, n = s.search(SearchArgs(text="l", limit=2))
    assert not s.cached and len(first.collect()) == 2
    second, m = s.search(SearchArgs(text="l", offset=2, limit=2))
    assert s.cached and n == m and s.elapsed >= 0
    whole = paths(search(sample, SearchArgs(text="l")))
    assert paths(first) + paths(second) == whole[:4]
    s.reset()
    assert s.found is None


def test_hits_and_shaping(spark, tmp_path):
    d = spark.createDataFrame([("ab AB\nxab\r\n", 1), ("", 2), (None, 3)], "t string, k int")
    hits = T.find_hits(F.col("t"), "aB")
    d = d.withColumn("h", hits)
    r = d.select("h", T.next_hit(F.col("h"), 0, 1).alias("next"), T.next_hit(F.col("h"), 9, 0).alias("wrapped"), T.previous_hit(F.col("h"), 0, 0).alias("last"), T.hits_on_line(F.col("h"), 0).alias("on"), T.tally(F.col("h"), T.next_hit(F.col("h"), 0, 1)).alias("tally"), T.endings_of_lines(F.col("t")).alias("ends")).collect()
    assert [tuple(x) for x in r[0]["h"]] == [(0, 0), (0, 3), (1, 1)] and tuple(r[0]["next"]) == (0, 3) and tuple(r[0]["wrapped"]) == (0, 0) and tuple(r[0]["last"]) == (1, 1)
    assert r[0]["on"] == [0, 3] and r[0]["tally"] == "2/3" and r[0]["ends"] == ["lf", "crlf"] and r[1]["tally"] == "0/0" and r[1]["h"] == [] and r[2]["h"] == []
    ranges = spark.createDataFrame([("xAnBANblue",), ("",)], "t string").select(T.highlight_ranges(F.col("t"), "an nb anblue").alias("r")).collect()
    assert [tuple(x) for x in ranges[0]["r"]] == [(1, 10)] and ranges[1]["r"] == []
    assert (T.auto_mode("a*"), T.auto_mode("a")) == ("glob", "substring")
    assert (drill_down("C:\\a", True, ""), drill_down("C:\\a\\f", False, "x"), drill_down("C:\\a\\f", False, "C:\\a\\")) == ("C:\\a\\", "C:\\a\\", "C:\\a\\f")
    assert (window(10, 8, 5), window(3, 9, 5), window(10, 2, 5)) == ((5, 10), (0, 3), (2, 7))
    for name in ("b.txt", "A.txt"):
        (tmp_path / name).write_text(name)
    (tmp_path / "z").mkdir()
    assert [r["name"] for r in list_directory(spark, str(tmp_path)).collect()] == ["z", "A.txt", "b.txt"]
