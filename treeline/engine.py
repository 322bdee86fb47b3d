"""The engine over one index: search, size, bloat, dupes, status, rescan and watch, each returning a DataFrame."""

from __future__ import annotations

import time
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.text import now_unix
from treeline.operators import dupes, reports
from treeline.operators.forest import build_nodes
from treeline.operators.search import SearchArgs, page, resolve, result_rows
from treeline.sources import ntfs, snapshot
from treeline.streaming.journal import watch


@dataclass(frozen=True)
class Config:
    drives: tuple[str, ...] = ("C",)
    exclude: tuple[str, ...] = ()
    include_metadata: bool = False

    @staticmethod
    def load(path: str) -> Config:
        """A TOML file; defaults where it or a key is missing."""
        try:
            found = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        except FileNotFoundError:
            return Config()
        return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in Config.__dataclass_fields__})


@dataclass
class Session:
    """Narrowing and paging of an interactive search: a longer text, all else equal, filters what was found before; other pages of the same request read the order that was kept."""

    nodes: DataFrame
    args: SearchArgs | None = None
    found: DataFrame | None = field(default=None, repr=False)
    narrowed: bool = False
    cached: bool = False
    elapsed: float = 0.0
    asked: SearchArgs | None = None
    count: int = 0

    def search(self, args: SearchArgs) -> tuple[DataFrame, int]:
        """(page of result rows, number of matches)."""
        began, before = time.monotonic(), self.args
        paged = lambda a: replace(a, offset=0, limit=0)
        self.cached = before is not None and paged(args) == paged(before)
        if not self.cached:
            same = before is not None and args.mode == before.mode == "substring" and "\\" not in args.text + before.text and "/" not in args.text + before.text and ":" not in args.text
            alike = lambda a: replace(paged(a), sort="name", text="")
            self.narrowed = bool(same and args.text.startswith(before.text) and len(args.text.split()) == len(before.text.split()) and alike(args) == alike(before))
            found, self.asked = resolve(self.found if self.narrowed else self.nodes, args)
            old, self.found = self.found, found.persist()
            self.count = self.found.count()
            if old is not None:
                old.unpersist()
        self.args = args
        rows = result_rows(page(self.found, replace(self.asked, offset=args.offset, limit=args.limit)))
        self.elapsed = time.monotonic() - began
        return rows, self.count

    def reset(self) -> None:
        if self.found is not None:
            self.found.unpersist()
        self.args = self.found = self.asked = None


class Engine:
    def __init__(self, nodes: DataFrame, volumes: DataFrame, excluded: list[str] = ()):
        self.nodes, self.volumes, self.excluded = nodes, volumes, list(excluded)

    @staticmethod
    def build(entries: DataFrame, volumes: DataFrame, excluded: list[str] = ()) -> Engine:
        return Engine(build_nodes(entries, list(excluded)), volumes, excluded)

    @staticmethod
    def scan(spark: SparkSession, config: Config, images: dict[str, str], positions) -> Engine:
        """The volumes of config that have an image. positions(drive) tells a journal's next position and whether it runs; it is asked before the volume's table is read, so that no change falls between."""
        spark.dataSource.register(ntfs.MftDataSource)
        known, entries = [], None
        for i, drive in enumerate(d for d in config.drives if d in images):
            known.append((i, drive, *positions(drive)))
            one = ntfs.entries_of(spark.read.format("mft").load(images[drive]), i, drive)
            entries = one if entries is None else entries.unionByName(one)
        if entries is None:
            raise LookupError("no volume to scan")
        volumes = spark.createDataFrame(known, "vol_ord int, drive string, next_usn long, journal_active boolean")
        return Engine.build(entries, volumes, config.exclude)

    @staticmethod
    def open(spark: SparkSession, path: str, drives: list[str], rescan) -> Engine:
        """The snapshot at path if it is sound and fresh, else what rescan() builds, saved there. rescan() returns an Engine."""
        try:
            nodes, volumes, manifest = snapshot.load(spark, path)
            if snapshot.freshness(manifest, drives, now_unix()) != "rebuild":
                return Engine(nodes, volumes, manifest["excluded"])
        except snapshot.BadSnapshot:
            pass
        built = rescan()
        built.save(path)
        nodes, volumes, manifest = snapshot.load(spark, path, verify=False)
        return Engine(nodes, volumes, manifest["excluded"])

    def search(self, args: SearchArgs) -> DataFrame:
        found, asked = resolve(self.nodes, args)
        return result_rows(page(found, asked))

    def size(self, path: str, top: int = 20) -> tuple[DataFrame, DataFrame]:
        return reports.size_of(self.nodes, path), reports.size_children(self.nodes, path, top)

    def bloat(self, top: int = 30, under: str | None = None) -> DataFrame:
        return reports.largest_dirs(self.nodes, top, under)

    def dupes(self, contents: DataFrame, min_size: int = 1 << 20, top: int = 50, under: str | None = None) -> DataFrame:
        return dupes.whole_groups(self.nodes, contents, top, min_size=min_size, under=under)

    def status(self) -> DataFrame:
        return reports.status(self.nodes, self.volumes)

    def rescan(self, entries: DataFrame, excluded: list[str] = ()) -> Engine:
        epoch = (self.nodes.agg(F.max("epoch")).first()[0] or 0) + 1
        return Engine(build_nodes(entries, list(excluded), epoch), self.volumes, excluded)

    def save(self, path: str) -> dict:
        return snapshot.save(self.nodes, self.volumes, path, self.excluded)

    watch = staticmethod(watch)
