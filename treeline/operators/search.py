"""Search and browse over the node table: filters, relevance, order and pages, all as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from treeline.functions import text as T

MAX_TEXT, MAX_ROWS = 64 << 10, 1_000_000
SORTS = ("name", "size", "modified")
MODES = ("substring", "prefix", "glob")


class ScopeNotFound(LookupError):
    """The directory to search under is not in the index."""


@dataclass(frozen=True)
class SearchArgs:
    text: str = ""
    mode: str = "substring"
    case_sensitive: bool = False
    ext: str | None = None
    min_size: int | None = None
    max_size: int | None = None
    dirs_only: bool = False
    files_only: bool = False
    under: str | None = None
    include_excluded: bool = False
    sort: str = "name"
    offset: int = 0
    limit: int = 0
    children_of: int | None = None

    def __post_init__(self):
        if len(self.text.encode()) > MAX_TEXT or not 0 <= self.limit <= MAX_ROWS or self.offset < 0 or self.sort not in SORTS or self.mode not in MODES:
            raise ValueError("request out of limits")


def lookup(nodes: DataFrame, path: str) -> DataFrame:
    """The live node at a path (`C:\\a\\b` or with slashes), the lowest id if several; none: no row."""
    parts = T.segments(path.strip())
    if not parts or not T.has_drive(parts[0]) or len(parts[0]) != 2:
        return nodes.limit(0)
    key = T.fold_text("\n".join([".", *parts[1:]]))
    found = nodes.filter((F.col("drive") == parts[0][0].upper()) & (F.col("path_fold") == key) & ~F.col("is_deleted"))
    return found.orderBy("node_id").limit(1)


def scope(nodes: DataFrame, path: str) -> int:
    found = lookup(nodes, path).select("node_id").first()
    if found is None:
        raise ScopeNotFound(path)
    return found["node_id"]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def text_matches(args: SearchArgs) -> Column:
    name, path = (F.col("name"), F.col("path_names")) if args.case_sensitive else (F.col("name_fold"), F.col("path_fold"))
    folded = (lambda s: s) if args.case_sensitive else T.fold_text
    if args.mode == "prefix":
        return name.startswith(folded(args.text)) if args.text else F.lit(True)
    if args.mode == "glob":
        return T.glob_matches(F.col("name"), args.text, args.case_sensitive) if args.text else F.lit(True)
    words = T.terms(args.text)
    if len(words) == 1:
        return name.contains(folded(words[0]))
    return _all([path.contains(folded(w)) for w in words])


def matches(nodes: DataFrame, args: SearchArgs, under: int | None = None) -> DataFrame:
    """All nodes that pass the text and the filters."""
    keep = [~F.col("is_deleted"), ~F.col("is_root"), text_matches(args)]
    if not args.include_excluded:
        keep += [~F.col("is_excluded"), ~F.col("is_metadata")]
    if args.dirs_only:
        keep.append(F.col("is_dir"))
    if args.files_only:
        keep.append(~F.col("is_dir"))
    if args.children_of is not None:
        keep.append(F.col("parent_id") == args.children_of)
    if args.min_size is not None:
        keep.append(F.col("size") >= args.min_size)
    if args.max_size is not None:
        keep.append(F.col("size") <= args.max_size)
    if args.ext is not None:
        keep.append(T.extension_is(F.col("name_fold"), args.ext))
    if under is not None:
        keep.append(F.array_contains("ancestors", F.lit(under).cast("long")))
    return nodes.filter(_all(keep))


def rank(text: str) -> Column:
    """0: the name is one of the terms; 1: it starts with one; 2: other. Always ASCII-folded."""
    words = [T.fold_text(w) for w in T.terms(text)]
    if not words:
        return F.lit(0)
    either = lambda test: reduce(lambda a, b: a | b, map(test, words))
    return F.when(either(lambda w: F.col("name_fold") == w), 0).when(either(lambda w: F.col("name_fold").startswith(w)), 1).otherwise(2)


def ordering(args: SearchArgs) -> list[Column]:
    by = {"name": [F.col("name_fold"), F.col("depth")], "size": [F.desc("size")], "modified": [F.desc("mtime_unix")]}
    return [F.col("rank"), *by[args.sort], F.col("node_id")]


def page(found: DataFrame, args: SearchArgs) -> DataFrame:
    d = found.withColumn("rank", rank(args.text)).orderBy(*ordering(args))
    d = d.offset(args.offset) if args.offset else d
    return d.limit(args.limit) if args.limit else d


def result_rows(nodes: DataFrame, own: Column | None = None) -> DataFrame:
    return nodes.select("path", "size", F.col("mtime_unix").alias("mtime"), "is_dir", F.col("subtree_files").alias("files"), (F.lit(0) if own is None else own).cast("long").alias("own"))


def resolve(nodes: DataFrame, args: SearchArgs) -> tuple[DataFrame, SearchArgs]:
    """All matches of a request, paths read as browsing, and the request that gave them.

    A path browses its directory by the name's prefix if the directory is there, else its names are terms. Where that
    finds nothing, the last name is searched instead, within the same scope and filters.
    """
    under = scope(nodes, args.under) if args.under else None
    if args.mode != "substring" or not T.looks_like_path(args.text):
        return matches(nodes, args, under), args
    found, place = None, T.split_browse(args.text)
    home = lookup(nodes, place[0]).filter("is_dir").select("node_id").first() if place else None
    if home is not None:
        asked = replace(args, text=place[1], mode="prefix", children_of=home["node_id"])
    else:
        asked = replace(args, text=T.path_terms(args.text))
        if not asked.text:  # a drive that is not there, or separators alone
            return nodes.limit(0), asked
    found = matches(nodes, asked, under)
    if (home is not None or T.has_drive(args.text)) and found.isEmpty():
        asked = replace(args, text=T.last_segment(args.text), children_of=None)
        found = matches(nodes, asked, under)
    return found, asked


def search(nodes: DataFrame, args: SearchArgs) -> DataFrame:
    """The page of result rows, best first."""
    found, asked = resolve(nodes, args)
    return result_rows(page(found, asked))


def counted_page(found: DataFrame, args: SearchArgs, columns: list) -> tuple[list, int]:
    """(rows of a bounded page, number of all matches), both from one pass over the matches; no more than offset and limit rows reach the driver."""
    seen = Observation()
    rows = page(found.observe(seen, F.count(F.lit(1)).alias("total")), args).select(*columns).collect()
    return rows, seen.get["total"]


def total(nodes: DataFrame, args: SearchArgs) -> int:
    return resolve(nodes, args)[0].count()


def complete(nodes: DataFrame, partial: str) -> tuple[str, int]:
    """(a path's completion, number of candidates): the longest common prefix of the names in its directory that begin as it ends; with a separator after the only one, if that is a directory."""
    place = T.split_browse(partial)
    home = lookup(nodes, place[0]).filter("is_dir").select("node_id").first() if place else None
    if home is None:
        return partial, 0
    found = matches(nodes, SearchArgs(text=place[1], mode="prefix", children_of=home["node_id"], include_excluded=True))
    # the least and the greatest name share what all share
    r = found.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("name_fold", "name", "is_dir")).alias("a"), F.max(F.struct("name_fold", "name")).alias("b")).first()
    if not r["n"]:
        return partial, 0
    shared = T.common_prefix([r["a"]["name"], r["b"]["name"]])
    return place[0] + shared + ("\\" if r["n"] == 1 and r["a"]["is_dir"] else ""), r["n"]


def drill_down(path: str, is_dir: bool, typed: str) -> str:
    """What a result row puts into the query: a directory's path with a separator; a file's directory, and the file itself once that is typed."""
    if is_dir:
        return path + "\\"
    home = T.parent_dir(path) + "\\"
    return path if typed == home else home


def window(total: int, start: int, visible: int) -> tuple[int, int]:
    """(first, end) of the rows shown: the start held within what is there."""
    first = max(0, min(start, total - visible))
    return first, min(total, first + visible)
