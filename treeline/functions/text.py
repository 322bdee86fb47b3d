"""Text, size and time functions as column expressions, and the driver-side reading of query text."""

from __future__ import annotations

import re
import string
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
_FOLD = str.maketrans(UPPER, LOWER)
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def fold(c: Column) -> Column:
    """ASCII letters in lower case; all else as it is."""
    return F.translate(c, UPPER, LOWER)


def fold_text(s: str) -> str:
    return s.translate(_FOLD)


def terms(text: str) -> list[str]:
    """Words between white space; the information separators U+001C to U+001F don't part words."""
    return [x for x in re.split(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text) if x]


def extension_is(name_fold: Column, ext: str) -> Column:
    """The text after the last dot is ext."""
    return name_fold.contains(".") & (F.substring_index(name_fold, ".", -1) == fold_text(ext))


def glob_matches(name: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """The whole name matches: `*` any bytes, `?` one byte. Names are seen as one character for each byte."""
    if not case_sensitive:
        name, pattern = fold(name), fold_text(pattern)
    longest = max(re.split(r"[*?]", pattern), key=len)  # names without it need no closer look
    view = pattern.encode().decode("latin-1")
    rx = "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([\\.^$|()\[\]{}+])", r"\\\1", c) for c in view)
    return name.contains(longest) & F.decode(F.encode(name, "UTF-8"), "ISO-8859-1").rlike(f"(?s)^{rx}\\z")


def looks_like_path(text: str) -> bool:
    return has_drive(text) or "\\" in text or "/" in text


def has_drive(text: str) -> bool:
    return bool(re.match(r"[A-Za-z]:", text))


def segments(text: str) -> list[str]:
    return [x for x in re.split(r"[\\/]", text) if x]


def path_terms(path: str) -> str:
    """The names in a path, its drive left out, as a multi-term query."""
    return " ".join(y for x in segments(path) if not re.fullmatch(r"[A-Za-z]:", x) and (y := x.strip()))


def last_segment(text: str) -> str:
    return segments(text)[-1] if segments(text) else text


def split_browse(text: str) -> tuple[str, str] | None:
    """(directory, name prefix) of a path at its last separator."""
    at = max(text.rfind("\\"), text.rfind("/"))
    return (text[: at + 1], text[at + 1 :]) if at >= 0 else None


def parent_dir(path: str) -> str:
    return path[: max(path.rfind("\\"), path.rfind("/"), 0)]


def common_prefix(names: list[str]) -> str:
    """Longest common prefix by ASCII-folded comparison, spelled as in the first name."""
    if not names:
        return ""
    n = min(map(len, names))
    k = next((i for i in range(n) if len({fold_text(x[i]) for x in names}) > 1), n)
    return names[0][:k]


def parse_size(text: str) -> int | None:
    """`10`, `500K`, `2.5M`, `4 GB`, `1,000`: bytes, by powers of 1024; None if it is no size."""
    m = re.fullmatch(r"\s*(\d[\d,]*(?:\.\d*)?|\.\d+)\s*([KMGT]?)B?\s*", text.upper())
    return int(float(m[1].replace(",", "")) * 1024 ** " KMGT".index(m[2] or " ")) if m else None


def size_text(n: Column, largest: str = UNITS[-1]) -> Column:
    """`512 B`, `1.50 KB`, `15.0 MB`, `150 GB`; ties go to the even digit, and what is beyond the largest unit is shown in it."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS[1 : UNITS.index(largest) + 1], 1):
        x = n / F.lit(float(1024**k))
        shown = F.when(x >= 100, F.format_string("%.0f", F.bround(x, 0))).when(x >= 10, F.format_string("%.1f", F.bround(x, 1))).otherwise(F.format_string("%.2f", F.bround(x, 2)))
        out = F.when(n >= 1024**k, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def count_text(n: Column) -> Column:
    return F.format_number(n, 0)


def time_text(unix: Column) -> Column:
    """`YYYY-MM-DD HH:MM` in UTC; `-` for 0."""
    # in UTC whatever the session's zone
    return F.when(unix == 0, "-").otherwise(F.date_format(F.to_utc_timestamp(F.timestamp_seconds(unix), F.current_timezone()), "yyyy-MM-dd HH:mm"))


def duration_text(seconds: Column) -> Column:
    part = lambda k, u: F.concat(F.floor(seconds / k).cast("string"), F.lit(u))
    return F.when(seconds < 60, part(1, "s")).when(seconds < 3600, part(60, "m")).when(seconds < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def now_unix() -> int:
    return int(datetime.now(UTC).timestamp())


TICKS = 10_000_000
#: Ticks from 1601 to 1970.
EPOCH = 11644473600 * TICKS


def unix_of_filetime(ft: Column) -> Column:
    """Seconds since 1970 of 100 ns ticks since 1601, integers of any width; 0 and 2**32-1 bound it."""
    ticks = F.least(F.greatest(ft, F.lit(EPOCH)), F.lit(EPOCH + (2**32 - 1) * TICKS)).cast("long")
    return F.call_function("div", ticks - EPOCH, F.lit(TICKS))  # whole numbers throughout: a double holds no ticks of our days


def file_record(ref: Column) -> Column:
    return ref.bitwiseAND(F.lit(0xFFFFFFFFFFFF))


def file_sequence(ref: Column) -> Column:
    return F.shiftrightunsigned(ref, 48).cast("int")


def heat(size: Column) -> Column:
    return F.when(size >= 1 << 30, "huge").when(size >= 400 << 20, "large").when(size >= 100 << 20, "medium").otherwise("none")


def parse_version(text: str) -> tuple[int, int, int] | None:
    m = re.fullmatch(r"v?(\d+)\.(\d+)\.(\d+)", text)
    return tuple(map(int, m.groups())) if m else None


HITS = "array<struct<line:int,col:int>>"


def _hits(text: str | None, needle: str) -> list[tuple[int, int]]:
    out, width = [], len(needle)
    for i, line in enumerate(fold_text(text or "").split("\n")) if needle else ():
        at = line.find(needle)
        while at >= 0:
            out.append((i, at))
            at = line.find(needle, at + width)
    return out


def find_hits(text: Column, needle: str) -> Column:
    """Non-overlapping ASCII-folded hits in reading order: array of (line, column), both from 0, columns in characters."""
    wanted = fold_text(needle)

    @F.pandas_udf(HITS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"line": i, "col": k} for i, k in _hits(t, wanted)])

    return found(text)


def hit_count(text: Column, needle: str) -> Column:
    """The number of those hits."""
    return F.regexp_count(fold(text), F.lit(re.sub(r"([^A-Za-z0-9\s])", r"\\\1", fold_text(needle)))) if needle else F.lit(0)


def next_hit(hits: Column, line: int, col: int) -> Column:
    """The first hit at or after a place, else the first of all."""
    after = F.filter(hits, lambda h: (h["line"] > line) | ((h["line"] == line) & (h["col"] >= col)))
    return F.coalesce(F.get(after, F.lit(0)), F.get(hits, F.lit(0)))


def previous_hit(hits: Column, line: int, col: int) -> Column:
    """The last hit before a place, else the last of all."""
    before = F.filter(hits, lambda h: (h["line"] < line) | ((h["line"] == line) & (h["col"] < col)))
    return F.coalesce(F.get(before, F.size(before) - 1), F.get(hits, F.size(hits) - 1))


def tally(hits: Column, hit: Column) -> Column:
    """`n/m`: the hit's place among all, from 1; `0/0` without hits."""
    return F.when(F.size(hits) > 0, F.concat(F.array_position(hits, hit).cast("string"), F.lit("/"), F.size(hits).cast("string"))).otherwise("0/0")


def hits_on_line(hits: Column, line: int) -> Column:
    return F.transform(F.filter(hits, lambda h: h["line"] == line), lambda h: h["col"])


def _ranges(text: str | None, words: list[str]) -> list[tuple[int, int]]:
    folded, found = fold_text(text or ""), []
    for w in words:
        at = folded.find(w)
        while at >= 0:
            found.append((at, at + len(w)))
            at = folded.find(w, at + len(w))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def highlight_ranges(text: Column, query: str) -> Column:
    """Where a text holds the query's terms: (start, end) in characters, of overlapping and adjacent ones together; empty terms and those longer than the text say nothing."""
    words = [fold_text(w) for w in terms(query)]

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in _ranges(t, words)])

    return found(text)


def register_functions(spark) -> None:
    """The engine's own functions for SQL: glob_match, looks_like_path, parse_size, and the table functions find_hits and highlight_ranges."""
    from pyspark.sql.functions import pandas_udf, udtf

    @pandas_udf("boolean")
    def glob_match(names: pd.Series, patterns: pd.Series) -> pd.Series:
        return pd.Series([_glob(n, p) for n, p in zip(names, patterns)])

    spark.udf.register("glob_match", glob_match)
    @pandas_udf("boolean")
    def path_like(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and looks_like_path(t))

    @pandas_udf("long")
    def size_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parse_size(t) if t is not None else None).astype("Int64")

    spark.udf.register("looks_like_path", path_like)
    spark.udf.register("parse_size", size_of)

    class FindHits:
        def eval(self, text: str, needle: str):
            yield from _hits(text, fold_text(needle or ""))

    class HighlightRanges:
        def eval(self, text: str, query: str):
            yield from _ranges(text, [fold_text(w) for w in terms(query or "")])

    spark.udtf.register("find_hits", udtf(FindHits, returnType="line int, col int"))
    spark.udtf.register("highlight_ranges", udtf(HighlightRanges, returnType="start int, end int"))


def _glob(name: str | None, pattern: str | None) -> bool | None:
    if name is None or pattern is None:
        return None
    rx = b"".join(b".*" if c == 42 else b"." if c == 63 else re.escape(bytes([c])) for c in fold_text(pattern).encode())
    return re.fullmatch(rx, fold_text(name).encode(), re.S) is not None


def auto_mode(text: str) -> str:
    """The mode that an interactive query is read in: a glob if it has a wildcard."""
    return "glob" if "*" in text or "?" in text else "substring"


def line_endings(text: Column) -> Column:
    """`crlf`, `lf` or `none`, the commoner; equal: lf."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    lf = F.regexp_count(text, F.lit("\n")) - crlf
    return F.when(crlf + lf == 0, "none").when(crlf > lf, "crlf").otherwise("lf")


def endings_of_lines(text: Column) -> Column:
    """`crlf`, `lf` or, for a last line without an end, `none`, for each line."""
    parts = F.split(text, "\n", -1)
    last = F.size(parts) - 1
    each = F.transform(parts, lambda x, i: F.when(i == last, "none").when(x.endswith("\r"), "crlf").otherwise("lf"))
    return F.filter(each, lambda x, i: (i < last) | (F.element_at(parts, -1) != ""))


def ends_with_newline(text: Column) -> Column:
    return text.endswith("\n")


def read_range(content: Column, offset: int, n: int) -> Column:
    """Up to n bytes of a content from an offset on."""
    return F.substring(content, offset + 1, n)


def drive_selectable(filesystem: Column) -> Column:
    """Only volumes of this file system can be read."""
    return F.coalesce(fold(filesystem) == "ntfs", F.lit(False))


def text_class(content: Column) -> Column:
    """`utf-32`, `utf-16`, `binary`, `invalid`, `control`, `too long` or `text` for the bytes of a file."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    valid = F.is_valid_utf8(content)
    text = F.when(valid, F.decode(content, "UTF-8"))
    controls = F.regexp_count(text, F.lit(r"[\x01-\x08\x0B\x0E-\x1F\x7F]"))
    return (
        F.when(F.octet_length(content) > 100 << 20, "too long")
        .when(head(4).isin("FFFE0000", "0000FEFF"), "utf-32").when(head(2).isin("FFFE", "FEFF"), "utf-16")
        .when(F.contains(content, F.lit(b"\0")), "binary").when(~valid, "invalid")
        .when(controls > 0.003 * F.char_length(text), "control").when(F.regexp_count(text, F.lit("\n")) > 2_000_000, "too long")
        .when(F.array_max(F.transform(F.split(text, "\n", -1), lambda x: F.octet_length(x))) > 1 << 20, "too long").otherwise("text")
    )
