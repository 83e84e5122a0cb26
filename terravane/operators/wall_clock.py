"""Mixed timestamp texts to one instant.

Each text is tokenised into its shape mask: digits become 9, letters a, everything else stays. A mask
fixes where every part of the date stands, so each distinct mask is mapped to a parser (the slices of
its parts) once and all texts of that mask are converted together, as matrices of code points.

Local readings go through transition tables of the named zones: instants at which the offset changes
and the offsets between them, built once for each zone and version of the zone data. A reading that
falls into the repeated hour has two candidates. Which one holds is decided over the whole sequence of
its source: every mark votes for the recording starts (instant minus position on the recording's own
axis) that its candidates imply, and the start with most votes is the recording's.

Defined results: null, empty and unreadable texts, unset clocks (before ``EARLIEST``), local readings
without a usable clock or offset, unknown zone names, and repeated-hour readings whose sequence leaves
both candidates possible give no row. A local reading that a forward change skips is read with the
offset before the change. Repeated rows count once. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.operators.blocks import finite
from terravane.session import cut_lineage

EARLIEST = 1420070400000  # 2015-01-01 in Unix milliseconds
GPS_EPOCH = 315964800000
GPS_AHEAD = 18000  # of UTC since 2017

#: Hours east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "IST": 5.5, "JST": 9, "ACST": 9.5, "AEST": 10, "LHST": 10.5, "ACDT": 10.5, "AEDT": 11, "LHDT": 11, "NZST": 12, "NZDT": 13,
    "NST": -3.5, "NDT": -2.5, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

_TIME = r"(?P<H>99?):(?P<M>99):(?P<S>99)(?:[.,](?P<f>9+))?"
_ZONE = r"(?: ?(?P<x>a+))?(?P<o> ?[+-]99:?99)?"
FAMILIES = [
    ("iso", rf"(?P<Y>9999)-(?P<m>99)-(?P<d>99)[a ]{_TIME}{_ZONE}"),
    ("ordinal", rf"(?P<Y>9999)-(?P<j>999)[a ]{_TIME}{_ZONE}"),
    ("basic", rf"(?P<Y>9999)(?P<m>99)(?P<d>99)a(?P<H>99)(?P<M>99)(?P<S>99)(?:[.,](?P<f>9+))?{_ZONE}"),
    ("year_first", rf"(?P<Y>9999)[/.](?P<m>99?)[/.](?P<d>99?) {_TIME}{_ZONE}"),
    ("year_last", rf"(?P<d>99?)[/.-](?P<m>99?)[/.-](?P<Y>9999) {_TIME}{_ZONE}"),
    ("month_first", rf"(?P<b>a+)\.? (?P<d>99?), (?P<Y>9999),? {_TIME}{_ZONE}"),
    ("month_name", rf"(?P<d>99?) (?P<b>a+) (?P<Y>9999) {_TIME}{_ZONE}"),
    ("unix_s", r"(?P<u>9{10})(?:\.(?P<f>9+))?"),
    ("unix_ms", r"(?P<u>9{13})"),
    ("unix_us", r"(?P<u>9{16})"),
    ("gps_week", r"(?:[a ]+|a+=)?(?P<w>9{3,4})(?: a+ |;a+=| )(?P<t>9{1,6})(?:\.(?P<f>9+))?(?: a+)?"),
]
PATTERNS = [(name, re.compile(pattern)) for name, pattern in FAMILIES]
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


@lru_cache(maxsize=100_000)
def parser_of(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """Family and slices of a mask; None where no date has that shape."""
    for name, pattern in PATTERNS:
        if found := pattern.fullmatch(mask):
            return name, {k: found.span(k) for k, v in found.groupdict().items() if v is not None}
    return None


def masks_of(texts: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Code points (rows of equal width), the distinct masks, and the mask number of each row."""
    points = texts.view(np.uint32).reshape(len(texts), -1)
    shape = points.copy()
    shape[(points >= 48) & (points <= 57)] = 57
    letters = ((points | 32) >= 97) & ((points | 32) <= 122) | (points >= 0xC0)
    shape[letters] = 97
    width = points.shape[1]
    distinct, inverse = np.unique(np.ascontiguousarray(shape).view(f"V{4 * width}").ravel(), return_inverse=True)
    names = [bytes(x).decode("utf-32-le").rstrip("\0") for x in distinct]
    return points, names, inverse


def _whole(points: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(points), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (points[:, i].astype(np.int64) - 48)
    return out


def _words(points: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = np.ascontiguousarray(points[:, span[0] : span[1]])
    return part.view(f"U{span[1] - span[0]}").ravel()


def _mapped(words: np.ndarray, table: dict, default: float) -> np.ndarray:
    distinct, inverse = np.unique(words, return_inverse=True)
    return np.array([table.get(str(w), default) for w in distinct], dtype=float)[inverse]


def _fraction_ms(points: np.ndarray, span: tuple[int, int] | None) -> np.ndarray:
    if span is None:
        return np.zeros(len(points), dtype=np.int64)
    span = (span[0], min(span[1], span[0] + 9))
    digits = span[1] - span[0]
    return np.floor(_whole(points, span) * 10.0 ** (3 - digits) + 0.5).astype(np.int64)


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of Gregorian dates."""
    months = (y - 1970) * 12 + (m - 1)
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


#: Kinds of parsed readings.
NONE, ABSOLUTE, LOCAL = 0, 1, 2


def parse(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Milliseconds and kind of each text: on UTC for ABSOLUTE, on the camera's clock for LOCAL.

    Texts of about the same length go together, so one very long text widens no other's row.
    """
    ms, kind = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int8)
    width = np.array([1 << max(4, (len(t) - 1).bit_length()) for t in texts], dtype=np.int64)
    for w in np.unique(width):
        rows, step = np.flatnonzero(width == w), max(1, MATRIX // int(w))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            ms[part], kind[part] = _parse_matrix(np.array([texts[k] for k in part], dtype=f"U{w}"))
    return ms, kind


#: Most code points in one matrix of texts, and the longest mask that is kept for the next batch.
MATRIX, KEPT_MASK = 4_000_000, 256


def _parse_matrix(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ms, kind = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int8)
    points, masks, inverse = masks_of(texts)
    order = np.argsort(inverse, kind="stable")
    bounds = np.searchsorted(inverse[order], np.arange(len(masks) + 1))
    for n, mask in enumerate(masks):
        parser = parser_of(mask) if len(mask) <= KEPT_MASK else parser_of.__wrapped__(mask)
        if parser is None:
            continue
        rows = order[bounds[n] : bounds[n + 1]]
        ms[rows], kind[rows] = _convert(points[rows], *parser)
    return ms, kind


def _convert(p: np.ndarray, family: str, at: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    fraction = _fraction_ms(p, at.get("f"))
    if family.startswith("unix"):
        value = _whole(p, at["u"])
        value = {"unix_s": value * 1000 + fraction, "unix_ms": value, "unix_us": (value + 500) // 1000}[family]
        return value, np.full(len(p), ABSOLUTE, dtype=np.int8)
    if family == "gps_week":
        tow = _whole(p, at["t"]) * 1000 + fraction
        value = GPS_EPOCH + _whole(p, at["w"]) * 604_800_000 + tow - GPS_AHEAD
        return value, np.where(tow < 604_800_000, ABSOLUTE, NONE).astype(np.int8)
    year = _whole(p, at["Y"])
    hour, minute, second = (_whole(p, at[k]) for k in "HMS")
    ok = (year >= 1) & (hour <= 24) & (minute < 60) & (second <= 60)
    half = np.zeros(len(p), dtype=np.int8)
    offset = np.full(len(p), np.nan)
    if "x" in at:
        words = np.char.upper(_words(p, at["x"]))
        half = np.where(words == "AM", 1, np.where(words == "PM", 2, 0))
        offset = _mapped(words, ABBREVIATIONS, np.inf) * 3_600_000
        offset[half > 0] = np.nan
        ok &= ~np.isinf(offset)
    if "o" in at:
        low, high = at["o"]
        low += int((p[0, low] == 32))
        sign = np.where(p[:, low] == 45, -1, 1)
        offset = sign * (_whole(p, (low + 1, low + 3)) * 60 + _whole(p, (high - 2, high))) * 60_000.0
    if "j" in at:
        day_no = _whole(p, at["j"])
        days = days_from_civil(year, np.ones_like(year), day_no)
        ok &= (day_no >= 1) & (day_no <= 366)
    else:
        day = _whole(p, at["d"])
        month = _mapped(np.char.lower(_words(p, (at["b"][0], min(at["b"][0] + 3, at["b"][1])))), MONTHS, 0).astype(np.int64) if "b" in at else _whole(p, at["m"])
        if family == "year_last":
            # with AM or PM the month comes first, else the day; a part above 12 decides against it
            swap = ((half > 0) & (day <= 12)) | (month > 12)
            day, month = np.where(swap, month, day), np.where(swap, day, month)
        ok &= (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)
        days = days_from_civil(year, np.clip(month, 1, 12), day)
    hour = np.where(half == 1, hour % 12, np.where(half == 2, hour % 12 + 12, hour))
    value = days * 86_400_000 + ((hour * 60 + minute) * 60 + second) * 1000 + fraction
    zoned = ~np.isnan(offset) & ~np.isinf(offset)
    value = np.where(zoned, value - np.where(zoned, offset, 0), value).astype(np.int64)
    return value, np.where(ok, np.where(zoned, ABSOLUTE, LOCAL), NONE).astype(np.int8)


def zone_data_version() -> str:
    """Version of the zone data that the tables are built from."""
    for folder in TZPATH:
        try:
            with open(f"{folder}/tzdata.zi", encoding="utf-8") as f:
                return f.readline().removeprefix("# version").strip()
        except OSError:
            continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=1000)
def zone_table(name: str, version: str, first: int = 2000, last: int = 2100) -> tuple[np.ndarray, np.ndarray] | None:
    """Transitions (Unix ms) of a zone and the offsets (ms) between them; None for unknown names."""
    try:
        zone = ZoneInfo(name)
    except Exception:  # noqa: BLE001 - whatever the zone data cannot open is no zone
        return None

    def offset(s: int) -> int:
        return int(datetime.fromtimestamp(s, timezone.utc).astimezone(zone).utcoffset() / timedelta(milliseconds=1))

    at = int(datetime(first, 1, 1, tzinfo=timezone.utc).timestamp())
    end = int(datetime(last, 1, 1, tzinfo=timezone.utc).timestamp())
    changes, offsets = [], [offset(at)]
    while at < end:
        after = at + 20 * 86_400
        if offset(after) != offsets[-1]:
            low, high = at, after
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == offsets[-1] else (low, middle)
            changes.append(high * 1000)
            offsets.append(offset(high))
        at = after
    return np.array(changes, dtype=np.int64), np.array(offsets, dtype=np.int64)


CLOCK = re.compile(r"(?:(?:UTC|GMT)\s*)?([+-])(\d\d?):?(\d\d)?")


def clock_rule(clock: str) -> tuple[str, object] | None:
    """("gps", ms), ("fixed", ms east) or ("zone", name) of a clock text; None where it names none."""
    text = " ".join(clock.split())
    upper = text.upper()
    if upper in ("GPS", "GPST", "GPS TIME", "GPSTIME"):
        return "fixed", GPS_AHEAD
    if upper in ABBREVIATIONS:
        return "fixed", int(ABBREVIATIONS[upper] * 3_600_000)
    if found := CLOCK.fullmatch(upper):
        sign = -1 if found[1] == "-" else 1
        return "fixed", sign * (int(found[2]) * 60 + int(found[3] or 0)) * 60_000
    if text and zone_table(text, zone_data_version()) is not None:
        return "zone", text
    return None


def to_utc(local: np.ndarray, clock: str) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of local readings on a clock; the second is -1 where there is none, both without clock."""
    none = np.full(len(local), -1, dtype=np.int64)
    rule = clock_rule(clock)
    if rule is None:
        return none, none
    if rule[0] == "fixed":
        return local - rule[1], none
    changes, offsets = zone_table(rule[1], zone_data_version())
    at = lambda u: offsets[np.searchsorted(changes, u, side="right")]
    before, after = at(local - 86_400_000), at(local + 86_400_000)
    early, late = local - before, local - after
    early_ok, late_ok = at(early) == before, at(late) == after
    first = np.where(early_ok | ~late_ok, early, late)
    second = np.where(early_ok & late_ok & (early != late), late, -1)
    return first, second


def candidates(marks: DataFrame, clocks: DataFrame, mark: str, source: str, event: str, text: str, clock: str, offset: str) -> DataFrame:
    """(mark, source, event, first_ms, second_ms) for each readable mark."""
    known = clocks.where(F.col(source).isNotNull() & F.col(clock).isNotNull() & finite(offset)).groupBy(F.col(source).alias("s")).agg(
        F.min(F.struct(F.col(clock).alias("clock"), F.round(F.col(offset).cast("double") * 1000).cast("long").alias("offset_ms"))).alias("c")
    )
    # white space that SQL's trim leaves, such as tabs, is removed too
    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    rows = marks.where(F.col(mark).isNotNull() & F.col(text).isNotNull()).select(
        F.col(mark).cast("long").alias("mark"), F.col(source).cast("string").alias("s"), F.col(event).cast("long").alias("event"), trimmed.alias("text")
    )
    rows = rows.where(F.length("text") > 0).distinct()
    joined = rows.join(known, "s", "left").select("mark", F.col("s").alias("source"), "event", "text", F.col("c.clock").alias("clock"), F.col("c.offset_ms").alias("offset_ms"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ms, kind = parse(batch.column(3).to_pylist())
            second = np.full(len(ms), -1, dtype=np.int64)
            clocks_of = batch.column(4).dictionary_encode()
            code = clocks_of.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            shift = batch.column(5).fill_null(0).to_numpy(zero_copy_only=False)
            local = kind == LOCAL
            kind[local & (code < 0)] = NONE
            for n, name in enumerate(clocks_of.dictionary.to_pylist()):
                rows = np.flatnonzero(local & (code == n))
                if len(rows):
                    ms[rows], second[rows] = to_utc(ms[rows] + shift[rows], name)
            keep = pa.array((kind != NONE) & (ms >= EARLIEST))
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(ms), pa.array(second, mask=second < 0)], names=["mark", "source", "event", "first_ms", "second_ms"]
            )
            yield out.filter(keep)

    return joined.mapInArrow(work, "mark bigint, source string, event bigint, first_ms bigint, second_ms bigint")


def instants(
    marks: DataFrame, clocks: DataFrame, positions: DataFrame, mark: str, source: str, event: str, text: str, clock: str, offset: str, time: str, tolerance_s: float = 2.0
) -> DataFrame:
    """(mark, utc_ms) for each mark whose instant is determined.

    ``positions`` gives the position ``time`` (seconds on the recording's own axis) of each event of a
    source; it is needed for sources with doubtful marks only. ``tolerance_s`` is how far two marks may
    differ from the advance of their positions. The candidates, a row of five numbers for each readable
    mark, are kept in one checkpoint, so each text is parsed once.
    """
    read = cut_lineage(candidates(marks, clocks, mark, source, event, text, clock, offset))
    flagged = read.groupBy("source").agg(F.max(F.col("second_ms").isNotNull()).alias("doubtful")).where("doubtful").select("source")
    sure = read.where(F.col("second_ms").isNull()).select("mark", F.col("first_ms").alias("utc_ms"))
    asked = read.join(flagged, "source", "left_semi")
    places = positions.where(F.col(source).isNotNull() & F.col(event).isNotNull() & finite(time)).select(
        F.col(source).cast("string").alias("source"), F.col(event).cast("long").alias("event"), (F.col(time).cast("double") * 1000).alias("at")
    )
    placed = asked.hint("shuffle_hash").join(places, ["source", "event"]).groupBy("mark", "source", "first_ms", "second_ms").agg(F.min("at").alias("at"))
    votes = placed.select("mark", "source", F.col("second_ms").isNotNull().alias("open"), F.explode(F.array("first_ms", "second_ms")).alias("utc_ms"), "at").where("utc_ms IS NOT NULL")
    begin = votes.withColumn("begin", F.col("utc_ms") - F.col("at"))
    # starts within the tolerance fall into one of two overlapping bins
    width = F.lit(2000.0 * tolerance_s)
    binned = begin.withColumn("bin", F.explode(F.array(F.floor(F.col("begin") / width) * 2, F.floor(F.col("begin") / width + 0.5) * 2 + 1)))
    counted = binned.groupBy("source", "bin").agg(F.count_distinct("mark").alias("n"), F.avg("begin").alias("begin"))
    best = counted.groupBy("source").agg(F.max("n").alias("most"), F.max_by("begin", "n").alias("start"))
    # of the starts with most votes all must be one, else the source leaves its marks undecided
    ties = (
        counted.join(best, "source")
        .where((F.col("n") == F.col("most")) & (F.abs(F.col("begin") - F.col("start")) > width))
        .select("source")
        .distinct()
    )
    settled = best.join(ties, "source", "left_anti").select("source", "start")
    decided = (
        begin.where("open")
        .join(settled, "source")
        .where(F.abs(F.col("begin") - F.col("start")) <= width)
        .groupBy("mark")
        .agg(F.min_by("utc_ms", F.abs(F.col("begin") - F.col("start"))).alias("utc_ms"))
    )
    return sure.unionByName(decided).select(F.col("mark").alias(mark), "utc_ms")
