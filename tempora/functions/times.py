"""Time codes to milliseconds and back, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora import model as M

CLOCK = r"^[ \t]*(?:(\d+):)?(\d+):(\d+)(?:[.,](\d+))?(?:[^:.,\d]|$)"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once; a column used n times in an expression is otherwise worked out n times, and in one nested k deep n ** k times."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _int(x: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.concat(F.lit("0"), F.regexp_extract(x, pattern, group)).cast("bigint"), F.lit(0))


def fraction_ms(digits: Column) -> Column:
    """'5' is 500 ms, '50' 500, '500' 500; further digits are dropped."""
    return F.rpad(F.substring(digits, 1, 3), 3, "0").cast("bigint")


def parse_timestamp(x: Column) -> Column:
    """[h:]mm:ss[.,fraction] to ms; -1 if there is none or it is over a day."""
    ms = lambda x: (_int(x, CLOCK, 1) * 3600 + _int(x, CLOCK, 2) * 60 + _int(x, CLOCK, 3)) * 1000 + fraction_ms(F.regexp_extract(x, CLOCK, 4))
    return let(x, lambda x: F.when(F.regexp_extract(x, CLOCK, 0) == "", -1).otherwise(let(ms(x), lambda ms: F.when(ms > M.DAY_MS, -1).otherwise(ms))).cast("int"))


def frames_to_ms(frames: Column, fps: Column | float) -> Column:
    return F.floor(frames * 1000.0 / fps + 0.5).cast("int")


def ms_to_frames(ms: Column, fps: Column | float) -> Column:
    return F.floor(ms * fps / 1000.0 + 0.5).cast("int")


def tenths_to_ms(t: Column) -> Column:
    return (t * 100).cast("int")


def ms_to_tenths(ms: Column) -> Column:
    return F.floor((ms + 50) / 100).cast("int")


def clock(ms: Column, mark: str = ",", digits: int = 3, hours: int = 2) -> Column:
    """hh:mm:ss and a fraction of one to three digits (centiseconds are rounded); below zero is zero."""
    unit = 10 ** (3 - digits)
    per = 10**digits
    two = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def shown(t: Column) -> Column:
        h = F.floor(t / (3600 * per))
        return F.concat(F.when(h < 10**hours, two(h, hours)).otherwise(h.cast("string")), F.lit(":"), two(F.floor(t / (60 * per)) % 60, 2), F.lit(":"), two(F.floor(t / per) % 60, 2), F.lit(mark), two(t % per, digits))

    return let(F.floor((F.greatest(ms, F.lit(0)) + unit // 2) / unit).cast("bigint"), shown)


def timecode(ms: Column, fps: int, mark: str = ":") -> Column:
    """hh:mm:ss:ff, rounded to frames."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    shown = lambda f: F.concat_ws(":", two(F.floor(f / (3600 * fps))), two(F.floor(f / (60 * fps)) % 60), F.concat(two(F.floor(f / fps) % 60), F.lit(mark), two(f % fps)))
    return let(F.floor((F.greatest(ms, F.lit(0)) * fps + 500) / 1000).cast("bigint"), shown)


def timecode_ms(x: Column, fps: Column | int, separator: str = "[:;]") -> Column:
    p = rf"(\d+):(\d+):(\d+){separator}(\d+)"
    return let(x, lambda x: ((_int(x, p, 1) * 3600 + _int(x, p, 2) * 60 + _int(x, p, 3)) * 1000 + F.floor(_int(x, p, 4) * 1000.0 / fps + 0.5)).cast("int"))


def idx_ms(x: Column) -> Column:
    """hh:mm:ss:mmm"""
    p = r"(\d+):(\d+):(\d+):(\d+)"
    return let(x, lambda x: ((_int(x, p, 1) * 3600 + _int(x, p, 2) * 60 + _int(x, p, 3)) * 1000 + _int(x, p, 4)).cast("int"))


def scc_ms(x: Column) -> Column:
    """hh:mm:ss:ff with frames of 33 ms; null over a day."""
    p = r"(\d+):(\d+):(\d+)[:;](\d+)"
    ms = lambda x: (_int(x, p, 1) * 3600 + _int(x, p, 2) * 60 + _int(x, p, 3)) * 1000 + _int(x, p, 4) * 33
    return let(let(x, ms), lambda ms: F.when(ms <= M.DAY_MS, ms.cast("int")))


def scc_code(ms: Column, mark: str | Column = ":") -> Column:
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    shown = lambda t, s: F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit(mark) if isinstance(mark, str) else mark, two(F.least(F.lit(29), F.floor((t % 1000 + 16) / 33))))
    return let(F.greatest(ms, F.lit(0)), lambda t: shown(t, F.floor(t / 1000)))


def ttml_ms(x: Column, fps: Column | float = 30.0, ticks: Column | float = 1.0) -> Column:
    """Offsets (12.5s, 3h, 4m, 250ms, 10f, 99t) and clocks (hh:mm:ss[.fraction] or hh:mm:ss:frames); -1 if neither."""
    offset = r"^\s*(\d+(?:\.\d+)?)(h|ms|m|s|f|t)\s*$"
    return let(x, lambda x: let(F.regexp_extract(x, offset, 2), lambda unit: _ttml_ms(x, unit, offset, fps, ticks)))


def _ttml_ms(x: Column, unit: Column, offset: str, fps: Column | float, ticks: Column | float) -> Column:
    n = F.nullif(F.regexp_extract(x, offset, 1), F.lit("")).cast("double")
    scale = F.when(unit == "h", 3_600_000.0).when(unit == "m", 60_000.0).when(unit == "s", 1000.0).when(unit == "ms", 1.0).when(unit == "f", 1000.0 / fps).when(unit == "t", 1000.0 / ticks)
    return F.when(unit != "", F.floor(n * scale + 0.5)).when(x.rlike(r"^\s*\d+:\d+:\d+:\d+"), timecode_ms(x, fps)).when(x.rlike(r"^\s*\d+:\d+:\d+"), parse_timestamp(x)).otherwise(-1).cast("int")


def snap_ratio(x: Column, near: float = 0.004) -> Column:
    """The nearest known frame-rate ratio strictly within near, else x itself."""
    best = F.array_min(F.array(*[F.struct(F.abs(x - F.lit(r)).alias("d"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(M.RATIOS)]))
    return F.when(best["d"] < near, best["r"]).otherwise(x)
