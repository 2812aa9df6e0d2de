"""Sinks that rewrite: files with their times moved and everything else left as it was, format by format.

A time moves by ``Shift``: t * (1 + slope) + intercept, and the offset of the cue that it belongs to. A text file is cut
into pieces (lines; in markup, what begins at a tag), the pieces that hold a cue's times are numbered as the readers
number them, and the file is put together again from all pieces, line ends and a missing last one included. Binary files
are patched in place, one at a time, over Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora import model as M
from tempora.functions import times as T
from tempora.sources import binary

LINE, SYNC, PARAGRAPH = "\n", "(?i)(?=<sync)", r"(?=<(?:\w+:)?p\b)"


@dataclass(frozen=True)
class Shift:
    """slope and intercept hold for all files; offsets (path, cue_no, offset_ms) for single cues."""

    slope: float = 0.0
    intercept_s: float = 0.0
    offsets: DataFrame | None = None

    def apply(self, ms: Column) -> Column:
        return (F.round(ms * (1 + F.lit(self.slope)) + F.lit(self.intercept_s * 1000)).cast("int") + F.coalesce(F.col("offset_ms"), F.lit(0))).cast("int")

    def both(self, start: Column, end: Column) -> tuple[Column, Column]:
        """A start below zero slides the cue so that it begins at zero."""
        return F.greatest(self.apply(start), F.lit(0)), self.apply(end) + F.greatest(-self.apply(start), F.lit(0))

    def apply_one(self, ms: int, offset: int) -> int:
        x = ms * (1 + self.slope) + self.intercept_s * 1000
        return int(abs(x) + 0.5) * (1 if x >= 0 else -1) + offset

    def both_one(self, start: int, end: int, offset: int) -> tuple[int, int]:
        a, b = self.apply_one(start, offset), self.apply_one(end, offset)
        return (0, b - a) if a < 0 else (a, b)


def _w() -> Window:
    return Window.partitionBy("path").orderBy("piece_no")


def _pieces(texts: DataFrame, cut: str) -> DataFrame:
    return texts.select("path", F.posexplode(F.split("text", cut)).alias("piece_no", "piece"))


def _numbered(pieces: DataFrame, is_cue: Column) -> DataFrame:
    """cue_no: that of the latest cue piece, -1 before the first."""
    return pieces.withColumn("is_cue", F.coalesce(is_cue, F.lit(False))).withColumn("cue_no", F.sum(F.col("is_cue").cast("int")).over(_w()).cast("int") - 1)


def _written(pieces: DataFrame, new: Column, shift: Shift, between: str, changes: Column | None = None) -> DataFrame:
    """path, text, with new in place of those pieces of a cue for which it isn't null."""
    if shift.offsets is not None:
        pieces = pieces.join(shift.offsets.select("path", "cue_no", "offset_ms"), ["path", "cue_no"], "left")
    else:
        pieces = pieces.withColumn("offset_ms", F.lit(0))
    piece = F.when(F.col("is_cue") if changes is None else changes, F.coalesce(new, F.col("piece"))).otherwise(F.col("piece"))
    rows = pieces.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("piece_no", piece.alias("p")))).alias("all"))
    return rows.select("path", F.array_join(F.transform("all", lambda x: x["p"]), between).alias("text"))


def _return(x: str = "piece") -> Column:
    """The carriage return at a line's end, if there is one."""
    return F.regexp_extract(x, r"(\r?)$", 1)


def _bare(x: str = "piece") -> Column:
    return F.regexp_replace(x, r"\r$", "")


def _good(*ms: Column) -> Column:
    out = F.lit(True)
    for x in ms:
        out &= x >= 0
    return out


def srt(texts: DataFrame, shift: Shift, mark: str = ",") -> DataFrame:
    """Time lines, their settings kept; in VTT also the stamps <hh:mm:ss.mmm> within a cue's text."""
    p = _pieces(texts, LINE)
    p = _numbered(p, F.col("piece").contains("-->"))
    sides = F.split(_bare(), "-->", 2)
    start, end = T.parse_timestamp(sides[0]), T.parse_timestamp(F.get(sides, F.lit(1)))
    a, b = shift.both(start, end)
    line = F.when(_good(start, end), F.concat(T.clock(a, mark), F.lit(" --> "), T.clock(b, mark), F.regexp_extract(F.get(sides, F.lit(1)), r"^[ \t]*[^ \t]*(.*)$", 1), _return()))
    if mark == ",":
        return _written(p, line, shift, LINE)
    inner = F.split("piece", r"(?<=<)(?=\d+:\d+)|(?<=\d)(?=>)")  # text, stamp, text, ...
    stamped = F.array_join(F.transform(inner, lambda x: F.when(x.rlike(r"^\d+:\d+(:\d+)?([.,]\d+)?$") & (T.parse_timestamp(x) >= 0), T.clock(shift.apply(T.parse_timestamp(x)), ".")).otherwise(x)), "")
    return _written(p, F.when(F.col("is_cue"), line).otherwise(stamped), shift, LINE, F.col("is_cue") | ((F.col("cue_no") >= 0) & F.col("piece").rlike(r"<\d+:\d+")))


def vtt(texts: DataFrame, shift: Shift) -> DataFrame:
    return srt(texts, shift, ".")


def _pair(texts: DataFrame, shift: Shift, pattern: str, stamp: Callable[[Column], Column]) -> DataFrame:
    """Lines that hold nothing but two times with a comma between."""
    p = _numbered(_pieces(texts, LINE), _bare().rlike(pattern))
    start, end = (T.parse_timestamp(F.split(_bare(), ",")[i]) for i in (0, 1))
    a, b = shift.both(start, end)
    return _written(p, F.when(_good(start, end), F.concat(stamp(a), F.lit(","), stamp(b), _return())), shift, LINE)


def sbv(texts: DataFrame, shift: Shift) -> DataFrame:
    return _pair(texts, shift, r"^\s*\d+:\d\d:\d\d\.\d+,\d+:\d\d:\d\d\.\d+\s*$", lambda x: T.clock(x, "."))


def subviewer(texts: DataFrame, shift: Shift) -> DataFrame:
    return _pair(texts, shift, r"^\s*\d\d:\d\d:\d\d\.\d\d,\d\d:\d\d:\d\d\.\d\d\s*$", lambda x: T.clock(x, ".", 2))


def ass(texts: DataFrame, shift: Shift) -> DataFrame:
    """The time fields of Dialogue lines, wherever the latest Format line puts them; blanks around them stay."""
    p = _numbered(_pieces(texts, LINE), F.col("piece").startswith("Dialogue:"))
    names = F.when(F.col("piece").startswith("Format:"), F.transform(F.split(F.regexp_replace(_bare(), "^Format:", ""), ","), lambda x: F.lower(F.trim(x))))
    places = F.struct(F.array_position(names, "start").alias("s"), F.array_position(names, "end").alias("e"))
    both = F.when((places["s"] > 0) & (places["e"] > 0), places)
    p = p.withColumn("at", F.last(both, ignorenulls=True).over(_w())).withColumn("s", F.coalesce(F.col("at.s"), F.lit(2)).cast("int")).withColumn("e", F.coalesce(F.col("at.e"), F.lit(3)).cast("int"))
    p = p.withColumn("f", F.split(F.regexp_replace(_bare(), "^Dialogue:", ""), ","))
    start, end = (T.parse_timestamp(F.get("f", F.col(c) - 1)) for c in ("s", "e"))
    a, b = shift.both(start, end)
    put = lambda x, ms: F.concat(F.regexp_extract(x, r"^(\s*)", 1), T.clock(ms, ".", 2, 1), F.regexp_extract(x, r"(\s*)$", 1))
    fields = F.transform("f", lambda x, i: F.when(i == F.col("s") - 1, put(x, a)).when(i == F.col("e") - 1, put(x, b)).otherwise(x))
    return _written(p, F.when(_good(start, end), F.concat(F.lit("Dialogue:"), F.array_join(fields, ","), _return())), shift, LINE)


def sub(texts: DataFrame, shift: Shift, fps: float = 23.976) -> DataFrame:
    """Frames; the rate in a first line {0 or 1}{0 or 1} stays, written with three decimals, and is no cue to the reader."""
    frames = r"^\{(\d+)\}\{(\d*)\}(.*)$"
    p = _pieces(texts, LINE).withColumn("text_so_far", F.sum((F.trim(_bare()) != "").cast("int")).over(_w()))
    head = (F.col("text_so_far") == 1) & _bare().rlike(r"^\{[01]\}\{[01]\}\s*\d+([.,]\d+)?\s*$")
    rate = F.when(head, F.regexp_replace(F.regexp_extract(_bare(), frames, 3), ",", ".").cast("double"))
    p = p.withColumn("head", head).withColumn("rate", F.first(rate, ignorenulls=True).over(Window.partitionBy("path")))
    p = p.withColumn("rate", F.when(F.col("rate").between(10, 120), F.col("rate")).otherwise(fps))
    p = _numbered(p, ~F.col("head") & _bare().rlike(frames))
    ms = lambda g: T.frames_to_ms(F.coalesce(F.nullif(F.regexp_extract(_bare(), frames, g), F.lit("")).cast("bigint"), F.lit(0)), F.col("rate"))
    a, b = shift.both(ms(1), ms(2))
    n = lambda x: T.ms_to_frames(F.greatest(x, F.lit(0)), F.col("rate")).cast("string")
    line = F.concat(F.lit("{"), n(a), F.lit("}{"), n(b), F.lit("}"), F.regexp_extract(_bare(), frames, 3), _return())
    told = F.concat(F.lit("{1}{1}"), F.format_string("%.3f", "rate"), _return())
    return _written(p, F.when(F.col("head"), told).otherwise(line), shift, LINE, F.col("is_cue") | F.col("head"))


def mpl2(texts: DataFrame, shift: Shift) -> DataFrame:
    tenths = r"^\[(\d+)\]\[(\d+)\](.*)$"
    p = _numbered(_pieces(texts, LINE), _bare().rlike(tenths))
    a, b = shift.both(*(T.tenths_to_ms(F.regexp_extract(_bare(), tenths, g).cast("bigint")) for g in (1, 2)))
    n = lambda x: T.ms_to_tenths(F.greatest(x, F.lit(0))).cast("string")
    return _written(p, F.concat(F.lit("["), n(a), F.lit("]["), n(b), F.lit("]"), F.regexp_extract(_bare(), tenths, 3), _return()), shift, LINE)


def spruce(texts: DataFrame, shift: Shift) -> DataFrame:
    """Time codes at the file's rate: 30 if any frame number is 25 or over, else 25."""
    line = r"^(\s*)(\d\d:\d\d:\d\d:(\d\d))(\s*,\s*)(\d\d:\d\d:\d\d:(\d\d))(\s*,.*)$"
    part = lambda g: F.regexp_extract(_bare(), line, g)
    p = _numbered(_pieces(texts, LINE), _bare().rlike(line))
    top = F.max(F.when(F.col("is_cue"), F.greatest(part(3).cast("int"), part(6).cast("int")))).over(Window.partitionBy("path"))
    p = p.withColumn("fps", F.when(top >= 25, 30).otherwise(25))
    a, b = shift.both(T.timecode_ms(part(2), F.col("fps")), T.timecode_ms(part(5), F.col("fps")))
    code = lambda x: F.when(F.col("fps") == 30, T.timecode(x, 30)).otherwise(T.timecode(x, 25))
    return _written(p, F.concat(part(1), code(a), part(4), code(b), part(7), _return()), shift, LINE)


def smi(texts: DataFrame, shift: Shift) -> DataFrame:
    """Every mark; one that hides follows the cue shown before it."""
    mark = r"(?is)^(<sync[^>]*?start\s*=\s*[\"']?)(\d+)(.*)$"
    p = _pieces(texts, SYNC).withColumn("mark", F.col("piece").rlike(mark))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("piece", r"(?s)^[^>]*>", ""), "(?s)<[^>]*>", ""), r"&nbsp;|\s", "")
    p = _numbered(p, F.col("mark") & (body != ""))
    new = F.greatest(shift.apply(F.nullif(F.regexp_extract("piece", mark, 2), F.lit("")).cast("int")), F.lit(0))
    return _written(p, F.concat(F.regexp_extract("piece", mark, 1), new.cast("string"), F.regexp_extract("piece", mark, 3)), shift, "", F.col("mark"))


def ttml(texts: DataFrame, shift: Shift) -> DataFrame:
    """begin and end of paragraphs; times counted in frames stay so, any other becomes a clock."""
    value = lambda name: rf"(?s)^(<[^>]*?\s{name}\s*=\s*[\"'])([^\"']*)([\"'].*)$"
    attr = lambda c, name: F.regexp_extract(c, rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    number = lambda name, default: F.coalesce(F.nullif(attr("text", name), F.lit("")).cast("double"), F.lit(default))
    by = F.split(F.trim(attr("text", "frameRateMultiplier")), r"\s+")
    scale = F.coalesce(F.try_divide(F.get(by, F.lit(0)).try_cast("double"), F.get(by, F.lit(1)).try_cast("double")), F.lit(1.0))
    rates = texts.select("path", (number("frameRate", 30.0) * scale).alias("fps"), number("tickRate", 1.0).alias("ticks"))
    p = _numbered(_pieces(texts, PARAGRAPH), F.col("piece").rlike(r"(?s)^<(?:\w+:)?p\b[^>]*>")).join(rates, "path")
    old = lambda name: F.regexp_extract("piece", value(name), 2)
    p = p.withColumns({"old_begin": old("begin"), "old_end": old("end")})
    begin, end = (T.ttml_ms(F.col(f"old_{n}"), F.col("fps"), F.col("ticks")) for n in ("begin", "end"))
    p = p.withColumns({"begin": begin, "end": end})
    begin, end, has_end = F.col("begin"), F.col("end"), F.col("old_end") != ""
    a, b = shift.both(begin, F.when(has_end, end).otherwise(begin))

    def like(ms: Column, was: Column) -> Column:
        two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
        f = lambda ms: F.least(F.ceil("fps") - 1, F.round(ms % 1000 * F.col("fps") / 1000.0))
        frames = lambda ms: F.concat_ws(":", two(F.floor(ms / 3_600_000)), two(F.floor(ms / 60_000) % 60), two(F.floor(ms / 1000) % 60), two(f(ms)))
        return T.let(F.greatest(ms, F.lit(0)), lambda ms: F.when(F.length(F.regexp_replace(was, "[^:]", "")) == 3, frames(ms)).otherwise(T.clock(ms, ".")))

    put = lambda c, name, new: F.concat(F.regexp_extract(c, value(name), 1), new, F.regexp_extract(c, value(name), 3))
    first = put("piece", "begin", like(a, F.col("old_begin")))
    new = F.when((begin >= 0) & has_end & (end >= 0), put(first, "end", like(b, F.col("old_end")))).when((begin >= 0) & ~has_end, first)
    return _written(p, new, shift, "")


def idx(texts: DataFrame, shift: Shift) -> DataFrame:
    """timestamp: lines; the delay in force is taken off again."""
    at, delay = r"^(.*?timestamp: *)(\d+:\d+:\d+:\d+)(,.*)$", r"^delay: *([+-]?)(\d+:\d+:\d+:\d+)"
    p = _numbered(_pieces(texts, LINE), _bare().rlike(at))
    ms = lambda x: T.idx_ms(x)
    told = F.when(F.col("piece").rlike(delay), ms(F.regexp_extract("piece", delay, 2)) * F.when(F.regexp_extract("piece", delay, 1) == "-", -1).otherwise(1))
    p = p.withColumn("delay", F.coalesce(F.last(told, ignorenulls=True).over(_w()), F.lit(0)))
    new = shift.apply(ms(F.regexp_extract(_bare(), at, 2)) + F.col("delay")) - F.col("delay")
    return _written(p, F.concat(F.regexp_extract(_bare(), at, 1), T.clock(new, ":"), F.regexp_extract(_bare(), at, 3), _return()), shift, LINE)


def scc_lines(texts: DataFrame) -> DataFrame:
    """path, piece_no, piece, ms (null: no time), load, show, hide: closed-caption lines by their codes without parity, either channel.

    142f shows what was loaded; 142c hides; 1420 begins pop-on, 1425 to 1427 and 1429 roll-up and paint-on, where text shows as it comes."""
    p = _pieces(texts, LINE)
    stamp = r"^\s*(\d+:\d+:\d+[:;]\d+)(.*)$"
    word = lambda code: rf"\s\p{{XDigit}}*{code}(?!\S)"  # noqa: E731  # the last four digits count; 8 and 80 are parity, 08 in the first byte is the channel
    control = lambda code: word("[19][4Cc]" + code)
    p = p.withColumns({"codes": F.concat(F.lit(" "), F.regexp_extract(_bare(), stamp, 2)), "ms": F.when(F.col("piece").rlike(stamp), T.scc_ms(F.regexp_extract(_bare(), stamp, 1)))})
    mode = F.when(F.col("ms").isNotNull(), F.nullif(F.regexp_extract("codes", ".*" + control("[2Aa]([05679])"), 1), F.lit("")))
    pop = F.coalesce(F.last(mode, ignorenulls=True).over(_w()) == "0", F.lit(True))
    p = p.withColumn("pop", pop).withColumn("texty", F.col("codes").rlike(word(r"[2-7A-Fa-f]\p{XDigit}{3}")))
    p = p.withColumn("show", F.col("ms").isNotNull() & (F.col("codes").rlike(control("[2Aa][Ff]")) | (~F.col("pop") & F.col("texty"))))
    return p.withColumn("hide", F.col("ms").isNotNull() & ~F.col("show") & F.col("codes").rlike(control("[2Aa][Cc]"))).withColumn("load", F.col("ms").isNotNull() & F.col("pop") & ~F.col("show") & F.col("texty")).select("path", "piece_no", "piece", "ms", "load", "show", "hide")


def scc(texts: DataFrame, shift: Shift) -> DataFrame:
    """Every time; a line that loads text belongs to the cue that shows it, one that hides to the cue before."""
    p = _numbered(scc_lines(texts), F.col("show"))
    shows = F.sum(F.col("show").cast("int")).over(Window.partitionBy("path"))
    p = p.withColumn("cue_no", F.when(F.col("load"), F.least(F.col("cue_no") + 1, shows - 1)).otherwise(F.col("cue_no")).cast("int"))
    stamp = r"^(\s*)(\d+:\d+:\d+)([:;])(\d+)(.*)$"
    part = lambda g: F.regexp_extract("piece", r"(?s)" + stamp, g)
    return _written(p, F.concat(part(1), T.scc_code(shift.apply(F.col("ms")), part(3)), part(5)), shift, LINE, F.col("ms").isNotNull())


TEXT = {"srt": srt, "vtt": vtt, "sbv": sbv, "subviewer": subviewer, "ass": ass, "sub": sub, "mpl2": mpl2, "spruce": spruce, "smi": smi, "ttml": ttml, "idx": idx, "scc": scc}


def patch_pgs(data: bytes, shift: Shift, offsets: dict[int, int]) -> bytes:
    """The 90 kHz time of every segment, which moves with the cue shown last."""
    out, i, cue = bytearray(data), 0, -1
    while i + 13 <= len(data) and data[i : i + 2] == b"PG":
        pts, _, kind, size = struct.unpack_from(">IIBH", data, i + 2)
        if i + 13 + size > len(data):
            break
        cue += kind == 0x16 and size >= 11 and data[i + 23] > 0
        struct.pack_into(">I", out, i + 2, max(0, shift.apply_one(pts // 90, offsets.get(cue, 0))) * 90 & 0xFFFFFFFF)
        i += 13 + size
    return bytes(out)


def patch_ebu(data: bytes, shift: Shift, offsets: dict[int, int]) -> bytes:
    """The time codes of every record, against the programme's start; continued numbers and comments move with their cue."""
    if not binary.is_ebu(data):
        return data
    fps, zero = binary.ebu_fps(data), binary.ebu_zero(data)
    out, last, cue = bytearray(data), None, -1
    for i in range(1024, len(data) - 127, 128):
        r = data[i : i + 128]
        number = struct.unpack_from("<H", r, 1)[0]
        if not r[15] and number != last:
            cue, last = cue + 1, number
        a, b = shift.both_one(binary.ebu_ms(r[5:9], fps) - zero, binary.ebu_ms(r[9:13], fps) - zero, offsets.get(cue, 0))
        for at, ms in ((5, a), (9, b)):
            f = int(min(max(ms + zero, 0), M.DAY_MS - 1) * fps / 1000 + 0.5)
            out[i + at : i + at + 4] = bytes((f // fps // 3600, f // fps // 60 % 60, f // fps % 60, f % fps))
    return bytes(out)


BINARY: dict[str, Callable[[bytes, Shift, dict[int, int]], bytes]] = {"sup": patch_pgs, "stl": patch_ebu}


def patch(files: DataFrame, kind: str, shift: Shift) -> DataFrame:
    """path, content -> path, content; a file's offsets reach its task as one array, MAX_CUES long at most."""
    change, plain = BINARY[kind], Shift(shift.slope, shift.intercept_s)
    if shift.offsets is None:
        joined = files.select("path", "content", F.array().cast("array<struct<cue_no:int,offset_ms:int>>").alias("moves"))
    else:
        each = shift.offsets.where(F.col("cue_no") < M.MAX_CUES).groupBy("path").agg(F.collect_list(F.struct(F.col("cue_no").cast("int").alias("cue_no"), F.col("offset_ms").cast("int").alias("offset_ms"))).alias("moves"))
        joined = files.select("path", "content").join(each, "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            moves = [{} if x is None else {m["cue_no"]: m["offset_ms"] for m in x} for x in pdf["moves"].tolist()]
            yield pd.DataFrame({"path": pdf["path"], "content": [change(bytes(c), plain, m) for c, m in zip(pdf["content"], moves, strict=True)]})

    return joined.mapInPandas(run, "path string, content binary")


def rewrite(texts: DataFrame, kind: str, shift: Shift) -> DataFrame:
    """Files (path, text) of a text format with their times moved."""
    return TEXT[kind](texts, shift)
