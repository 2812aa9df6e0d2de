"""Formats: cues of the documents' lines written in each format, read back, moved within their files and converted."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import text as X
from tempora.functions import times as T
from tempora.plans.registry import query
from tempora.sources import binary, rewriters, subtitles, writers

#: What each format keeps of a millisecond: unit in ms.
UNIT = {"srt": 1, "vtt": 1, "sbv": 1, "smi": 1, "ttml": 1, "ass": 10, "mpl2": 100, "sub": 40, "spruce": 40, "subviewer": 10}
SNIFFED = ("srt", "vtt", "ass", "sbv", "sub", "mpl2", "smi", "ttml", "spruce")
#: How files are moved: slope, intercept in seconds; besides, (cue_no mod 3) seconds a cue.
SLOPE, INTERCEPT_S = 0.001, 0.25


def _cues(l: DataFrame) -> DataFrame:
    t = F.trim(F.regexp_replace("text", X.NO_LETTERS, ""))
    start = F.col("cue_no") * 4000 + (F.col("film_id") % 900).cast("int")
    return l.select(F.concat(F.lit("f"), F.col("film_id").cast("string")).alias("path"), "cue_no", start.alias("start_ms"), (start + 1500).alias("end_ms"), T.let(t, lambda t: F.when(t == "", "x").otherwise(t)).alias("text"))


def _kept(x: str, kind: str) -> str:
    """SQL: what is left of a time in a format."""
    if kind == "scc":
        return f"(({x}) // 1000 * 1000 + least(29, (({x}) % 1000 + 16) // 33) * 33)"
    u = {"idx": 1, "sup": 1, "stl": 40}.get(kind) or UNIT[kind]
    return f"((({x}) + {u // 2}) // {u} * {u})"


_CUES = "with c as (select film_id, cue_no, cue_no * 4000 + cast(film_id % 900 as int) as s, trim(regexp_replace(text, '[^A-Za-z .]', '', 'g')) as t from lines)\n"
_TEXT = "case when t = '' then 'x' else t end"


def _register(kind: str) -> None:
    def read_back(l: DataFrame) -> DataFrame:
        return subtitles.READERS[kind](writers.WRITERS[kind](_cues(l)))

    read_back.__name__ = f"format_{kind}"
    query("lines", sql=f"{_CUES}select 'f' || film_id as path, cue_no, cast({_kept('s', kind)} as int) as start_ms, cast({_kept('s + 1500', kind)} as int) as end_ms, {_TEXT} as text from c")(read_back)


def _shift(cues: DataFrame) -> rewriters.Shift:
    return rewriters.Shift(SLOPE, INTERCEPT_S, cues.select("path", "cue_no", (F.col("cue_no") % 3 * 1000).alias("offset_ms")))


def _moved(kind: str, start: str = "s", end: str = "s + 1500") -> str:
    """SQL: a common table expression m (path, cue_no, start_ms, end_ms, t) of the cues as they are after moving."""
    to = lambda x: _kept(f"cast(round({_kept(x, kind)} * (1 + {SLOPE}e0) + {INTERCEPT_S * 1000}e0) as int) + cue_no % 3 * 1000", kind)
    return f"{_CUES[:-1]}, m as (select 'f' || film_id as path, cue_no, cast({to(start)} as int) as start_ms, cast({to(end)} as int) as end_ms, {_TEXT} as t from c)\n"


def _register_move(kind: str) -> None:
    def moved(l: DataFrame) -> DataFrame:
        cues = _cues(l)
        return subtitles.READERS[kind](rewriters.rewrite(writers.WRITERS[kind](cues), kind, _shift(cues)))

    moved.__name__ = f"move_{kind}"
    query("lines", sql=f"{_moved(kind)}select path, cue_no, start_ms, end_ms, {chr(39) * 2 if kind == 'scc' else 't'} as text from m")(moved)


for _kind in UNIT:
    _register(_kind)
for _kind in (*UNIT, "scc"):
    _register_move(_kind)


@query("lines", sql=f"{_CUES}select 'f' || film_id as path, cue_no, cast({_kept('s', 'scc')} as int) as start_ms, cast({_kept('s + 1500', 'scc')} as int) as end_ms from c")
def format_scc(l: DataFrame) -> DataFrame:
    """Closed captions keep frames of 33 ms."""
    return subtitles.read_scc(writers.to_scc(_cues(l))).drop("text")


def _binary(cues: DataFrame, kind: str) -> DataFrame:
    """path, content: files of a binary format that hold the cues' times."""

    digits = lambda x, n: F.lpad(F.hex(x), n, "0")

    def ebu(c: Column) -> Column:
        def code(ms: Column) -> Column:
            hmsf = lambda f: (F.floor(f / 90_000) + 10) * (1 << 24) + F.floor(f / 1500) % 60 * (1 << 16) + F.floor(f / 25) % 60 * (1 << 8) + f % 25
            return digits(T.let(F.floor((ms + 20) / 40), hmsf), 8)

        number = digits(c["cue_no"] % 256 * 256 + F.floor(c["cue_no"] / 256), 4)
        return F.concat(F.lit("00"), number, F.lit("FF00"), code(c["start_ms"]), code(c["end_ms"]), F.lit("000000" + "8F" * 112))

    def pgs(c: Column) -> Column:
        segment = lambda ms, objects: F.concat(F.lit(b"PG".hex()), digits(ms.cast("bigint") * 90, 8), F.lit((struct.pack(">IBH", 0, 0x16, 11) + bytes(10) + bytes([objects])).hex()))
        return F.concat(segment(c["start_ms"], 1), segment(c["end_ms"], 0))

    head = bytearray(b" " * 1024 if kind == "stl" else b"")
    if kind == "stl":
        head[3:11], head[256:264] = b"STL25.01", b"10000000"
    rows = cues.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("cue_no", "start_ms", "end_ms"))).alias("cues"))
    body = F.array_join(F.transform("cues", {"stl": ebu, "sup": pgs}[kind]), "")
    return rows.select("path", F.unhex(F.concat(F.lit(head.hex()), body)).alias("content"))


def _register_binary(kind: str) -> None:
    def read_back(l: DataFrame) -> DataFrame:
        return binary.read(_binary(_cues(l), kind), kind)

    def moved(l: DataFrame) -> DataFrame:
        cues = _cues(l)
        return binary.read(rewriters.patch(_binary(cues, kind), kind, _shift(cues)), kind)

    read_back.__name__, moved.__name__ = f"format_{kind}", f"move_{kind}"
    query("lines", sql=f"{_CUES}select 'f' || film_id as path, cue_no, cast({_kept('s', kind)} as int) as start_ms, cast({_kept('s + 1500', kind)} as int) as end_ms from c")(read_back)
    query("lines", sql=f"{_moved(kind)}select path, cue_no, start_ms, end_ms from m")(moved)


for _kind in ("stl", "sup"):
    _register_binary(_kind)

_SHOWN = "least(case when lead(start_ms) over w > start_ms then lead(start_ms) over w else start_ms + 2000 end, start_ms + 10000)"


def _index(l: DataFrame) -> DataFrame:
    return writers.to_idx(_cues(l), 1000)


@query("lines", sql=f"{_CUES[:-1]}, m as (select 'f' || film_id as path, cue_no, greatest(s, 1000) as start_ms from c) select path, cue_no, cast(start_ms as int) as start_ms, cast({_SHOWN} as int) as end_ms from m window w as (partition by path order by cue_no)")
def format_idx(l: DataFrame) -> DataFrame:
    """An index under a delay of a second; a time before it can't be written and becomes zero."""
    return binary.read(_index(l).select("path", F.encode("text", "UTF-8").alias("content")), "idx")


@query("lines", sql=f"{_moved('idx', 'greatest(s, 1000)')}select path, cue_no, start_ms, cast({_SHOWN} as int) as end_ms from m window w as (partition by path order by cue_no)")
def move_idx(l: DataFrame) -> DataFrame:
    moved = rewriters.rewrite(_index(l), "idx", _shift(_cues(l)))
    return binary.read(moved.select("path", F.encode("text", "UTF-8").alias("content")), "idx")


@query("lines", sql=f"{_CUES}select 'f' || film_id as path, kind, cue_no, cast(case kind when 'vtt' then s else (s + 5) // 10 * 10 end as int) as start_ms, cast(case kind when 'vtt' then s + 1500 else (s + 1505) // 10 * 10 end as int) as end_ms, {_TEXT} as text from c, (select unnest(['vtt', 'ass']) as kind) k")
def convert_formats(l: DataFrame) -> DataFrame:
    """SRT files converted to two other formats, then read."""
    cues, out = subtitles.read_srt(writers.to_srt(_cues(l))), None
    for kind in ("vtt", "ass"):
        got = subtitles.READERS[kind](writers.convert(cues, kind)).withColumn("kind", F.lit(kind))
        out = got if out is None else out.unionByName(got)
    return out


@query("lines", sql="""select 'f' || film_id as path, case cast(film_id // 3 % 9 as int) when 0 then 'srt' when 1 then 'vtt' when 2 then 'ass' when 3 then 'sbv' when 4 then 'sub' when 5 then 'mpl2' when 6 then 'smi' when 7 then 'ttml' else 'spruce' end as format, count(*) as n
from lines group by film_id""")
def format_sniffing(l: DataFrame) -> DataFrame:
    """Files in nine formats without a suffix: each is recognised and read."""
    cues, out = _cues(l), None
    for k, kind in enumerate(SNIFFED):
        texts = writers.WRITERS[kind](cues.where(F.floor(F.substring("path", 2, 20).cast("bigint") / 3) % 9 == k))
        out = texts if out is None else out.union(texts)
    return subtitles.read_cues(out.withColumn("format", F.lit(None).cast("string"))).groupBy("path", "format").agg(F.count(F.lit(1)).alias("n"))


@query("lines", sql="""with c as (select film_id, cue_no, cue_no * 4000 + cast(film_id % 900 as int) + 250 as s from lines)
select 'f' || film_id as path, cue_no, s as start_ms, s + 1500 as end_ms from c""")
def rewrite_srt(l: DataFrame) -> DataFrame:
    """Given times in files that are otherwise untouched, then read."""
    cues = _cues(l)
    out = writers.rewrite_clock_lines(writers.to_srt(cues), cues.select("path", "cue_no", (F.col("start_ms") + 250).alias("start_ms"), (F.col("end_ms") + 250).alias("end_ms")))
    return subtitles.read_srt(out).drop("text")
