"""Sinks: cues (path, cue_no, start_ms, end_ms, text) as the text of files, and rewriting of files line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import times as T

_ASS_HEAD = "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def _file(cues: DataFrame, line: Column, head: str = "", end: str = "\n") -> DataFrame:
    rows = cues.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cue_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return rows.select("path", F.concat(F.lit(head), "body", F.lit(end)).alias("text"))


def to_srt(c: DataFrame) -> DataFrame:
    return _file(c, F.concat((F.col("cue_no") + 1).cast("string"), F.lit("\n"), T.clock(F.col("start_ms")), F.lit(" --> "), T.clock(F.col("end_ms")), F.lit("\n"), "text", F.lit("\n")))


def to_vtt(c: DataFrame) -> DataFrame:
    return _file(c, F.concat(T.clock(F.col("start_ms"), "."), F.lit(" --> "), T.clock(F.col("end_ms"), "."), F.lit("\n"), "text", F.lit("\n")), "WEBVTT\n\n")


def to_ass(c: DataFrame) -> DataFrame:
    stamp = lambda x: T.clock(F.col(x), ".", 2, 1)
    return _file(c, F.concat(F.lit("Dialogue: 0,"), stamp("start_ms"), F.lit(","), stamp("end_ms"), F.lit(",Default,,0,0,0,,"), F.regexp_replace("text", "\n", r"\\\\N")), _ASS_HEAD)


def to_sbv(c: DataFrame) -> DataFrame:
    return _file(c, F.concat(T.clock(F.col("start_ms"), ".", 3, 1), F.lit(","), T.clock(F.col("end_ms"), ".", 3, 1), F.lit("\n"), "text", F.lit("\n")))


def to_sub(c: DataFrame, fps: float = 25.0) -> DataFrame:
    f = lambda x: T.ms_to_frames(F.col(x), fps).cast("string")
    return _file(c, F.concat(F.lit("{"), f("start_ms"), F.lit("}{"), f("end_ms"), F.lit("}"), F.regexp_replace("text", "\n", "|")), f"{{1}}{{1}}{fps:.3f}\n")


def to_mpl2(c: DataFrame) -> DataFrame:
    f = lambda x: T.ms_to_tenths(F.col(x)).cast("string")
    return _file(c, F.concat(F.lit("["), f("start_ms"), F.lit("]["), f("end_ms"), F.lit("]"), F.regexp_replace("text", "\n", "|")))


def to_smi(c: DataFrame) -> DataFrame:
    return _file(c, F.concat(F.lit("<SYNC Start="), F.col("start_ms").cast("string"), F.lit("><P>"), F.regexp_replace("text", "\n", "<br>"), F.lit("\n<SYNC Start="), F.col("end_ms").cast("string"), F.lit("><P>&nbsp;")), "<SAMI><BODY>\n", "\n</BODY></SAMI>\n")


def to_ttml(c: DataFrame) -> DataFrame:
    return _file(c, F.concat(F.lit('<p begin="'), T.clock(F.col("start_ms"), "."), F.lit('" end="'), T.clock(F.col("end_ms"), "."), F.lit('">'), F.regexp_replace("text", "\n", "<br/>"), F.lit("</p>")), '<tt xmlns="http://www.w3.org/ns/ttml"><body><div>\n', "\n</div></body></tt>\n")


def to_spruce(c: DataFrame, fps: int = 25) -> DataFrame:
    return _file(c, F.concat(T.timecode(F.col("start_ms"), fps), F.lit(" , "), T.timecode(F.col("end_ms"), fps), F.lit(" , "), F.regexp_replace("text", "\n", "|")))


def to_subviewer(c: DataFrame) -> DataFrame:
    stamp = lambda x: T.clock(F.col(x), ".", 2)
    return _file(c, F.concat(stamp("start_ms"), F.lit(","), stamp("end_ms"), F.lit("\n"), F.regexp_replace("text", "\n", "[br]"), F.lit("\n")), "[INFORMATION]\n[SUBTITLE]\n")


def to_scc(c: DataFrame) -> DataFrame:
    """Pop-on captions, loaded and shown in one line and hidden by another; letters go two by two."""
    spaced = lambda x: F.regexp_replace(F.lower(F.hex(F.substring(x, F.lit(1), F.length(x) - F.length(x) % 2))), "(....)(?!$)", "$1 ")
    codes = F.concat_ws(" ", F.lit("9420 9420"), T.let(F.regexp_replace(F.concat("text", F.lit(" ")), r"[^ -~]", "?"), spaced), F.lit("942f 942f"))
    return _file(c, F.concat(T.scc_code(F.col("start_ms")), F.lit("\t"), codes, F.lit("\n\n"), T.scc_code(F.col("end_ms")), F.lit("\t942c 942c\n")), "Scenarist_SCC V1.0\n\n")


def to_idx(c: DataFrame, delay_ms: int = 0) -> DataFrame:
    """An index without pictures; times stand before the delay is added."""
    return _file(c, F.concat(F.lit("timestamp: "), T.clock(F.col("start_ms") - delay_ms, ":"), F.lit(", filepos: 000000000")), f"# VobSub index file, v7\ndelay: 00:00:{delay_ms // 1000:02d}:{delay_ms % 1000:03d}\n")


WRITERS = {"subviewer": to_subviewer, "scc": to_scc, "idx": to_idx, "srt": to_srt, "vtt": to_vtt, "ass": to_ass, "sbv": to_sbv, "sub": to_sub, "mpl2": to_mpl2, "smi": to_smi, "ttml": to_ttml, "spruce": to_spruce}


def convert(cues: DataFrame, kind: str) -> DataFrame:
    """Files of a format from cues that a reader gave; what can't be read (0, 0) is left out and the rest numbered anew."""
    w = Window.partitionBy("path").orderBy("cue_no")
    return WRITERS[kind](cues.where("end_ms > start_ms").withColumn("cue_no", F.row_number().over(w) - 1))


def rewrite_clock_lines(texts: DataFrame, times: DataFrame) -> DataFrame:
    """SRT and VTT files with new times (path, cue_no, start_ms, end_ms); all else, settings and line ends included, as it was."""
    t = texts.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("path").orderBy("line_no")
    timed = t.withColumn("is_time", F.col("line").contains("-->")).withColumn("cue_no", F.when(F.col("is_time"), F.sum(F.col("is_time").cast("int")).over(w) - 1))
    j = timed.join(times, ["path", "cue_no"], "left")
    mark = F.regexp_extract("line", r"\d([.,])\d", 1)
    stamp = lambda x: F.when(mark == ",", T.clock(F.col(x))).otherwise(T.clock(F.col(x), "."))
    line = F.when(F.col("start_ms").isNotNull() & F.col("is_time"), F.concat(stamp("start_ms"), F.lit(" --> "), stamp("end_ms"), F.regexp_extract("line", r"-->\s*\S+(.*)$", 1))).otherwise(F.col("line"))
    return j.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def beside(path: Column) -> Column:
    """name.unsure.ext"""
    return F.regexp_replace(path, r"(\.[A-Za-z0-9]+)$", ".unsure$1")
