"""Timed-text readers: a DataFrame of whole files (path, text) to cues (path, cue_no, start_ms, end_ms, text).

Readers are plans over exploded lines; order is kept in cue_no. A cue whose times can't be read stays as (0, 0).
Files are read by ``files``: binary content, size limits at the listing, charset found by its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora import model as M
from tempora.functions import times as T
from tempora.sources.rewriters import scc_lines

BY_SUFFIX = {"srt": "srt", "vtt": "vtt", "ass": "ass", "ssa": "ass", "sub": "sub", "mpl": "mpl2", "sbv": "sbv", "smi": "smi", "sami": "smi", "ttml": "ttml", "dfxp": "ttml", "itt": "ttml", "stl": "stl", "scc": "scc", "sup": "sup", "idx": "idx"}
MAX_BYTES = 64 << 20


def decode(content: Column) -> Column:
    """Text of bytes: by byte order mark, else UTF-16 by its share of NUL bytes, else UTF-8 if valid, else Latin-1."""
    nul, head = F.lit("\0"), F.substring(content, 1, 4096)
    n = F.greatest(F.octet_length(head) / 2, F.lit(1.0))
    pairs = F.decode(F.substring(head, F.lit(1), (F.octet_length(head) - F.octet_length(head) % 2).cast("int")), "ISO-8859-1")  # a character for each byte
    nuls = lambda x: F.length(x) - F.length(F.replace(x, nul, F.lit("")))
    second = T.let(F.regexp_replace(pairs, "(?s).(.)", "$1"), nuls) / n  # the share of pairs whose second byte is NUL
    wide = lambda kind: F.regexp_replace(F.decode(content, kind), "^\ufeff", "")
    narrow = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    by_share = lambda one, two: F.when((two > 0.3) & (one < 0.05), F.decode(content, "UTF-16LE")).when((one > 0.3) & (two < 0.05), F.decode(content, "UTF-16BE")).otherwise(narrow)
    starts = lambda mark: F.startswith(content, F.lit(bytes.fromhex(mark)))
    return (
        F.when(starts("EFBBBF"), F.regexp_replace(F.decode(content, "UTF-8"), "^\ufeff", ""))
        .when(starts("FFFE"), wide("UTF-16LE"))
        .when(starts("FEFF"), wide("UTF-16BE"))
        .when(content.cast("string").contains(nul), T.let(second, lambda two: by_share(nuls(pairs) / n - two, two)))
        .otherwise(narrow)
    )


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, format (null: to be sniffed), text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where((F.col("length") > 0) & (F.col("length") <= MAX_BYTES))
    return raw.select("path", format_of(F.col("path")).alias("format"), decode(F.col("content")).alias("text"))


def format_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in BY_SUFFIX.items() for x in kv]), F.nullif(suffix, F.lit("")))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def lines(texts: DataFrame) -> DataFrame:
    """path, line_no, line."""
    return texts.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("line_no", "line"))


def sniff(texts: DataFrame) -> DataFrame:
    """path, format by the first of 400 lines with text that says something."""
    x = F.col("line")
    kind = (
        F.when(x.contains("-->"), F.when(x.rlike(r"\d,\d"), "srt").otherwise("vtt")).when(x.rlike("^WEBVTT"), "vtt").when(x.rlike(r"^(Dialogue:|\[Script Info\]|\[V4)"), "ass")
        .when(x.rlike(r"^\{\d+\}\{\d+\}"), "sub").when(x.rlike(r"^\[\d+\]\[\d+\]"), "mpl2").when(x.rlike(r"^\d+:\d\d:\d\d\.\d{3},\d+:\d\d:\d\d\.\d{3}\s*$"), "sbv")
        .when(x.rlike(r"^\d\d:\d\d:\d\d\.\d\d,\d\d:\d\d:\d\d\.\d\d\s*$"), "subviewer").when(x.rlike("(?i)<sami|<sync"), "smi").when(x.rlike(r"(?i)<(\w+:)?tt\b"), "ttml").when(x.rlike("^Scenarist_SCC"), "scc")
        .when(x.rlike(r"^\d\d:\d\d:\d\d:\d\d\s*,\s*\d\d:\d\d:\d\d:\d\d\s*,"), "spruce")
    )
    w = Window.partitionBy("path").orderBy("line_no")
    t = lines(texts).where(F.trim("line") != "").withColumn("k", F.row_number().over(w)).where("k <= 400").withColumn("format", kind)
    return t.groupBy("path").agg(F.min_by("format", F.when(F.col("format").isNotNull(), F.col("k"))).alias("format"))


def _numbered(df: DataFrame) -> DataFrame:
    """cue_no in line order; unreadable times become (0, 0); at most MAX_CUES a file."""
    w = Window.partitionBy("path").orderBy("line_no")
    bad = (F.col("start_ms") < 0) | (F.col("end_ms") < 0)
    out = df.withColumn("cue_no", F.row_number().over(w) - 1).where(F.col("cue_no") < M.MAX_CUES)
    return out.select("path", "cue_no", F.when(bad, 0).otherwise(F.col("start_ms")).alias("start_ms"), F.when(bad, 0).otherwise(F.col("end_ms")).alias("end_ms"), "text")


def _block_text(t: DataFrame, is_time: Column) -> DataFrame:
    """Time lines with the text that follows each, up to an empty line."""
    w = Window.partitionBy("path").orderBy("line_no")
    b = t.withColumn("time", is_time).withColumn("cue", F.sum(F.col("time").cast("int")).over(w)).where("cue > 0")
    c = Window.partitionBy("path", "cue").orderBy("line_no")
    b = b.withColumn("over", F.max((~F.col("time") & (F.trim("line") == "")).cast("int")).over(c)).where("over = 0")
    return b.groupBy("path", "cue").agg(F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("head"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("time"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("text"))


def read_srt(texts: DataFrame) -> DataFrame:
    b = _block_text(lines(texts), F.col("line").contains("-->"))
    return _numbered(b.select("path", "line_no", T.parse_timestamp(F.split("head", "-->")[0]).alias("start_ms"), T.parse_timestamp(F.split("head", "-->")[1]).alias("end_ms"), "text"))


read_vtt = read_srt


def read_sbv(texts: DataFrame) -> DataFrame:
    b = _block_text(lines(texts), F.col("line").rlike(r"^\s*\d+:\d\d:\d\d\.\d+,\d+:\d\d:\d\d\.\d+\s*$"))
    return _numbered(b.select("path", "line_no", T.parse_timestamp(F.split("head", ",")[0]).alias("start_ms"), T.parse_timestamp(F.split("head", ",")[1]).alias("end_ms"), "text"))


read_subviewer = read_sbv


def read_ass(texts: DataFrame) -> DataFrame:
    """The latest Format: line above a row says which fields are Start, End and Text (1, 2 and 9 if there is none)."""
    w = Window.partitionBy("path").orderBy("line_no")
    names = F.when(F.col("line").startswith("Format:"), F.transform(F.split(F.substring("line", 8, 1 << 20), ","), lambda x: F.lower(F.trim(x))))
    t = lines(texts).withColumn("format", F.last(names, ignorenulls=True).over(w)).where("line like 'Dialogue:%'")
    at = lambda name, default: F.coalesce(F.nullif(F.array_position("format", name), F.lit(0)), F.lit(default + 1)).cast("int")
    fields = F.split(F.regexp_replace("line", "^Dialogue:", ""), ",")
    t = t.withColumn("f", fields).withColumns({"s": at("start", 1), "e": at("end", 2), "x": at("text", 9)})
    text = F.regexp_replace(F.array_join(F.slice("f", F.col("x"), F.greatest(F.size("f") - F.col("x") + 1, F.lit(0))), ","), r"\\[Nn]", "\n")
    return _numbered(t.select("path", "line_no", T.parse_timestamp(F.get("f", F.col("s") - 1)).alias("start_ms"), T.parse_timestamp(F.get("f", F.col("e") - 1)).alias("end_ms"), text.alias("text")))


def read_sub(texts: DataFrame, fps: float = 23.976) -> DataFrame:
    """Frames; a first line {0 or 1}{0 or 1}rate gives the rate and is no cue."""
    p = r"^\{(\d+)\}\{(\d*)\}(.*)$"
    w = Window.partitionBy("path").orderBy("line_no")
    t = lines(texts).where(F.trim("line") != "").withColumn("k", F.row_number().over(w)).where(F.col("line").rlike(p))
    head = (F.col("k") == 1) & F.col("line").rlike(r"^\{[01]\}\{[01]\}\s*\d+([.,]\d+)?\s*$")
    rate = F.when(head, F.regexp_replace(F.regexp_extract("line", p, 3), ",", ".").cast("double"))
    t = t.withColumn("rate", F.first(rate, ignorenulls=True).over(w)).withColumn("rate", F.when(F.col("rate").between(10, 120), F.col("rate")).otherwise(fps)).where(~head)
    ms = lambda g: T.frames_to_ms(F.coalesce(F.nullif(F.regexp_extract("line", p, g), F.lit("")).cast("bigint"), F.lit(0)), F.col("rate"))
    return _numbered(t.select("path", "line_no", ms(1).alias("start_ms"), ms(2).alias("end_ms"), F.regexp_replace(F.regexp_extract("line", p, 3), r"\|", "\n").alias("text")))


def read_mpl2(texts: DataFrame) -> DataFrame:
    p = r"^\[(\d+)\]\[(\d+)\](.*)$"
    t = lines(texts).where(F.col("line").rlike(p))
    ms = lambda g: T.tenths_to_ms(F.regexp_extract("line", p, g).cast("bigint"))
    return _numbered(t.select("path", "line_no", ms(1).alias("start_ms"), ms(2).alias("end_ms"), F.regexp_replace(F.regexp_extract("line", p, 3), r"\|", "\n").alias("text")))


def read_spruce(texts: DataFrame) -> DataFrame:
    """Frame rate 30 if any frame number is 25 or over, else 25."""
    p = r"^\s*(\d\d:\d\d:\d\d:(\d\d))\s*,\s*(\d\d:\d\d:\d\d:(\d\d))\s*,\s?(.*)$"
    t = lines(texts).where(F.col("line").rlike(p))
    top = F.max(F.greatest(F.regexp_extract("line", p, 2).cast("int"), F.regexp_extract("line", p, 4).cast("int"))).over(Window.partitionBy("path"))
    t = t.withColumn("fps", F.when(top >= 25, 30).otherwise(25))
    return _numbered(t.select("path", "line_no", T.timecode_ms(F.regexp_extract("line", p, 1), F.col("fps")).alias("start_ms"), T.timecode_ms(F.regexp_extract("line", p, 3), F.col("fps")).alias("end_ms"), F.regexp_replace(F.regexp_extract("line", p, 5), r"\|", "\n").alias("text")))


def read_smi(texts: DataFrame) -> DataFrame:
    """<sync start=N> marks; a mark without text hides what was shown."""
    part = texts.select("path", F.posexplode(F.slice(F.split("text", "(?i)<sync"), 2, 1 << 30)).alias("line_no", "part"))
    body = _strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("part", r"(?s)^[^>]*>", ""), "(?i)<br[^>]*>", "\n"), "<[^>]*>", ""), "&nbsp;", " "))
    t = part.withColumn("text", body).withColumn("at_ms", F.nullif(F.regexp_extract("part", r"(?i)^[^>]*start\s*=\s*[\"']?(\d+)", 1), F.lit("")).cast("int")).where("at_ms is not null")
    w = Window.partitionBy("path").orderBy("line_no")
    end = F.lead("at_ms").over(w)
    end = F.least(F.when(end > F.col("at_ms"), end).otherwise(F.col("at_ms") + 2000), F.col("at_ms") + M.MAX_CUE_MS)
    return _numbered(t.withColumn("end_ms", end).where("text <> ''").select("path", "line_no", F.col("at_ms").alias("start_ms"), "end_ms", "text"))


def read_ttml(texts: DataFrame) -> DataFrame:
    attr = lambda c, name: F.regexp_extract(c, rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    rate = F.coalesce(F.nullif(attr("text", "frameRate"), F.lit("")).cast("double"), F.lit(30.0))
    tick = F.coalesce(F.nullif(attr("text", "tickRate"), F.lit("")).cast("double"), F.lit(1.0))
    p = texts.select("path", rate.alias("fps"), tick.alias("ticks"), F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<(?:\w+:)?p\b.*?(?:/>|</(?:\w+:)?p>)"), F.lit(0))).alias("line_no", "p"))
    head = p.withColumn("tag", F.regexp_extract("p", r"(?s)^(<[^>]*>)", 1))
    time = lambda name: T.ttml_ms(attr("tag", name), F.col("fps"), F.col("ticks"))
    t = head.withColumn("start_ms", time("begin")).withColumn("end_ms", F.when(attr("tag", "end") != "", time("end")).when(attr("tag", "dur") != "", F.col("start_ms") + time("dur")).otherwise(-1))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("p", r"(?s)^<[^>]*>|</(?:\w+:)?p>$", ""), r"<(?:\w+:)?br[^>]*>", "\n"), "<[^>]*>", "")
    return _numbered(t.select("path", "line_no", "start_ms", "end_ms", _strip(text).alias("text")))


def read_scc(texts: DataFrame) -> DataFrame:
    """Closed captions: shown until the next line that shows or hides."""
    t = scc_lines(texts).where("show or hide").withColumnRenamed("piece_no", "line_no")
    end = F.lead("ms").over(Window.partitionBy("path").orderBy("line_no"))
    end = F.least(F.when(end > F.col("ms"), end).otherwise(F.col("ms") + 2000), F.col("ms") + M.MAX_CUE_MS)
    return _numbered(t.withColumn("end_ms", end).where("show").select("path", "line_no", F.col("ms").alias("start_ms"), "end_ms", F.lit("").alias("text")))


READERS = {"scc": read_scc, "srt": read_srt, "vtt": read_vtt, "ass": read_ass, "sub": read_sub, "mpl2": read_mpl2, "sbv": read_sbv, "subviewer": read_subviewer, "smi": read_smi, "ttml": read_ttml, "spruce": read_spruce}


def read_cues(texts: DataFrame) -> DataFrame:
    """Cues of files of any text format: (path, format, text), format null where it is to be sniffed."""
    known = texts.join(sniff(texts).withColumnRenamed("format", "sniffed"), "path", "left").withColumn("format", F.coalesce("format", "sniffed"))
    out = None
    for name, read in READERS.items():
        part = read(known.where(F.col("format") == name).select("path", "text")).withColumn("format", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
