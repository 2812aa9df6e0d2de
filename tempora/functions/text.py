"""Cue text: which lines are dialogue; names and tokens of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora import model as M

# Fixed values, given by the behaviour to match: credit marks, note characters, brackets, words that name no title.
CREDITS = ("www.", "http", ".com", ".org", ".net", "subtitle", "synced by", "sync by", "corrected by", "ripped by", "encoded by", "translated by", "opensubtitles", "addic7ed", "subscene", "podnapisi", "advertise your", "tekstet af", "oversat af")
NOTES = "♪♫♬♩#*~"
BRACKETS = (("[", "]"), ("(", ")"), ("（", "）"), ("【", "】"), ("「", "」"), ("<<", ">>"))
LANGUAGE_WORDS = """
en eng english da dan dansk danish sv swe swedish no nor nb norwegian fi fin finnish is isl icelandic de ger deu german
fr fre fra french es spa spanish it ita italian nl dut nld dutch pt por portuguese pl pol polish ru rus russian cs ces
czech tr tur turkish ar ara arabic zh chi chinese ja jpn japanese ko kor korean hu hun hungarian ro ron romanian el ell
greek he heb hebrew hi hin hindi th tha thai forced sdh cc hearing impaired full default sub subs subtitle subtitles srt track
""".split()
#: What is no letter, blank or full stop. Java looks a named class up in a table; [^A-Za-z .] asks a chain of predicates for each character and takes ten times as long.
NO_LETTERS = r"[^\p{Alpha} .]"


def strip_markup(x: Column) -> Column:
    """Without <tags> and {overrides}, innermost first, and without stray closers."""
    once = lambda c: F.regexp_replace(c, r"<[^<>]*>|\{[^{}]*\}", "")
    return F.regexp_replace(once(once(once(x))), r"[>}]", "")


def bare(x: Column) -> Column:
    return F.regexp_replace(strip_markup(x), r"^[-\s]+|\s+$", "")


def is_junk_line(x: Column) -> Column:
    """Empty once markup and dashes are gone, only notes, bracketed (closed or not), or a shouted label without words."""
    b = bare(x)
    bracketed = F.lit(False)
    for o, c in BRACKETS:
        bracketed |= b.startswith(o) & (b.endswith(c) | ~b.contains(c))
    label = F.trim(F.split(b, ":", 2)[0])
    return b.rlike(f"^[{NOTES}\\s]*$") | bracketed | (b.rlike(r"(?s)^[^:]*:\s*$") & (label != "") & ~label.rlike("[a-z]"))


def is_credit(x: Column) -> Column:
    low = F.lower(x)
    out = F.lit(False)
    for mark in CREDITS:
        out |= low.contains(mark)
    return out


def is_junk_cue(x: Column) -> Column:
    lines = F.filter(F.split(x, "\n"), lambda l: F.trim(l) != "")
    return (F.size(lines) == 0) | is_credit(x) | F.forall(lines, is_junk_line)


def drop_junk(cues: DataFrame, key: str, least: int = M.MIN_CUES) -> DataFrame:
    """Junk cues become (0, 0) but stay, unless fewer than least real ones would be left."""
    w = Window.partitionBy(key)
    t = cues.withColumn("junk", is_junk_cue(F.col("text"))).withColumn("real", F.sum((~F.col("junk")).cast("long")).over(w))
    zero = F.col("junk") & (F.col("real") >= least)
    return t.withColumns({c: F.when(zero, 0).otherwise(F.col(c)) for c in ("start_ms", "end_ms")}).drop("junk", "real")


def normalized_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(x), "._-[]()+'", "         "), r"\s+", " "))


def name_tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized_name(x), " "), lambda t: t != ""))


def title_tokens(x: Column) -> Column:
    """A subtitle's name without words for languages and kinds."""
    return F.array_except(name_tokens(x), F.array(*map(F.lit, LANGUAGE_WORDS)))


def episode_tag(x: Column) -> Column:
    """'1x2' from S01E02, s1.e2 or 1x02; null if there is none."""
    a, b = r"[sS](\d{1,2})[ ._-]?[eE](\d{1,3})", r"(?<!\d)(\d{1,2})x(\d{2})(?!\d)"
    tag = lambda p: F.concat(F.regexp_extract(x, p, 1).cast("int").cast("string"), F.lit("x"), F.regexp_extract(x, p, 2).cast("int").cast("string"))
    return F.when(x.rlike(a), tag(a)).when(x.rlike(b), tag(b))


def language_name(x: Column, language: str) -> Column:
    """name.xx.srt or name.srt -> name.language.srt"""
    stem, ext = F.regexp_extract(x, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(x, r"(\.[^./]*)$", 1)
    return F.concat(F.regexp_replace(stem, r"\.[^./]{2,3}$", ""), F.lit(f".{language}"), ext)


def keep_markup(original: Column, replacement: Column) -> Column:
    """Leading {overrides} of the original in front of a replacement that has none."""
    return F.when(replacement.startswith("{"), replacement).otherwise(F.concat(F.regexp_extract(original, r"^((?:\{[^}]*\})*)", 1), replacement))


def job_tokens(x: Column) -> Column:
    """Tokens of a job line: white space parts them, except between double quotes, which go."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(r'((?:[^ \t\r"]|"[^"]*(?:"|$))+)'), F.lit(1)), lambda t: F.replace(t, F.lit('"'), F.lit(""))), lambda t: t != "")


def json_escape(x: Column) -> Column:
    return F.expr("substr(to_json(array({0})), 2, length(to_json(array({0}))) - 2)".format("x")) if isinstance(x, str) else F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)


def fnv1a64(x: Column) -> Column:
    """The 64-bit FNV-1a hash of a string's UTF-8 bytes, as decimal(20, 0)."""
    wide = lambda c: c.cast("decimal(38,0)")
    size = F.lit("18446744073709551616").cast("decimal(20,0)")
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(x, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))

    def step(h: Column, b: Column) -> Column:
        low = (h % 256).cast("int")
        return wide(((h - low + low.bitwiseXOR(b)).cast("decimal(20,0)") * F.lit("1099511628211").cast("decimal(13,0)")) % size)

    return F.aggregate(codes, wide(F.lit("14695981039346656037")), step).cast("decimal(20,0)")
