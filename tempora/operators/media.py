"""Tracks, packets, frames and heard words of films, as plans over their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.intervals import upper_median

#: Rates that films are shot at; a measured one within 2 % is taken for it.
SHOT_RATES = (23.976, 24.0, 25.0, 29.97, 30.0, 50.0, 60.0)


def audio_track(tracks: DataFrame, wanted: int | None = None) -> DataFrame:
    """film_id, idx: the wanted-th audio track; without a wish the first default one, else the first."""
    t = tracks.where("kind = 'audio'")
    if wanted is not None:
        k = F.row_number().over(Window.partitionBy("film_id").orderBy("idx"))
        return t.withColumn("k", k).where(F.col("k") == wanted + 1).select("film_id", "idx")
    return t.groupBy("film_id").agg(F.min(F.struct((~F.col("is_default")).alias("later"), "idx")).alias("best")).select("film_id", "best.idx")


def subtitle_track(tracks: DataFrame, least: int = 50) -> DataFrame:
    """film_id, idx, n_cues: the first subtitle track with enough cues, default ones first; forced ones and those for the hearing impaired don't count."""
    t = tracks.where("kind = 'subtitle' and not forced and not impaired").where(F.col("n_cues") >= least)
    return t.groupBy("film_id").agg(F.min(F.struct((~F.col("is_default")).alias("later"), "idx", "n_cues")).alias("best")).select("film_id", "best.idx", "best.n_cues")


def measured_fps(packets: DataFrame, first: int = 240, least: int = 30) -> DataFrame:
    """film_id, fps: from the upper-median gap of the first packets, on a known rate if nearly on one."""
    w = Window.partitionBy("film_id").orderBy("pts_ms")
    p = packets.withColumn("k", F.row_number().over(w)).where(F.col("k") <= first).withColumn("gap", F.col("pts_ms") - F.lag("pts_ms").over(w))
    g = p.groupBy("film_id").agg(F.count(F.lit(1)).alias("n"), upper_median("gap").alias("mid")).where((F.col("n") >= least) & (F.col("mid") > 0)).withColumn("fps", 1000.0 / F.col("mid"))
    known = F.coalesce(*[F.when(F.abs(F.col("fps") - r) < r * 0.02, F.lit(r)) for r in SHOT_RATES])
    return g.select("film_id", F.coalesce(known, F.col("fps")).alias("fps"))


def mix_score(frames: DataFrame, least: int = 600) -> DataFrame:
    """film_id, score: how decided the frames are, times how plausible their share of speech is."""
    g = frames.groupBy("film_id").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("share"), F.avg(F.greatest(F.col("p"), 1 - F.col("p"))).alias("decided"))
    plausible = F.when(F.col("share") < 0.15, F.col("share") / 0.15).when(F.col("share") > 0.65, F.greatest(F.lit(0.0), (1 - F.col("share")) / 0.35)).otherwise(1.0)
    return g.select("film_id", F.when(F.col("n") < least, 0.0).otherwise(F.col("decided") * plausible).alias("score"))


def heard_words(tokens: DataFrame) -> DataFrame:
    """film_id, at_ms of JSON tokens {text, t_dtw} (hundredths of a second) that are words: no marks, at least a letter or digit, a time of zero or more."""
    j = tokens.select("film_id", F.from_json("token", "text string, t_dtw bigint").alias("j")).select("film_id", "j.*")
    word = ~F.col("text").startswith("[_") & ~F.col("text").startswith("<|") & F.col("text").rlike("[A-Za-z0-9]") & (F.col("t_dtw") >= 0)
    return j.where(word).select("film_id", (F.col("t_dtw") * 10).cast("int").alias("at_ms"))


def translatable(lines: DataFrame, key: str) -> DataFrame:
    """Lines (key, line_no, line) that hold dialogue: no times, counters, cue ids, headers or blocks of notes and styles."""
    w = Window.partitionBy(key).orderBy("line_no")
    timing, blank = r"^\s*(\d{1,3}:)?\d{1,2}:\d{2}[.,]\d{1,3}\s*-->", F.trim("line") == ""
    is_time, counter = F.col("line").rlike(timing), F.col("line").rlike(r"^\s*\d+\s*$")
    t = lines.withColumns({"blank": blank, "skip": is_time | counter, "gap": F.coalesce(F.lag(blank).over(w), F.lit(True)), "before_time": F.coalesce(F.lead(is_time).over(w), F.lit(False))})
    t = t.withColumn("para", F.sum(F.col("blank").cast("int")).over(w))
    opens = ~F.col("blank") & ~F.col("skip") & F.col("gap") & F.trim("line").rlike(r"^(WEBVTT|NOTE|STYLE|REGION)\b")
    t = t.withColumn("in_block", F.max(opens.cast("int")).over(Window.partitionBy(key, "para").orderBy("line_no")))
    return t.where("not blank and not skip and in_block = 0 and not before_time").select(key, "line_no", "line")
