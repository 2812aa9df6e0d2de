"""Queries on decisions, job states, hashes, charsets and signals, each beside the same query in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import text as X
from tempora.operators import align
from tempora.operators import catalog as C
from tempora.operators import intervals as I
from tempora.plans.registry import query
from tempora.sources import binary, store, subtitles


@query("timeline", sql="""with m as (select film_id, span_no, cast(round(start_ms * (1 - 0.002e0) - 900000.0e0) as int) + span_no as s, cast(round(end_ms * (1 - 0.002e0) - 900000.0e0) as int) + span_no as e from timeline)
select film_id, span_no, s + greatest(-s, 0) as start_ms, e + greatest(-s, 0) as end_ms from m""")
def shift_both_ends(t: DataFrame) -> DataFrame:
    """Cues moved a quarter of an hour back: those that would begin before zero slide to it with their length."""
    return I.apply_shift(t.withColumn("offset_ms", F.col("span_no")), -0.002, -900.0).select("film_id", "span_no", "start_ms", "end_ms")


@query("timeline", sql="select film_id, span_no, start_ms, least(end_ms, start_ms + 1200) as end_ms from timeline")
def clamp_long(t: DataFrame) -> DataFrame:
    return I.clamp(t, 1200).select("film_id", "span_no", "start_ms", "end_ms")


@query("timeline", sql="""with o as (select film_id, start_ms, end_ms, case when start_ms >= max(end_ms) over (partition by film_id order by start_ms, end_ms, span_no rows between unbounded preceding and 1 preceding) then 1 when row_number() over (partition by film_id order by start_ms, end_ms, span_no) = 1 then 1 else 0 end as new from timeline)
select film_id, cast(sum(new) as bigint) as spans, sum(new) >= 66 as enough from o group by film_id""")
def enough_cues(t: DataFrame) -> DataFrame:
    """Whether a timeline has spans enough, merged, to be aligned."""
    m = I.merge(t, "film_id", "span_no").groupBy("film_id").agg(F.count(F.lit(1)).alias("spans"))
    return m.withColumn("enough", F.col("spans") >= 66)


@query("measured", sql="""with e as (select film_id, slice_no, offset_ms + case when slice_no % 3 = 0 then 500 else slice_no * 50 end as x from measured where slice_no < 6)
select film_id, cast(count(*) filter (where abs(offset_ms - x) <= 400) as bigint) as agreed, count(*) as total, count(*) filter (where abs(offset_ms - x) <= 400) / cast(count(*) as double) as ratio from measured left join e using (film_id, slice_no) group by film_id""")
def agreeing_slices(m: DataFrame) -> DataFrame:
    """Slices that lie where they are expected, by number; a slice without an expectation doesn't."""
    e = m.where("slice_no < 6").select("film_id", "slice_no", (F.col("offset_ms") + F.when(F.col("slice_no") % 3 == 0, 500).otherwise(F.col("slice_no") * 50)).alias("offset_ms"))
    return I.agreement(m, e, "film_id")


@query("measured", sql="""with p as (select *, case when film_id % 3 = 0 then 'unsure' else 'solid' end as v, [0, cast(film_id % 7 * 400 as int)] as o from measured),
b as (select film_id, v, abs(offset_ms) <= 900000 and sigma >= 4 and not list_contains(list_transform(o, lambda x: abs(x - offset_ms) <= 2000), true) and (list_contains(list_transform(o, lambda x: abs(x - offset_ms) <= 45000), true) or sigma >= 5) as bad from p)
select film_id, case when v = 'solid' and bool_or(bad) then 'unsure' else v end as verdict, bool_or(bad) as contradicted from b group by film_id, v""")
def judge_parts(m: DataFrame) -> DataFrame:
    """Solid verdicts that a sure slice contradicts."""
    p = m.withColumn("verdict", F.when(F.col("film_id") % 3 == 0, "unsure").otherwise("solid")).withColumn("offsets", F.array(F.lit(0), (F.col("film_id") % 7 * 400).cast("int")))
    return C.judged_parts(p)


@query("jobs", sql="select id, case when id % 7 = 0 or v = 'solid' then 'write' when id % 3 = 0 then 'keep' else 'beside' end as settled from (select id, case when confidence >= 15 then 'solid' when confidence >= 9 then 'unsure' else 'nothing' end as v from jobs) t")
def settle_writes(j: DataFrame) -> DataFrame:
    """What is written under force and strict."""
    v = F.when(F.col("confidence") >= 15, "solid").when(F.col("confidence") >= 9, "unsure").otherwise("nothing")
    return j.select("id", C.settle(v, F.col("id") % 7 == 0, F.col("id") % 3 == 0).alias("settled"))


@query("timeline", sql="select film_id, span_no, greatest(cast(round(start_ms * 1.04e0 + -1500.0e0) as int), 0) as start_ms, cast(round(end_ms * 1.04e0 + -1500.0e0) as int) + greatest(-cast(round(start_ms * 1.04e0 + -1500.0e0) as int), 0) as end_ms from timeline")
def manual_shift(t: DataFrame) -> DataFrame:
    """A ratio and a shift given by hand."""
    return align.by_hand(t, 1.04, -1500).select("film_id", "span_no", "start_ms", "end_ms")


@query("jobs", sql="""with j as (select *, cast(id % 1000 as double) as m, case cast(id % 5 as int) when 0 then null when 1 then 'done' when 2 then 'lowconf' when 3 then 'failed' else 'timeout' end as o, id % 1000 + case when id % 4 = 0 then 9 else 0 end as seen from jobs),
t as (select *, case when o is null then attempts when abs(seen - m) > 1 then 1 else attempts + 1 end as tries from j)
select id, case when o is null then status when o in ('done', 'lowconf') then o when tries < 3 then 'queued' else 'failed' end as status, cast(tries as int) as attempts, case when o is null then m else cast(seen as double) end as srt_mtime from t""")
def job_transitions(j: DataFrame) -> DataFrame:
    """Jobs after a round of runs: done, asked back, queued again or given up."""
    jobs = j.select("id", "status", "attempts", (F.col("id") % 1000).cast("double").alias("srt_mtime"))
    kind = F.element_at(F.array(*map(F.lit, ("done", "lowconf", "failed", "timeout"))), (F.col("id") % 5).cast("int"))
    out = j.where("id % 5 <> 0").select("id", kind.alias("outcome"), (F.col("id") % 1000 + F.when(F.col("id") % 4 == 0, 9).otherwise(0)).cast("double").alias("mtime"))
    return C.after_run(jobs, out)


@query("jobs", sql="select id, 1704067200 - id * 1000 as used_s from jobs where id * 1000 <= 30 * 86400")
def cache_eviction(j: DataFrame) -> DataFrame:
    cache = j.select("id", (F.lit(1704067200) - F.col("id") * 1000).alias("used_s"))
    return C.fresh(cache, F.lit(1704067200))


@query("timeline", sql="""with l as (select film_id as job, span_no, cast(span_no % 40 * 2.5e0 as double) as p, case when span_no % 2 = 0 then 'read' else 'search' end as s, span_no >= 70 as d from timeline where span_no % 6 <> 0)
select job, max(p) as percent, arg_max(s, span_no) as stage, bool_or(d) as done from l group by job""")
def progress_lines(t: DataFrame) -> DataFrame:
    """Progress reports as lines of JSON; some are noise."""
    line = F.when(F.col("span_no") % 6 == 0, F.lit("loading model ...")).otherwise(F.to_json(F.struct(F.when(F.col("span_no") % 2 == 0, "read").otherwise("search").alias("stage"), (F.col("span_no") % 40 * 2.5).alias("percent"), (F.col("span_no") >= 70).alias("done"))))
    return C.progress(t.select(F.col("film_id").alias("job"), F.col("span_no").alias("line_no"), line.alias("line")))


@query("jobs", sql="select id, status, confidence from jobs where id in (7, 70, 700) or video_path = '/m/5/v5.mkv'")
def point_selects(j: DataFrame) -> DataFrame:
    """Rows by a list of ids and by a key."""
    return j.where(F.col("id").isin(7, 70, 700) | (F.col("video_path") == "/m/5/v5.mkv")).select("id", "status", "confidence")


@query("documents", sql="select doc_id, octet_length(encode(text)) as size from documents where octet_length(encode(text)) > 0 and octet_length(encode(text)) < 4000")
def worth_sniffing(d: DataFrame) -> DataFrame:
    """Files of a size that is worth a look inside."""
    return d.select("doc_id", F.octet_length("text").cast("long").alias("size")).where((F.col("size") > 0) & (F.col("size") < 4000))


@query("marks", sql="select distinct film_id, cast(at_ms // 60000 as int) as minute from marks where shown")
def distinct_minutes(m: DataFrame) -> DataFrame:
    """Sorted unique points of each timeline."""
    return m.where("shown").select("film_id", F.floor(F.col("at_ms") / 60_000).cast("int").alias("minute")).distinct()


@query("lines", sql="select film_id, cue_no from (select film_id, cue_no, row_number() over (partition by film_id order by cue_no) as k from lines) t where k <= 6")
def preview_rows(l: DataFrame) -> DataFrame:
    """The first six cues of each file, as a preview shows them."""
    return l.withColumn("k", F.row_number().over(Window.partitionBy("film_id").orderBy("cue_no"))).where("k <= 6").select("film_id", "cue_no")


@query("jobs", sql="""select id, list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(1, len(video_path) + 1), lambda i: ascii(video_path[i])::uhugeint)),
 lambda h, b: ((h - h % 256) + xor((h % 256)::int, b::int)::uhugeint) * 1099511628211::uhugeint % 18446744073709551616::uhugeint)::varchar as hash from jobs""")
def fnv_fingerprint(j: DataFrame) -> DataFrame:
    """The hash that names a file's cache entry."""
    return j.select("id", X.fnv1a64(F.col("video_path")).cast("string").alias("hash"))


@query("lines", sql="""with c as (select film_id, cue_no, trim(regexp_replace(text, '[^A-Za-z .]', '', 'g')) || ' Hélló ñ' as t from lines)
select film_id, cue_no, k as charset, t as text from c, (select unnest(['utf8', 'bom', 'utf16le', 'utf16le-bom', 'utf16be', 'utf16be-bom', 'latin1']) as k) v""")
def charsets(l: DataFrame) -> DataFrame:
    """Bytes in seven encodings, told apart and decoded."""
    t = F.concat(F.trim(F.regexp_replace("text", X.NO_LETTERS, "")), F.lit(" Hélló ñ"))
    in_ = lambda kind: F.encode("t", kind)
    with_mark = lambda mark, kind: F.concat(F.unhex(F.lit(mark)), in_(kind))
    kinds = {"utf8": in_("UTF-8"), "bom": with_mark("EFBBBF", "UTF-8"), "utf16le": in_("UTF-16LE"), "utf16le-bom": with_mark("FFFE", "UTF-16LE"), "utf16be": in_("UTF-16BE"), "utf16be-bom": with_mark("FEFF", "UTF-16BE"), "latin1": in_("ISO-8859-1")}
    each = l.withColumn("t", t).select("film_id", "cue_no", F.explode(F.array(*[F.struct(F.lit(k).alias("charset"), v.alias("bytes")) for k, v in kinds.items()])).alias("x"))
    return each.select("film_id", "cue_no", "x.charset", subtitles.decode(F.col("x.bytes")).alias("text"))


_RASTER = "select film_id, (start_ms + {d}) // 1000 as bin, sum(weight) as value from timeline where span_no % {m} <> 0 group by 1, 2"


@query("timeline", sql=f"""with a as ({_RASTER.format(d=0, m=7)}), b as ({_RASTER.format(d=33000, m=5)}), s as (select a.film_id, a.bin - b.bin as lag, sum(a.value * b.value) as score from a join b on a.film_id = b.film_id and abs(a.bin - b.bin) <= 300 group by a.film_id, a.bin - b.bin)
select film_id, lag, round(score, 6) as score from s""")
def cross_correlation(t: DataFrame) -> DataFrame:
    """Onsets of two copies of a timeline, a second a bin, correlated at every lag within five minutes."""
    raster = lambda d, m: t.where(F.col("span_no") % m != 0).groupBy("film_id", F.floor((F.col("start_ms") + d) / 1000).alias("bin")).agg(F.sum("weight").alias("value"))
    return I.cross_correlation(raster(0, 7), raster(33_000, 5), "film_id", 300).withColumn("score", F.round("score", 6))


@query("timeline", sql=f"""with a as ({_RASTER.format(d=0, m=7)}), b as ({_RASTER.format(d=33000, m=5)}), s as (select a.film_id, a.bin - b.bin as lag, round(sum(a.value * b.value), 6) as score from a join b on a.film_id = b.film_id and abs(a.bin - b.bin) <= 300 group by a.film_id, a.bin - b.bin)
select film_id, cast(lag as int) as lag, score from (select *, row_number() over (partition by film_id order by score desc, lag) as k from s) t where k = 1""")
def fft_peak(t: DataFrame) -> DataFrame:
    """The same by Fourier transforms, a timeline a group: the best lag and its score."""
    side = lambda d, m, name: t.where(F.col("span_no") % m != 0).groupBy("film_id", F.floor((F.col("start_ms") + d) / 1000).alias("bin")).agg(F.sum("weight").alias("value")).withColumn("side", F.lit(name))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["side"] == k] for k in (0, 1))
        score = align.fft_lags(*(x[c].to_numpy() for x in (a, b) for c in ("bin", "value")), 300).round(6)
        best = int(score.argmax())
        return pd.DataFrame([(int(pdf["film_id"].iat[0]), best - 300, float(score[best]))], columns=["film_id", "lag", "score"])

    return side(0, 7, 0).unionByName(side(33_000, 5, 1)).groupBy("film_id").applyInPandas(run, "film_id long, lag int, score double")


@query("timeline", sql="""with c as (select film_id, span_no, case when span_no > 30 then 40000 else 0 end as by_ms, start_ms, end_ms from timeline where span_no % 5 <> 0),
k as (select film_id, row_number() over (partition by film_id order by span_no) as k, start_ms + by_ms as s, end_ms + by_ms as e from c),
kx as (select film_id, k, x, s + x as cs, e + x as ce from k cross join (select unnest(range(-60000, 60001, 5000)) as x) g),
hit as (select kx.film_id, k, x, sum((least(t.end_ms, ce) - greatest(t.start_ms, cs)) / greatest(t.end_ms - t.start_ms, ce - cs)) as v from kx join timeline t on t.film_id = kx.film_id and t.start_ms < ce and t.end_ms > cs group by kx.film_id, k, x),
v as (select film_id, k, x, coalesce(hit.v, 0) as v from kx left join hit using (film_id, k, x)),
w as (select film_id, k, list(v order by x) as v from v group by film_id, k),
r as (select film_id, k, v as best from w where k = 1 union all
 select w.film_id, w.k, list_transform(range(1, 26), lambda i: greatest(r.best[i], list_max(r.best) - 6) + w.v[i]) as best from r join w on w.film_id = r.film_id and w.k = r.k + 1)
select film_id, round(list_max(best), 3) as best from (select *, row_number() over (partition by film_id order by k desc) as z from r) t where z = 1""".replace("with c as", "with recursive c as"))
def split_value(t: DataFrame) -> DataFrame:
    """What the best division of a timeline into parts with offsets of their own is worth: keeping an offset is free, another costs 6."""
    c = t.where("span_no % 5 <> 0").select("film_id", F.col("span_no").alias("no"), *((F.col(x) + F.when(F.col("span_no") > 30, 40_000).otherwise(0)).alias(x) for x in ("start_ms", "end_ms")))
    both = t.select("film_id", F.lit(0).alias("side"), F.col("span_no").alias("no"), "start_ms", "end_ms").union(c.select("film_id", F.lit(1), "no", "start_ms", "end_ms"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, q = pdf[pdf["side"] == 0].sort_values(["start_ms", "end_ms"]), pdf[pdf["side"] == 1].sort_values("no")
        ref = (r["start_ms"].to_numpy(float), r["end_ms"].to_numpy(float), np.ones(len(r)))
        got = align.split_value(ref, (q["start_ms"].to_numpy(float), q["end_ms"].to_numpy(float)), 0, 60_000, 5000, 9.0)
        return pd.DataFrame([(int(pdf["film_id"].iat[0]), round(got, 3))], columns=["film_id", "best"])

    return both.groupBy("film_id").applyInPandas(run, "film_id long, best double")


@query("timeline", sql="""with s as (select film_id, span_no, case when span_no < 30 then weight else 0.2 end as low, case when span_no < 30 then 0.2 else weight end as high, coalesce(start_ms - lag(end_ms) over (partition by film_id order by span_no), 0) as gap from timeline),
t as (select *, row_number() over p as no, coalesce(sum(low) over (partition by film_id order by span_no rows between unbounded preceding and 1 preceding), 0) + sum(high) over (partition by film_id order by span_no rows between current row and unbounded following) as total from s window p as (partition by film_id order by span_no))
select film_id, span_no as cut from (select *, row_number() over (partition by film_id order by round(total, 6) desc, gap desc, abs(no - 25), no) as k from t where abs(no - 25) <= 20 and no > 1) q where k = 1""")
def settled_boundary(t: DataFrame) -> DataFrame:
    """A cut moved to where it is worth most, within twenty cues."""
    gap = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(Window.partitionBy("film_id").orderBy("span_no")), F.lit(0))
    early = F.col("span_no") < 30
    s = t.withColumn("gap", gap).withColumn("low", F.when(early, F.col("weight")).otherwise(0.2)).withColumn("high", F.when(early, 0.2).otherwise(F.col("weight"))).withColumn("at", F.lit(25))
    return I.settled_cut(s, "film_id", "span_no", "low", "high", "gap", "at", 20)


@query("timeline", sql="""with f as (select film_id, span_no - 1 as frame_no, case when span_no % 4 = 0 then 0 else cast(round(weight * 8000) as int) end as a from timeline),
l as (select film_id, list_sort(list(a))[cast(count(*) * 9 // 10 as int) + 1] as loud from f group by film_id)
select 'f' || film_id as path, cast(frame_no as int) as frame_no, round(least(1.0e0, a / greatest(cast(loud as double), 1e-9)), 6) as p from f join l using (film_id)""")
def wav_frames(t: DataFrame) -> DataFrame:
    """A WAV file of square waves for each timeline, written, read and turned into speech frames."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.sort_values("span_no")
        loud = np.where(c["span_no"] % 4 == 0, 0, np.floor(c["weight"] * 8000 + 0.5))
        wave = np.repeat(loud, 160) * np.tile([1, -1], 80 * len(c))
        return pd.DataFrame({"path": [f"f{c['film_id'].iat[0]}"], "content": [binary.wav(wave)]})

    files = t.select("film_id", "span_no", "weight").groupBy("film_id").applyInPandas(make, "path string, content binary")
    return binary.speech_frames(files).withColumn("p", F.round("p", 6))


_SAVES = "select 'f' || film_id as path, text, 1 + cue_no as version from lines where cue_no < 4"


@query("lines", sql=f"""with s as ({_SAVES}), g as (select path, arg_min(text, version) as text, max(version) as last, min(version) as first from s group by path)
select path, text from g where last > first""")
def undo_saves(l: DataFrame) -> DataFrame:
    """What an undo brings back: each changed file as it was at first."""
    saves = l.where("cue_no < 4").select(F.concat(F.lit("f"), F.col("film_id")).alias("path"), "text", (F.col("cue_no") + 1).cast("long").alias("version"))
    return store.undone(saves, saves)


@query("lines", sql=f"with s as ({_SAVES}) select path, arg_max(text, version) as text, cast(max(version) as bigint) as version from s group by path")
def saved_files(l: DataFrame) -> DataFrame:
    """The latest save of each file."""
    saves = l.where("cue_no < 4").select(F.concat(F.lit("f"), F.col("film_id")).alias("path"), "text", (F.col("cue_no") + 1).cast("long").alias("version"))
    return store.latest(saves)


@query("timeline", sql=f"""with a as ({_RASTER.format(d=0, m=7)}), b as ({_RASTER.format(d=33000, m=5)}), s as (select a.film_id, a.bin - b.bin as lag, round(sum(a.value * b.value), 6) as score from a join b on a.film_id = b.film_id and abs(a.bin - b.bin) <= 300 group by a.film_id, a.bin - b.bin),
p1 as (select film_id, lag, score from (select *, row_number() over (partition by film_id order by score desc, lag) as k from s) t where k = 1),
p2 as (select film_id, lag, score from (select s.*, row_number() over (partition by s.film_id order by s.score desc, s.lag) as k from s join p1 using (film_id) where abs(s.lag - p1.lag) > 5) t where k = 1),
p3 as (select film_id, lag, score from (select s.*, row_number() over (partition by s.film_id order by s.score desc, s.lag) as k from s join p1 using (film_id) join p2 using (film_id) where abs(s.lag - p1.lag) > 5 and abs(s.lag - p2.lag) > 5) t where k = 1)
select film_id, cast(k as int) as place, lag, score from (select *, 1 as k from p1 union all select *, 2 from p2 union all select *, 3 from p3) q""")
def top_peaks(t: DataFrame) -> DataFrame:
    """The three highest lags, each keeping five on either side from being chosen."""
    raster = lambda d, m: t.where(F.col("span_no") % m != 0).groupBy("film_id", F.floor((F.col("start_ms") + d) / 1000).alias("bin")).agg(F.sum("weight").alias("value"))
    curve = I.cross_correlation(raster(0, 7), raster(33_000, 5), "film_id", 300).withColumn("score", F.round("score", 6))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        score = np.full(601, -np.inf)
        score[pdf["lag"].to_numpy() + 300] = pdf["score"]
        got = align.peaks(np.arange(-300, 301), score, 3, 5)
        return pd.DataFrame([(int(pdf["film_id"].iat[0]), i + 1, lag, z) for i, (lag, z) in enumerate(got)], columns=["film_id", "place", "lag", "score"])

    return curve.groupBy("film_id").applyInPandas(run, "film_id long, place int, lag long, score double")


@query("lines", sql="""with f as (select film_id, count(*) as n, case cast(film_id % 4 as int) when 0 then 24.0e0 when 1 then 25.0e0 when 2 then 30.0e0 else 23.976e0 end as rate from lines group by film_id)
select 'f' || film_id as path, cast(floor(48 * 1000.0e0 / rate + 0.5) as int) as start_ms, cast(floor((48 + n) * 1000.0e0 / rate + 0.5) as int) as end_ms from f""")
def frame_rates(l: DataFrame) -> DataFrame:
    """Frames read at the rate that a file's first line gives, or at the usual one if it gives none that can be."""
    told = F.element_at(F.array(*map(F.lit, ("{1}{1}24.000\n", "{1}{1}25\n", "{0}{0}30,0\n", "{1}{1}500\n"))), (F.col("film_id") % 4 + 1).cast("int"))
    f = l.groupBy("film_id").agg(F.count(F.lit(1)).alias("n"))
    texts = f.select(F.concat(F.lit("f"), F.col("film_id")).alias("path"), F.concat(told, F.lit("{48}{"), (F.col("n") + 48).cast("string"), F.lit("}x\n")).alias("text"))
    return subtitles.read_sub(texts).select("path", "start_ms", "end_ms")


@query("jobs", sql="select id, status, cast(null as double) as slope, cast(null as bigint) as intercept_ms, attempts from jobs where status = 'failed'")
def schema_evolution(j: DataFrame) -> DataFrame:
    """A table of an older version brought up to the columns of now; doing it twice changes nothing."""
    old = j.where("status = 'failed'").select("id", "status", "attempts")
    wanted = "id long, status string, slope double, intercept_ms long, attempts int"
    return C.evolved(C.evolved(old, wanted), wanted)
