"""Queries on tracks, packets, frames, heard words and sequential folds, each beside the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import text as X
from tempora.operators import intervals as I
from tempora.operators import media as A
from tempora.plans.interval_queries import SWEEP
from tempora.plans.registry import query
from tempora.sources import writers


@query("tracks", sql="select film_id, idx from (select *, row_number() over (partition by film_id order by is_default desc, idx) as k from tracks where kind = 'audio') t where k = 1")
def audio_track(t: DataFrame) -> DataFrame:
    return A.audio_track(t)


@query("tracks", sql="select film_id, idx from (select *, row_number() over (partition by film_id order by idx) as k from tracks where kind = 'audio') t where k = 3")
def audio_track_wanted(t: DataFrame) -> DataFrame:
    return A.audio_track(t, 2)


@query("tracks", sql="select film_id, idx, n_cues from (select *, row_number() over (partition by film_id order by is_default desc, idx) as k from tracks where kind = 'subtitle' and not forced and not impaired and n_cues >= 50) t where k = 1")
def subtitle_track(t: DataFrame) -> DataFrame:
    return A.subtitle_track(t)


@query("packets", sql="""with k as (select film_id, pts_ms, pts_ms - lag(pts_ms) over w as gap, row_number() over w as k from packets window w as (partition by film_id order by pts_ms)),
g as (select film_id, 1000.0e0 / list_sort(list(gap) filter (where gap is not null))[count(gap) // 2 + 1] as fps from k where k <= 240 group by film_id having count(*) >= 30),
r as (select film_id, fps, min(rate) as rate from g left join (select unnest([23.976e0, 24.0e0, 25.0e0, 29.97e0, 30.0e0, 50.0e0, 60.0e0]) as rate) v on abs(fps - rate) < rate * 0.02e0 group by film_id, fps)
select film_id, round(coalesce(rate, fps), 6) as fps from r""")
def measured_fps(p: DataFrame) -> DataFrame:
    return A.measured_fps(p).withColumn("fps", F.round("fps", 6))


@query("frames", sql="""with g as (select film_id, count(*) as n, avg(p) as s, avg(greatest(p, 1 - p)) as d from frames group by film_id)
select film_id, round(case when n < 60 then 0 else d * case when s < 0.15 then s / 0.15 when s > 0.65 then greatest(0, (1 - s) / 0.35) else 1 end end, 6) as score from g""")
def mix_score(f: DataFrame) -> DataFrame:
    return A.mix_score(f, 60).withColumn("score", F.round("score", 6))


@query("tokens", sql="""with j as (select film_id, json_extract_string(token, '$.text') as t, cast(json_extract(token, '$.t_dtw') as bigint) as w from tokens)
select film_id, cast(w * 10 as int) as at_ms from j where not starts_with(t, '[_') and not starts_with(t, '<|') and regexp_matches(t, '[A-Za-z0-9]') and w >= 0""")
def heard_words(t: DataFrame) -> DataFrame:
    return A.heard_words(t)


@query("srt_lines", sql="""with f as (select *, trim(line) = '' as blank, regexp_matches(line, '^\\s*(\\d{1,3}:)?\\d{1,2}:\\d{2}[.,]\\d{1,3}\\s*-->') as tm, regexp_matches(line, '^\\s*\\d+\\s*$') as cn from srt_lines),
g as (select *, coalesce(lag(blank) over w, true) as gap, coalesce(lead(tm) over w, false) as bt, sum(cast(blank as int)) over w as para from f window w as (partition by film_id order by line_no)),
b as (select *, max(cast(not blank and not tm and not cn and gap and regexp_matches(trim(line), '^(WEBVTT|NOTE|STYLE|REGION)\\b') as int)) over (partition by film_id, para order by line_no) as ib from g)
select film_id, line_no, line from b where not blank and not tm and not cn and ib = 0 and not bt""")
def translatable_lines(l: DataFrame) -> DataFrame:
    return A.translatable(l, "film_id")


@query("timeline", sql="""with recursive o as (select film_id, row_number() over (partition by film_id order by start_ms, end_ms, weight) as k, start_ms as s, end_ms as e, weight as w from timeline),
r as (select film_id, k, s, e, w, 1 as g from o where k = 1
 union all select o.film_id, o.k, case when o.s - r.e < 60000 then r.s else o.s end, o.e, case when o.s - r.e < 60000 then (r.w * (r.e - r.s) + o.w * (o.e - o.s)) / greatest(r.e - r.s + o.e - o.s, 1) else o.w end, case when o.s - r.e < 60000 then r.g else r.g + 1 end
 from r join o on o.film_id = r.film_id and o.k = r.k + 1),
l as (select *, row_number() over (partition by film_id, g order by k desc) as last from r)
select film_id, s as start_ms, e as end_ms, round(w, 6) as weight from l where last = 1 and e - s >= 700""")
def gap_glue_weights(t: DataFrame) -> DataFrame:
    return I.fold_glue(t, "film_id", 60_000, 700).withColumn("weight", F.round("weight", 6))


@query("measured", sql="""with recursive o as (select film_id, offset_ms as v, row_number() over (partition by film_id order by offset_ms) as k from measured where sigma >= 3),
r as (select film_id, k, v as kept, true as new from o where k = 1 union all select o.film_id, o.k, case when abs(o.v - r.kept) > 500 then o.v else r.kept end, abs(o.v - r.kept) > 500 from r join o on o.film_id = r.film_id and o.k = r.k + 1)
select film_id, cast(row_number() over (partition by film_id order by k) - 1 as int) as anchor_no, kept as offset_ms from r where new""")
def anchors_apart(m: DataFrame) -> DataFrame:
    return I.apart(m, "film_id", "offset_ms", "sigma", 500, 3.0)


@query("frames", sql="""with recursive r as (select film_id, frame_no, 0.05e0 * 0.9e0 + p * 0.1e0 as level from frames where frame_no = 1 union all select f.film_id, f.frame_no, r.level * 0.9e0 + f.p * 0.1e0 from r join frames f on f.film_id = r.film_id and f.frame_no = r.frame_no + 1)
select film_id, frame_no, round(level, 6) as level, round(least(greatest(0.05e0 / greatest(level, 1e-5), 0.5), 40.0), 6) as gain from r""")
def moving_level(f: DataFrame) -> DataFrame:
    return I.levels(f, "film_id", "frame_no", "p", 0.05, 0.9).withColumns({c: F.round(c, 6) for c in ("level", "gain")})


@query("near_cues", "points", sql="select film_id, cue_no, start_ms, end_ms from near_cues c where exists (select 1 from points p where p.film_id = c.film_id and p.at_ms between c.start_ms - 2000 and c.end_ms + 2000)")
def hinted(c: DataFrame, p: DataFrame) -> DataFrame:
    """Intervals with a mark within 2 s of them."""
    return I.near_semi(c, p, "film_id", 2000)


@query("timeline", "near_cues", sql="""with d as (select unnest(range(-900, 901, 100)) as x), s as (select film_id, x, sum(weight * (least(t.end_ms, c.end_ms + x) - greatest(t.start_ms, c.start_ms + x)) / greatest(t.end_ms - t.start_ms, c.end_ms - c.start_ms)) as s from timeline t join near_cues c using (film_id), d where t.start_ms < c.end_ms + x and c.start_ms + x < t.end_ms group by film_id, x),
k as (select *, row_number() over (partition by film_id order by round(s, 6) desc, x) as k from s) select film_id, cast(x as int) as offset_ms, round(s, 4) as score from k where k = 1""")
def local_refine(t: DataFrame, c: DataFrame) -> DataFrame:
    return I.refine(t, c, "film_id", 900, 100)


@query("timeline", "cues", sql="with c2 as (select film_id * 2 + case when cue_no > 30 then 1 else 0 end as film_id, start_ms, end_ms from cues), t2 as (select film_id * 2 + unnest([0, 1]) as film_id, start_ms, end_ms, weight from timeline), " + SWEEP.format(ref="t2", cues="c2") + "select film_id // 2 as film_id, cast(film_id % 2 as int) as part, x as offset_ms, round(f, 4) as score from be where k = 1")
def part_offsets(t: DataFrame, c: DataFrame) -> DataFrame:
    """The offset of each part of timelines that were joined from two."""
    parts = c.select((F.col("film_id") * 2 + (F.col("cue_no") > 30).cast("int")).alias("film_id"), "start_ms", "end_ms")
    both = t.select("film_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"), "start_ms", "end_ms", "weight").withColumn("film_id", F.col("film_id") * 2 + F.col("part")).drop("part")
    return I.sweep(both, parts, "film_id").select(F.floor(F.col("film_id") / 2).alias("film_id"), (F.col("film_id") % 2).cast("int").alias("part"), "offset_ms", "score")


@query("timeline", "cues", sql="with " + SWEEP.format(ref="timeline", cues="cues") + """, li2 as (select film_id, x, f, lead(x) over (partition by film_id order by x) as nx, lead(f) over (partition by film_id order by x) as nf from cu),
g as (select film_id, x, f, nx, nf, unnest(range(cast(ceil(greatest(x, -60000) / 1000.0) as int) * 1000, least(coalesce(nx, x + 1), 60001), 1000)) as at_x from li2 where x <= 60000 and coalesce(nx, x + 1) > -60000)
select film_id, cast(at_x as int) as offset_ms, round(case when nx is null then f else f + (nf - f) * (at_x - x) / (nx - x) end + 1e-7, 4) as score from g""")
def score_curve(t: DataFrame, c: DataFrame) -> DataFrame:
    """The overlap score at every second of offset within a minute, from the slope events."""
    return I.curve(t, c, "film_id", 60_000, 1000)


_EMBEDDED = """with c as (select film_id, cue_no * 1000 % 7000 as s, cue_no * 1000 % 7000 + 900 as e, case when trim(regexp_replace(text, '[^A-Za-z .]', '', 'g')) = '' then 'x' else trim(regexp_replace(text, '[^A-Za-z .]', '', 'g')) end as t from lines),
k as (select *, row_number() over (partition by film_id order by s, e, t) as k from c)
select 'f' || film_id as path, string_agg(k || chr(10) || '00:00:0' || (s // 1000) || ',000 --> 00:00:0' || (e // 1000) || ',900' || chr(10) || t || chr(10), chr(10) order by k) || chr(10) as text from k group by film_id"""


@query("lines", sql=_EMBEDDED)
def embedded_text(l: DataFrame) -> DataFrame:
    """Packets of an embedded track in time order, renumbered and written as one file."""
    t = F.trim(F.regexp_replace("text", X.NO_LETTERS, ""))
    start = F.col("cue_no") * 1000 % 7000
    c = l.select(F.concat(F.lit("f"), F.col("film_id").cast("string")).alias("path"), start.alias("start_ms"), (start + 900).alias("end_ms"), F.when(t == "", "x").otherwise(t).alias("text"))
    k = F.row_number().over(Window.partitionBy("path").orderBy("start_ms", "end_ms", "text")) - 1
    return writers.to_srt(c.withColumn("cue_no", k))
