"""Queries on texts, time codes, jobs and the library, each beside the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import text as X
from tempora.functions import times as T
from tempora.operators import catalog as C
from tempora.plans.registry import query

BARE = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<[^<>]*>|\\{{[^{{}}]*\\}}', '', 'g'), '<[^<>]*>|\\{{[^{{}}]*\\}}', '', 'g'), '<[^<>]*>|\\{{[^{{}}]*\\}}', '', 'g'), '[>}}]', '', 'g'), '^[-\\s]+|\\s+$', '', 'g')"""
_CREDIT = " or ".join(f"contains(lower(text), '{m}')" for m in X.CREDITS)
_JUNK = f"(regexp_full_match(b, '[{X.NOTES}\\s]*') or " + " or ".join(f"(starts_with(b, '{o}') and (ends_with(b, '{c}') or not contains(b, '{c}')))" for o, c in X.BRACKETS) + " or (regexp_full_match(b, '[^:]*:\\s*') and trim(split_part(b, ':', 1)) <> '' and not regexp_matches(trim(split_part(b, ':', 1)), '[a-z]')))"


@query("lines", sql=f"with b as (select *, {BARE.format(x='text')} as b from lines) select film_id, cue_no, (trim(text) = '' or {_CREDIT} or {_JUNK}) as junk from b")
def junk_cues(l: DataFrame) -> DataFrame:
    return l.select("film_id", "cue_no", X.is_junk_cue(F.col("text")).alias("junk"))


@query("lines", sql=f"""with b as (select *, {BARE.format(x='text')} as b from lines), j as (select film_id, cue_no, (trim(text) = '' or {_CREDIT} or {_JUNK}) as junk from b), r as (select *, count(*) filter (where not junk) over (partition by film_id) as n from j)
select film_id, cue_no, case when junk and n >= 10 then 0 else cue_no * 1000 + 5 end as start_ms, case when junk and n >= 10 then 0 else cue_no * 1000 + 905 end as end_ms from r""")
def drop_junk_cues(l: DataFrame) -> DataFrame:
    return X.drop_junk(l.withColumn("start_ms", F.col("cue_no") * 1000 + 5).withColumn("end_ms", F.col("cue_no") * 1000 + 905), "film_id").drop("text")


CLOCK = T.CLOCK


@query("stamps", sql=f"""with g as (select film_id, span_no, regexp_extract(stamp, '{CLOCK}', 1)::bigint * 3600000 + regexp_extract(stamp, '{CLOCK}', 2)::bigint * 60000 + regexp_extract(stamp, '{CLOCK}', 3)::bigint * 1000 + rpad(regexp_extract(stamp, '{CLOCK}', 4), 3, '0')::bigint as ms from stamps)
select film_id, span_no, cast(case when ms > 86400000 then -1 else ms end as int) as ms from g""")
def parse_timestamp(s: DataFrame) -> DataFrame:
    return s.select("film_id", "span_no", T.parse_timestamp(F.col("stamp")).alias("ms"))


def _clock(mark: str, digits: int) -> str:
    unit, per = 10 ** (3 - digits), 10**digits
    t = f"((start_ms + {unit // 2}) // {unit})"
    return f"lpad(cast({t} // {3600 * per} as varchar), 2, '0') || ':' || lpad(cast({t} // {60 * per} % 60 as varchar), 2, '0') || ':' || lpad(cast({t} // {per} % 60 as varchar), 2, '0') || '{mark}' || lpad(cast({t} % {per} as varchar), {digits}, '0')"


@query("timeline", sql=f"select film_id, span_no, {_clock(',', 3)} as srt, {_clock('.', 3)} as vtt, {_clock('.', 2)} as ass, (start_ms + 50) // 100 as tenths, cast(floor(start_ms * 23.976e0 / 1000.0 + 0.5) as int) as frames from timeline")
def format_timestamp(t: DataFrame) -> DataFrame:
    s = F.col("start_ms")
    return t.select("film_id", "span_no", T.clock(s).alias("srt"), T.clock(s, ".").alias("vtt"), T.clock(s, ".", 2).alias("ass"), T.ms_to_tenths(s).alias("tenths"), T.ms_to_frames(s, 23.976).alias("frames"))


@query("timeline", sql="""with f as (select film_id, span_no, (start_ms * 25 + 500) // 1000 as f from timeline)
select film_id, span_no, lpad(cast(f // 90000 as varchar), 2, '0') || ':' || lpad(cast(f // 1500 % 60 as varchar), 2, '0') || ':' || lpad(cast(f // 25 % 60 as varchar), 2, '0') || ':' || lpad(cast(f % 25 as varchar), 2, '0') as tc, cast(f // 25 * 1000 + f % 25 * 40 as int) as ms from f""")
def timecodes(t: DataFrame) -> DataFrame:
    return t.select("film_id", "span_no", T.timecode(F.col("start_ms").cast("bigint"), 25).alias("tc")).withColumn("ms", T.timecode_ms(F.col("tc"), 25))


@query("timeline", sql="""with r as (select film_id, span_no, 0.79 + span_no * 0.0057e0 as x from timeline), v as (select unnest([1.0e0, 24 / 23.976e0, 23.976e0 / 24, 25 / 24.0e0, 24 / 25.0e0, 25 / 23.976e0, 23.976e0 / 25, 30 / 29.97e0, 29.97e0 / 30, 30 / 25.0e0, 25 / 30.0e0]) as r),
k as (select film_id, span_no, x, r, row_number() over (partition by film_id, span_no order by abs(x - r)) as k from r, v) select film_id, span_no, round(case when abs(x - r) < 0.004 then r else x end, 6) as ratio from k where k = 1""")
def snap_ratio(t: DataFrame) -> DataFrame:
    return t.select("film_id", "span_no", F.round(T.snap_ratio(0.79 + F.col("span_no") * F.lit(0.0057)), 6).alias("ratio"))


_NAMES = "select 'd' || (o_custkey % 300) as dir, 'The.Show_' || o_custkey % 7 || '-S' || o_orderkey % 3 || 'E' || o_custkey % 4 || '.' || o_orderkey as name from orders where o_orderkey % 5 {op} 0"
_TOK = "list_distinct(list_filter(string_split(regexp_replace(translate(lower(name), '._-[]()+''', '         '), '\\s+', ' ', 'g'), ' '), lambda t: t <> ''))"
_EP = "case when regexp_matches(name, '[sS](\\d{1,2})[ ._-]?[eE](\\d{1,3})') then cast(regexp_extract(name, '[sS](\\d{1,2})[ ._-]?[eE](\\d{1,3})', 1)::int as varchar) || 'x' || cast(regexp_extract(name, '[sS](\\d{1,2})[ ._-]?[eE](\\d{1,3})', 2)::int as varchar) end"


@query("orders", sql=f"""with s as (select *, {_TOK} as t, {_EP} as e from ({_NAMES.format(op='<>')}) q), v as (select dir, name as video, {_TOK} as vt, {_EP} as ve from ({_NAMES.format(op='=')}) q),
b as (select s.dir, s.name, video, len(list_intersect(vt, t)) / greatest(len(vt), 1) as score from s join v on s.dir = v.dir and (e is null or ve is null or e = ve)),
k as (select *, row_number() over (partition by dir, name order by round(score, 6) desc, video) as k, count(*) over (partition by dir, name) as n from b)
select s.dir, s.name, k.video, round(score, 6) as score from s left join k on s.dir = k.dir and s.name = k.name and k = 1 and (score >= 0.5 or n = 1)""")
def episode_match(o: DataFrame) -> DataFrame:
    names = o.selectExpr("o_orderkey", "concat('d', o_custkey % 300) as dir", "concat('The.Show_', o_custkey % 7, '-S', o_orderkey % 3, 'E', o_custkey % 4, '.', o_orderkey) as name")
    return C.match_videos(names.where("o_orderkey % 5 <> 0"), names.where("o_orderkey % 5 = 0"))


@query("jobs", sql="select id, (id % 3 = 0 or (id % 17 = 0) or (status not in ('done', 'lowconf', 'undone') and attempts < 3)) as needs_work from jobs")
def job_needs_work(j: DataFrame) -> DataFrame:
    pairs = j.select("id", "video_path", "srt_path", F.lit(100.0).alias("mtime"))
    return C.needs_work(pairs, j.where("id % 3 <> 0").withColumn("srt_mtime", F.when(F.col("id") % 17 == 0, 90.0).otherwise(100.5))).select("id", "needs_work")


@query("jobs", sql="""with d as (select video_path, count(*) filter (where status = 'done') + case when video_path like '%7.mkv' then 1 else 0 end as ok, count(*) as wanted from jobs group by video_path)
select case when ok >= wanted then 'full' when ok > 0 then 'part' else 'none' end as state, count(*) as n from d group by 1""")
def film_rollup(j: DataFrame) -> DataFrame:
    return C.film_rollup(j, j.where("video_path like '%7.mkv'").select("video_path", F.lit(1).alias("tracks")).distinct())


@query("jobs", sql="select status, count(*) as n from jobs group by status")
def status_counts(j: DataFrame) -> DataFrame:
    return j.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("jobs", sql="select id, case when id % 4 = 0 then 'redone' else status end as status from (select *, row_number() over (partition by video_path order by id desc) as k from jobs) t where k = 1")
def latest_upsert(j: DataFrame) -> DataFrame:
    w = Window.partitionBy("video_path").orderBy(F.desc("id"))
    last = j.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return C.upsert(j, last.withColumn("status", F.when(F.col("id") % 4 == 0, "redone").otherwise(F.col("status"))), ["video_path"], "id").select("id", "status")


@query("jobs", sql="select id, status from jobs where not (id % 10 = 3)")
def delete_jobs(j: DataFrame) -> DataFrame:
    return C.delete(j, j.where("id % 10 = 3"), ["id"]).select("id", "status")


@query("jobs", sql="select id, confidence, row_number() over (order by confidence desc nulls last, id) as rank from (select * from jobs where status = 'done' and contains(srt_path, '/s1') and confidence < 10 order by id desc limit 2000) t")
def ui_page(j: DataFrame) -> DataFrame:
    p = C.page(C.visible(j, "done", "/S1", 10.0)).select("id", "confidence")
    return p.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("confidence"), "id")))  # a page of 2000 rows


@query("jobs", sql="select id from jobs where not (video_path like '/m/1/%' or video_path like '/m/22/%')")
def exclusion_prefix(j: DataFrame) -> DataFrame:
    spark = j.sparkSession
    files = j.select("id", F.concat("video_path", F.lit("/"), F.col("id").cast("string")).alias("path"))
    return C.blocked(files, spark.createDataFrame([("/m/1",), ("/m/22",)], "prefix string")).select("id")


@query("jobs", sql="select j.id, count(distinct o.video_path) as neighbours from jobs j join jobs o on regexp_extract(j.video_path, '^(.*)/', 1) = regexp_extract(o.video_path, '^(.*)/', 1) and o.video_path <> j.video_path group by j.id")
def sibling_folder(j: DataFrame) -> DataFrame:
    each = j.select("id", "video_path", F.regexp_extract("video_path", "^(.*)/", 1).alias("dir"))
    n = each.select("dir", "video_path").distinct().groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    return each.join(n, "dir").where("n > 1").select("id", (F.col("n") - 1).alias("neighbours"))


@query("measured", sql="""with m as (select film_id, max(sigma) as sigma, count(*) filter (where offset_ms < 1000) as agreeing, avg(cast(offset_ms < 1000 as int)) as agreement from measured group by film_id), v as (select *, case when sigma < 6 then 'nothing' when sigma >= 8 and agreeing >= 3 then 'solid' else 'unsure' end as verdict from m)
select film_id, verdict, round(agreement, 6) as agreement, case when film_id % 7 = 0 or verdict = 'solid' then 'write' when film_id % 3 = 0 then 'keep' else 'beside' end as action,
 to_json({'verdict': verdict, 'sigma': cast(round(sigma, 1) as varchar), 'agreeing': agreeing}) as report from v""")
def verdict(m: DataFrame) -> DataFrame:
    near = F.col("offset_ms") < 1000
    g = m.groupBy("film_id").agg(F.max("sigma").alias("sigma"), F.count_if(near).alias("agreeing"), F.round(F.avg(near.cast("int")), 6).alias("agreement"))
    g = g.withColumn("verdict", C.verdict(F.col("sigma"), F.col("agreeing")))
    report = F.to_json(F.struct("verdict", F.round("sigma", 1).cast("string").alias("sigma"), "agreeing"))
    return g.select("film_id", "verdict", "agreement", C.settle(F.col("verdict"), F.col("film_id") % 7 == 0, F.col("film_id") % 3 == 0).alias("action"), report.alias("report"))


@query("measured", sql="""with f as (select film_id, cast(film_id % 9 = 0 as int) as restarts, count(*) filter (where offset_ms < 800) as flat, count(*) filter (where sigma > 4) as on_line, (max(offset_ms) - min(offset_ms)) / 1e7 as drift, film_id % 4 as groups, film_id % 5 = 0 as far from measured group by film_id),
d as (select *, on_line >= 4 and abs(drift) > 1e-5 as dr from f)
select film_id, case when restarts > 0 then 'joined' when flat >= 3 and not (dr and on_line >= flat + 2) and not far then 'shifted' when dr and (flat < 3 or on_line >= flat + 2) then 'drifting' when groups >= 2 or far then 'recut' else 'ratio' end as mode from d""")
def auto_mode(m: DataFrame) -> DataFrame:
    f = m.groupBy("film_id").agg(F.count_if(F.col("offset_ms") < 800).alias("flat"), F.count_if(F.col("sigma") > 4).alias("on_line"), ((F.max("offset_ms") - F.min("offset_ms")) / 1e7).alias("drift"))
    return C.classify(f.withColumn("restarts", (F.col("film_id") % 9 == 0).cast("int")).withColumn("groups", F.col("film_id") % 4).withColumn("far", F.col("film_id") % 5 == 0)).select("film_id", "mode")


@query("measured", sql="select film_id, bool_and(abs(offset_ms) < 2500) as unchanged, bool_or(abs(offset_ms - 1500) >= 1500 - 150) as on_the_edge from measured group by film_id")
def unchanged_and_edge(m: DataFrame) -> DataFrame:
    return m.groupBy("film_id").agg(F.bool_and(F.abs("offset_ms") < 2500).alias("unchanged"), F.bool_or(F.abs(F.col("offset_ms") - 1500) >= 1500 - 150).alias("on_the_edge"))
