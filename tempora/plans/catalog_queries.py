"""Queries on the library, jobs and reports, each beside the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import text as X
from tempora.operators import catalog as C
from tempora.plans.registry import query
from tempora.sources import writers

_SCAN = """with v as (select *, lower(ext) as low from files where not starts_with(base, '.') and not contains(dir, '@eaDir') and not contains(dir, '/.')),
k as (select v.*, case when low in ('.mkv') then 'video' when low in ('.srt', '.vtt', '.idx', '.sub') and not ends_with(base, '.unsure') then 'subtitle' end as kind from v)
select {cols} from k where kind is not null and not (low = '.sub' and exists (select 1 from v i where i.dir = k.dir and i.base = k.base and i.low = '.idx'))"""


@query("files", sql=_SCAN.format(cols="dir, base || ext as name, kind"))
def library_scan(f: DataFrame) -> DataFrame:
    return C.library(f).select("dir", F.concat("base", "ext").alias("name"), "kind")


@query("files", sql=f"""with l as ({_SCAN.format(cols='distinct dir, kind')}), s as (select distinct dir from l where kind = 'subtitle'), v as (select distinct dir from l where kind = 'video')
select s.dir || 'Subs/' as dir, case when exists (select 1 from v where v.dir = s.dir || 'Subs/') then s.dir || 'Subs/' when exists (select 1 from v where v.dir = s.dir) then s.dir end as video_dir from s""")
def parent_folder(f: DataFrame) -> DataFrame:
    """Where the videos for subtitles in a folder lie: in it, else in its parent."""
    l = C.library(f).select("dir", "kind").distinct()
    return C.video_folder(l.where("kind = 'subtitle'").select(F.concat("dir", F.lit("Subs/")).alias("dir")), l.where("kind = 'video'").select("dir"))


@query("jobs", sql="select id, case when id % 3 = 0 and id % 7 <> 0 then 'done' when id % 3 = 0 then case when confidence < 9 then 'lowconf' else 'done' end when status = 'done' and coalesce(confidence >= 5, true) then 'done' else 'lowconf' end as result from jobs")
def job_results(j: DataFrame) -> DataFrame:
    """What becomes of jobs: unchanged or solid ones are done, those below the wanted confidence go back."""
    r = j.select("id", (F.col("id") % 3 == 0).alias("unchanged"), (F.col("status") != "failed").alias("written"), F.when(F.col("status") == "done", "solid").otherwise("unsure").alias("verdict"), F.col("confidence").alias("sigma"), F.when(F.col("id") % 3 != 0, 5.0).when(F.col("id") % 7 == 0, 9.0).otherwise(0.0).alias("least"))
    return r.select("id", C.result(F.col("unchanged"), F.col("written"), F.col("verdict"), F.col("sigma"), F.col("least")).alias("result"))


@query("jobs", sql="""select id, row_number() over (order by confidence asc nulls last, id) as up, row_number() over (order by confidence desc nulls last, id) as down from (select id, confidence from jobs order by id desc limit 2000) t""")
def ui_sort(j: DataFrame) -> DataFrame:
    """A page sorted either way, rows without a value last both times."""
    p = C.page(j).select("id", "confidence")  # a page of 2000 rows
    return p.select("id", F.row_number().over(Window.orderBy(F.asc_nulls_last("confidence"), "id")).alias("up"), F.row_number().over(Window.orderBy(F.desc_nulls_last("confidence"), "id")).alias("down"))


@query("jobs", sql="select j.video_path, count(*) as wanted, coalesce(max(t.tracks), 0) as tracks from jobs j left join (select video_path, count(*) as tracks from jobs where id % 13 = 0 group by video_path) t using (video_path) group by j.video_path")
def film_tracks(j: DataFrame) -> DataFrame:
    t = j.where("id % 13 = 0").groupBy("video_path").agg(F.count(F.lit(1)).alias("tracks"))
    return j.groupBy("video_path").agg(F.count(F.lit(1)).alias("wanted")).join(t, "video_path", "left").select("video_path", "wanted", F.coalesce("tracks", F.lit(0)).alias("tracks"))


@query("jobs", sql="select id, list_filter([replace(t, '\"', '') for t in regexp_extract_all(video_path || ' \"a b ' || srt_path || '\" --x=\"y z\" \"\" ' || status, '((?:[^ \\t\\r\"]|\"[^\"]*(?:\"|$))+)')], lambda t: t <> '') as tokens from jobs")
def job_lines(j: DataFrame) -> DataFrame:
    line = F.concat("video_path", F.lit(' "a b '), "srt_path", F.lit('" --x="y z" "" '), "status")
    return j.select("id", X.job_tokens(line).alias("tokens"))


@query("jobs", sql="select id, regexp_replace(regexp_replace(srt_path, '\\.srt$', ''), '\\.[^./]{2,3}$', '') || '.da.srt' as named, regexp_replace(srt_path, '(\\.[A-Za-z0-9]+)$', '.unsure\\1') as beside, '{\\an8}{i}' || status as kept from jobs")
def output_names(j: DataFrame) -> DataFrame:
    kept = X.keep_markup(F.concat(F.lit("{\\an8}{i}x "), F.col("status")), F.col("status"))
    return j.select("id", X.language_name(F.col("srt_path"), "da").alias("named"), writers.beside(F.col("srt_path")).alias("beside"), kept.alias("kept"))


@query("jobs", sql="select video_path, status, id as version from (select *, row_number() over (partition by video_path order by id desc) as k from jobs where status <> 'failed') t where k = 1")
def last_report(j: DataFrame) -> DataFrame:
    """The last JSON line of each film's output that parses."""
    out = F.when(F.col("status") == "failed", F.lit("error: no json")).otherwise(F.to_json(F.struct("status", F.col("id").alias("version"))))
    parsed = j.select("video_path", "id", F.from_json(out, "status string, version bigint").alias("r")).where("r.status is not null")
    return parsed.groupBy("video_path").agg(F.max_by("r", "id").alias("r")).select("video_path", "r.status", "r.version")


@query("jobs", sql="select id, case when id % 6 = 1 then 'queued' else status end as status, case when id % 6 = 1 then 0 else attempts end as attempts from jobs")
def resync_jobs(j: DataFrame) -> DataFrame:
    """Jobs picked by id are queued again, their attempts forgotten."""
    return C.update(j, j.where("id % 6 = 1").select("id"), ["id"], {"status": F.lit("queued"), "attempts": F.lit(0)}).select("id", "status", "attempts")


@query("timeline", sql="select film_id, sha256(film_id || '|' || n || '|' || last || '|audio') as fingerprint, n as spans, last as coverage_ms from (select film_id, count(*) as n, max(end_ms) as last from timeline group by film_id having count(*) >= 60) t")
def span_cache(t: DataFrame) -> DataFrame:
    """Fingerprints under which reference spans are kept: only whole enough ones."""
    g = t.groupBy("film_id").agg(F.count(F.lit(1)).alias("spans"), F.max("end_ms").alias("coverage_ms")).where("spans >= 60")
    return g.select("film_id", F.sha2(F.concat_ws("|", F.col("film_id"), F.col("spans"), F.col("coverage_ms"), F.lit("audio")), 256).alias("fingerprint"), "spans", "coverage_ms")


@query("events", sql="""with g as (select event_type, ts, case when ts - lag(ts) over (partition by event_type order by ts) < interval 10 minute then 0 else 1 end as n from events), r as (select event_type, ts, sum(n) over (partition by event_type order by ts rows unbounded preceding) as k from g)
select event_type as dir, count(*) as n, epoch_us(min(ts)) as first_us from r group by event_type, k""")
def debounced(e: DataFrame) -> DataFrame:
    """Bursts of events of a folder, parted by ten quiet minutes."""
    g = e.select(F.col("event_type").alias("dir"), F.col("ts").cast("timestamp").alias("ts")).groupBy("dir", F.session_window("ts", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    return g.select("dir", "n", F.unix_micros("first").alias("first_us"))
