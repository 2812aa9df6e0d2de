"""Interval queries on the derived fixtures, each beside the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators import intervals as I
from tempora.plans.registry import query

MEDIAN = "list_sort(list({x}))[count(*) // 2 + 1]"


@query("timeline", sql="select film_id, span_no, cast(trunc(start_ms * (25 / 24.0e0)) as int) as start_ms, cast(trunc(end_ms * (25 / 24.0e0)) as int) as end_ms from timeline")
def span_stretch(t: DataFrame) -> DataFrame:
    return I.stretch(t, 25 / 24).select("film_id", "span_no", "start_ms", "end_ms")


@query("timeline", sql="""with a as (select film_id, span_no, cast(round(start_ms * 1.001e0 - 150000) as int) + case when span_no % 3 = 0 then null else span_no end as s0, cast(round(start_ms * 1.001e0 - 150000) as int) as s1,
  cast(round(end_ms * 1.001e0 - 150000) as int) as e1, coalesce(case when span_no % 3 = 0 then null else span_no end, 0) as o from timeline)
select film_id, span_no, s1 + o + greatest(-(s1 + o), 0) as start_ms, e1 + o + greatest(-(s1 + o), 0) as end_ms from a""")
def span_apply_shift(t: DataFrame) -> DataFrame:
    df = t.withColumn("offset_ms", F.when(F.col("span_no") % 3 != 0, F.col("span_no")))
    return I.apply_shift(df, 0.001, -150.0).select("film_id", "span_no", "start_ms", "end_ms")


@query("timeline", sql="""select film_id, span_no, least(a, b) as start_ms, least(greatest(a, b), least(a, b) + 700) as end_ms from (select film_id, span_no, case when span_no % 2 = 0 then end_ms else start_ms end as a,
  case when span_no % 7 = 0 then case when span_no % 2 = 0 then end_ms else start_ms end when span_no % 2 = 0 then start_ms else end_ms end as b from timeline) t where a <> b""")
def span_normalise(t: DataFrame) -> DataFrame:
    even = F.col("span_no") % 2 == 0
    t = t.select("film_id", "span_no", F.when(even, F.col("end_ms")).otherwise(F.col("start_ms")).alias("a"), F.when(even, F.col("start_ms")).otherwise(F.col("end_ms")).alias("b"))
    t = t.select("film_id", "span_no", F.col("a").alias("start_ms"), F.when(F.col("span_no") % 7 == 0, F.col("a")).otherwise(F.col("b")).alias("end_ms"))
    return I.clamp(I.normalise(t), 700)


@query("timeline", sql="select film_id, span_no, greatest(coalesce(lag(end_ms) over (partition by film_id order by span_no), 0), start_ms - 150) as start_ms, end_ms from timeline where end_ms - start_ms >= 600")
def span_lead_in(t: DataFrame) -> DataFrame:
    return I.lead_in(t.where("end_ms - start_ms >= 600"), "film_id", "span_no").select("film_id", "span_no", "start_ms", "end_ms")


@query("timeline", sql="""with f as (select *, case when start_ms >= max(end_ms) over (w rows between unbounded preceding and 1 preceding) is not false then 1 else 0 end as n from timeline window w as (partition by film_id order by start_ms, end_ms, span_no)),
g as (select *, sum(n) over (partition by film_id order by start_ms, end_ms, span_no rows unbounded preceding) as k from f)
select film_id, cast(k as int) as span_no, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_cues from g group by film_id, k""")
def span_merge(t: DataFrame) -> DataFrame:
    return I.merge(t, "film_id", "span_no")


@query("timeline", sql="""with recursive o as (select film_id, span_no as k, case when span_no % 6 = 0 then start_ms - 900 else start_ms end as s, end_ms as e from timeline),
r as (select film_id, k, s as s0, e as e0, 1 as span_no from o where k = 1
  union all select o.film_id, o.k, case when o.s < r.e0 and o.s >= r.s0 then r.s0 else o.s end, case when o.s < r.e0 and o.s >= r.s0 then greatest(r.e0, o.e) else o.e end, case when o.s < r.e0 and o.s >= r.s0 then r.span_no else r.span_no + 1 end
  from r join o on o.film_id = r.film_id and o.k = r.k + 1)
select film_id, span_no, min(s0) as start_ms, max(e0) as end_ms, cast(count(*) as int) as n_cues from r group by film_id, span_no""")
def span_merge_file_order(t: DataFrame) -> DataFrame:
    return I.merge_in_file_order(t.withColumn("start_ms", F.when(F.col("span_no") % 6 == 0, F.col("start_ms") - 900).otherwise(F.col("start_ms"))), "film_id", "span_no")


@query("timeline", "near_cues", sql="""select film_id, round(sum(weight * (least(t.end_ms, c.end_ms) - greatest(t.start_ms, c.start_ms)) / greatest(t.end_ms - t.start_ms, c.end_ms - c.start_ms)), 6) as score, count(*) as pairs
from timeline t join near_cues c using (film_id) where t.start_ms < c.end_ms and c.start_ms < t.end_ms group by film_id""")
def overlap_score(t: DataFrame, c: DataFrame) -> DataFrame:
    return I.overlap_score(t, c, "film_id").withColumn("score", F.round("score", 6))


@query("near_cues", "points", sql="""select c.film_id, cue_no, coalesce(least(c.start_ms - b.at_ms, a.at_ms - c.start_ms), 1000000000) as distance, b.at_ms as before, a.at_ms as after,
  case when a.at_ms is null or c.start_ms - b.at_ms <= a.at_ms - c.start_ms then coalesce(b.at_ms, a.at_ms) else a.at_ms end as nearest
from near_cues c asof left join points b on c.film_id = b.film_id and c.start_ms >= b.at_ms asof left join points a on c.film_id = a.film_id and c.start_ms <= a.at_ms""")
def nearest_cut(c: DataFrame, p: DataFrame) -> DataFrame:
    n = I.nearest_point(c.select("film_id", "cue_no", F.col("start_ms").alias("at_ms")), p, "film_id")
    return n.select("film_id", "cue_no", F.coalesce(F.least(F.col("at_ms") - F.col("before"), F.col("after") - F.col("at_ms")), F.lit(1_000_000_000)).alias("distance"), "before", "after", "nearest")


@query("near_cues", "points", sql="""with d as (select c.film_id, least(coalesce(c.start_ms - b.at_ms, 1000000000), coalesce(a.at_ms - c.start_ms, 1000000000)) as d
from near_cues c asof left join points b on c.film_id = b.film_id and c.start_ms >= b.at_ms asof left join points a on c.film_id = a.film_id and c.start_ms <= a.at_ms)
select film_id, round(avg(exp(-0.5 * (d / 450.0) * (d / 450.0))), 8) as bunching from d group by film_id""")
def bunching(c: DataFrame, p: DataFrame) -> DataFrame:
    n = I.nearest_point(c.select("film_id", F.col("start_ms").alias("at_ms"), "cue_no"), p, "film_id")
    far = F.lit(1_000_000_000)
    d = F.least(F.coalesce(F.col("at_ms") - F.col("before"), far), F.coalesce(F.col("after") - F.col("at_ms"), far)) / 450.0
    return n.groupBy("film_id").agg(F.round(F.avg(F.exp(-0.5 * d * d)), 8).alias("bunching"))


@query("near_cues", "points", sql="select film_id, cue_no, start_ms, end_ms from near_cues c where exists (select 1 from points p where p.film_id = c.film_id and p.at_ms between c.start_ms - 300 and c.end_ms + 300)")
def spoken_semi(c: DataFrame, p: DataFrame) -> DataFrame:
    return I.near_semi(c, p, "film_id")


@query("near_cues", "timeline", sql="""with n as (select c.film_id, c.cue_no, c.start_ms, a.span_no as nx, a.start_ms as ns from near_cues c asof left join timeline a on c.film_id = a.film_id and c.start_ms < a.start_ms),
m as (select n.*, (select max(span_no) from timeline t where t.film_id = n.film_id) as top from n), k as (select m.*, coalesce(nx, top) as hi from m)
select k.film_id, k.cue_no, case when nx is null then top when p.span_no is not null and abs(k.start_ms - p.end_ms) < ns - k.start_ms then p.span_no else nx end as span_no
from k left join timeline p on p.film_id = k.film_id and p.span_no = k.nx - 1""")
def nearest_span(c: DataFrame, t: DataFrame) -> DataFrame:
    """The interval that starts next after each cue's start, unless the end of the one before is strictly closer; beyond the last: the last."""
    both = c.select("film_id", "cue_no", F.col("start_ms").alias("at_ms"), F.lit(1).alias("probe")).unionByName(t.select("film_id", F.col("start_ms").alias("at_ms"), F.lit(0).alias("probe"), "span_no"), allowMissingColumns=True)
    w = Window.partitionBy("film_id").orderBy(F.desc("at_ms"), F.desc("probe"), F.desc("span_no"))
    nxt = both.withColumn("nx", F.last("span_no", ignorenulls=True).over(w)).withColumn("ns", F.last(F.when(F.col("probe") == 0, F.col("at_ms")), ignorenulls=True).over(w)).where("probe = 1")
    prev = t.select("film_id", (F.col("span_no") + 1).alias("nx"), F.col("end_ms").alias("pe"))
    top = t.groupBy("film_id").agg(F.max("span_no").alias("top"))
    closer = F.abs(F.col("at_ms") - F.col("pe")) < F.col("ns") - F.col("at_ms")
    return nxt.drop("span_no").join(prev, ["film_id", "nx"], "left").join(top, "film_id").select("film_id", "cue_no", F.when(F.col("nx").isNull(), F.col("top")).when(closer, F.col("nx") - 1).otherwise(F.col("nx")).alias("span_no"))


SWEEP = """pairs as (select r.film_id, r.start_ms rs, r.end_ms re, c.start_ms cs, c.end_ms ce, weight / greatest(r.end_ms - r.start_ms, c.end_ms - c.start_ms) s
  from {ref} r join {cues} c using (film_id) where r.start_ms - c.end_ms <= 900000 and r.end_ms - c.start_ms >= -900000),
ev as (select film_id, x, sum(ds) as ds from (select film_id, rs - ce x, s ds from pairs union all select film_id, rs - cs, -s from pairs union all select film_id, re - ce, -s from pairs union all select film_id, re - cs, s from pairs) group by film_id, x),
li as (select film_id, x, sum(ds) over (partition by film_id order by x) as slope, lead(x) over (partition by film_id order by x) as nx from ev),
cu as (select film_id, x, coalesce(sum(slope * (nx - x)) over (partition by film_id order by x rows between unbounded preceding and 1 preceding), 0) as f from li),
be as (select *, row_number() over (partition by film_id order by round(f, 6) desc, x) as k from cu where abs(x) <= 900000)
"""


@query("timeline", "cues", sql="with " + SWEEP.format(ref="timeline", cues="cues") + "select film_id, x as offset_ms, round(f, 4) as score from be where k = 1")
def offset_sweep(t: DataFrame, c: DataFrame) -> DataFrame:
    return I.sweep(t, c, "film_id")


@query("timeline", "near_cues", sql="""with v as (select unnest([0.96e0, 1.0e0, 25 / 24.0e0]) as ratio),
c3 as (select film_id, ratio, cast(trunc(start_ms * ratio) as int) as start_ms, cast(trunc(end_ms * ratio) as int) as end_ms from near_cues, v),
sc as (select film_id, ratio, sum(weight * (least(t.end_ms, c.end_ms) - greatest(t.start_ms, c.start_ms)) / greatest(t.end_ms - t.start_ms, c.end_ms - c.start_ms)) as s from timeline t join c3 c using (film_id) where t.start_ms < c.end_ms and c.start_ms < t.end_ms group by film_id, ratio),
k as (select *, row_number() over (partition by film_id order by round(s, 6) desc, ratio) as k from sc) select film_id, round(ratio, 6) as ratio, round(s, 4) as score from k where k = 1""")
def framerate_search(t: DataFrame, c: DataFrame) -> DataFrame:
    """The ratio, of a few, under which the cues overlap the reference best."""
    ratios = F.explode(F.array(*map(F.lit, (0.96, 1.0, 25 / 24)))).alias("ratio")
    each = I.overlap_scores(t, c.select("film_id", ratios, "start_ms", "end_ms").withColumns({x: I.trunc_int(F.col(x) * F.col("ratio")) for x in ("start_ms", "end_ms")}), "film_id", "ratio").withColumnRenamed("score", "s")
    w = Window.partitionBy("film_id").orderBy(F.desc(F.round("s", 6)), "ratio")
    return each.withColumn("k", F.row_number().over(w)).where("k = 1").select("film_id", F.round("ratio", 6).alias("ratio"), F.round("s", 4).alias("score"))


@query("timeline", sql=f"""with n as (select *, count(*) over (partition by film_id) as n from timeline), p as (select *, least(8, n // 5) as k from n),
s as (select *, least((row_number() over (partition by film_id order by span_no) - 1) // (n // k), k - 1) as slice_no from p where k >= 2)
select film_id, cast(slice_no as int) as slice_no, count(*) as n, cast(floor(avg((start_ms + end_ms) / 2.0)) as int) as at_ms, {MEDIAN.format(x="end_ms - start_ms")} as mid_len from s group by film_id, slice_no""")
def chunk_summary(t: DataFrame) -> DataFrame:
    return I.slices(t, "film_id", "span_no").groupBy("film_id", "slice_no").agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg((F.col("start_ms") + F.col("end_ms")) / 2)).cast("int").alias("at_ms"), I.upper_median(F.col("end_ms") - F.col("start_ms")).alias("mid_len"))


@query("measured", sql="select film_id, slice_no, offset_ms, backers from (select *, count(*) over (partition by film_id order by offset_ms range between 1000 preceding and 1000 following) as backers from measured) t where backers >= 2 or sigma >= 7")
def chunk_support(m: DataFrame) -> DataFrame:
    return I.supported(m, "film_id", "offset_ms", "sigma").select("film_id", "slice_no", "offset_ms", "backers")


@query("measured", sql=f"""with s as (select a.film_id, {MEDIAN.format(x="(b.offset_ms - a.offset_ms) / cast(b.at_ms - a.at_ms as double)")} as slope from measured a join measured b on a.film_id = b.film_id and b.at_ms - a.at_ms >= 1000 group by a.film_id)
select film_id, round(slope, 9) as slope, round({MEDIAN.format(x="offset_ms - slope * at_ms")}, 4) as intercept from measured join s using (film_id) group by film_id, slope""")
def theil_sen(m: DataFrame) -> DataFrame:
    return I.theil_sen(m, "film_id", "at_ms", "offset_ms").select("film_id", F.round("slope", 9).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("measured", sql=f"""with m as (select film_id, {MEDIAN.format(x="sigma")} as mid, max(sigma) as top, count(*) as n from measured group by film_id),
d as (select film_id, mid, top, n, 1.4826 * {MEDIAN.format(x="abs(sigma - mid)")} as mad, avg(abs(sigma - mid)) as md from measured join m using (film_id) group by film_id, mid, top, n),
s as (select *, case when mad > 1e-9 then mad else md end as sp from d)
select film_id, round(case when n < 8 then 0 else least(greatest(case when sp > 1e-9 then (top - mid) / sp when top > mid then 99.0 else 0.0 end, 0), 99) end, 6) as sigma from s""")
def mad_sigma(m: DataFrame) -> DataFrame:
    return I.mad_sigma(m, "film_id", "sigma").withColumn("sigma", F.round("sigma", 6))


@query("measured", sql="""with r as (select *, case when offset_ms - lag(offset_ms) over w > 400 or lag(offset_ms) over w is null then 1 else 0 end as n from measured window w as (partition by film_id order by offset_ms)),
g as (select film_id, sum(n) over (partition by film_id order by offset_ms, slice_no rows unbounded preceding) as k from r), c as (select film_id, k, count(*) as n from g group by film_id, k) select film_id, count(*) filter (where n >= 2) as groups from c group by film_id""")
def cluster_groups(m: DataFrame) -> DataFrame:
    return I.clusters(m, "film_id", "offset_ms")


@query("measured", sql="""select film_id, coalesce(bool_or(d <= 400), false) as second_part from (select film_id, offset_ms - lag(offset_ms) over (partition by film_id order by offset_ms) as d from measured where sigma >= 6 and abs(offset_ms - 1000) > 400) t group by film_id""")
def second_part(m: DataFrame) -> DataFrame:
    far = m.where((F.col("sigma") >= 6) & (F.abs(F.col("offset_ms") - 1000) > 400))
    d = far.withColumn("d", F.col("offset_ms") - F.lag("offset_ms").over(Window.partitionBy("film_id").orderBy("offset_ms")))
    return d.groupBy("film_id").agg(F.coalesce(F.bool_or(F.col("d") <= 400), F.lit(False)).alias("second_part"))


@query("measured", sql="""select film_id, slice_no from measured m where sigma >= 4 and not exists (select 1 from measured o where o.film_id = m.film_id and o.slice_no <> m.slice_no and abs(o.offset_ms - m.offset_ms) <= 200)
 and (sigma >= 5 or exists (select 1 from measured o where o.film_id = m.film_id and o.slice_no <> m.slice_no and abs(o.offset_ms - m.offset_ms) <= 1500))""")
def contradicted(m: DataFrame) -> DataFrame:
    """Sure slices whose offset no other slice shares within 200, if one lies within 1500 or they are very sure."""
    near = lambda d: F.count(F.lit(1)).over(Window.partitionBy("film_id").orderBy("offset_ms").rangeBetween(-d, d)) - 1
    t = m.withColumn("close", near(200)).withColumn("around", near(1500))
    return t.where((F.col("sigma") >= 4) & (F.col("close") == 0) & ((F.col("sigma") >= 5) | (F.col("around") > 0))).select("film_id", "slice_no")


@query("timeline", sql="""with o as (select film_id, span_no, cast(span_no // 9 % 3 as int) * 40 as v from timeline), c as (select *, case when v is distinct from lag(v) over w or lag(1) over w is null then 1 else 0 end as n from o window w as (partition by film_id order by span_no)),
g as (select *, sum(n) over (partition by film_id order by span_no rows unbounded preceding) as k from c) select film_id, cast(k as int) as run_no, min(span_no) as first, count(*) as n, any_value(v) as v from g group by film_id, k""")
def offset_rle(t: DataFrame) -> DataFrame:
    return I.run_lengths(t.select("film_id", "span_no", (F.floor(F.col("span_no") / 9) % 3 * 40).cast("int").alias("v")), "film_id", "span_no", "v")


@query("timeline", sql="""with o as (select film_id, span_no, cast(span_no // 20 % 2 as int) * 300 as v from timeline), c as (select *, case when v is distinct from lag(v) over w or lag(1) over w is null then 1 else 0 end as n from o window w as (partition by film_id order by span_no)),
g as (select *, sum(n) over (partition by film_id order by span_no rows unbounded preceding) as k from c), r as (select film_id, k, count(*) as n, any_value(v) as v from g group by film_id, k)
select film_id, count(*) >= 2 and bool_and(n >= 12 and abs(v) <= 900000) and max(v) - min(v) >= 120 as worth from r group by film_id""")
def worth_splitting(t: DataFrame) -> DataFrame:
    r = I.run_lengths(t.select("film_id", "span_no", (F.floor(F.col("span_no") / 20) % 2 * 300).cast("int").alias("v")), "film_id", "span_no", "v")
    return r.groupBy("film_id").agg(((F.count(F.lit(1)) >= 2) & F.bool_and((F.col("n") >= 12) & (F.abs("v") <= 900_000)) & (F.max("v") - F.min("v") >= 120)).alias("worth"))


@query("timeline", sql="select film_id, span_no, coalesce(last_value(case when event_type = 'view' then span_no end ignore nulls) over (partition by film_id order by span_no), 0) as mapped from timeline")
def locf_mapping(t: DataFrame) -> DataFrame:
    return I.carry_forward(t.select("film_id", "span_no", F.when(F.col("event_type") == "view", F.col("span_no")).alias("mapped")), "film_id", "span_no", "mapped", 0)


@query("frames", sql="""with r as (select *, frame_no - row_number() over (partition by film_id order by frame_no) as run from frames where p >= 0.25)
select film_id, min(frame_no) * 10 as start_ms, (max(frame_no) + 1) * 10 as end_ms, round(avg(p), 8) as weight from r group by film_id, run""")
def threshold_runs(f: DataFrame) -> DataFrame:
    return I.threshold_runs(f, "film_id").withColumn("weight", F.round("weight", 8))


@query("timeline", sql="""with f as (select *, case when start_ms - max(end_ms) over (w rows between unbounded preceding and 1 preceding) >= 60000 is not false then 1 else 0 end as n from timeline window w as (partition by film_id order by start_ms, end_ms)),
g as (select *, sum(n) over (partition by film_id order by start_ms, end_ms rows unbounded preceding) as k from f) select film_id, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n from g group by film_id, k""")
def gap_glue(t: DataFrame) -> DataFrame:
    return I.glue(t, "film_id", 60_000)


@query("frames", sql="select film_id, frame_no, round(p - avg(p) over (partition by film_id order by frame_no rows between 10 preceding and 9 following), 8) + 0.0 as p from frames")
def moving_mean_removed(f: DataFrame) -> DataFrame:
    return I.moving_mean_removed(f, "film_id", "frame_no", "p", 20).select("film_id", "frame_no", (F.round("p", 8) + 0.0).alias("p"))


@query("frames", sql="""with k as (select d, exp(-0.5 * (d / 2.0) * (d / 2.0)) as k from (select unnest(range(-6, 7)) as d)), n as (select d, k / (select sum(k) from k) as k from k)
select film_id, cast(frame_no + d as int) as frame_no, round(sum(p * k), 8) as p from frames, n group by film_id, frame_no + d""")
def gauss_smooth(f: DataFrame) -> DataFrame:
    return I.gaussian(f, "film_id", "frame_no", "p", 2.0).withColumn("p", F.round("p", 8))


@query("frames", sql="""with s as (select *, count(*) over (partition by film_id) as n, avg(p) over w as m, stddev_pop(p) over w as sd from frames window w as (partition by film_id order by frame_no rows between 5 preceding and 5 following))
select film_id, frame_no, round(case when m >= 1e-6 and sd / m < 0.6 then p * (sd / m) / 0.6 else p end, 6) as p from s""")
def rolling_cv(f: DataFrame) -> DataFrame:
    w = Window.partitionBy("film_id").orderBy("frame_no").rowsBetween(-5, 5)
    cv = F.when(F.avg("p").over(w) >= 1e-6, F.stddev_pop("p").over(w) / F.avg("p").over(w))
    return f.withColumn("cv", cv).select("film_id", "frame_no", F.round(F.when(F.col("cv") < 0.6, F.col("p") * F.col("cv") / 0.6).otherwise(F.col("p")), 6).alias("p"))


@query("frames", sql="""with t as (select *, sum(p) over (partition by film_id order by frame_no rows between unbounded preceding and 1 preceding) as a, sum(1.1 - p) over (partition by film_id order by frame_no rows between current row and unbounded following) as b from frames),
k as (select *, row_number() over (partition by film_id order by round(a + b, 6) desc, frame_no) as k from t where a is not null) select film_id, frame_no as cut, round(a + b, 6) as total from k where k = 1""")
def best_cut(f: DataFrame) -> DataFrame:
    return I.best_cut(f.withColumn("q", F.lit(1.1) - F.col("p")), "film_id", "frame_no", "p", "q")


@query("keyframes", sql=f"""with g as (select film_id, at_ms, at_ms - lag(at_ms) over (partition by film_id order by at_ms) as gap from keyframes),
m as (select film_id, list_sort(list(gap) filter (where gap is not null))[count(gap) // 2 + 1] as mid, count(*) as n, max(gap) as top from g group by film_id),
s as (select film_id, mid, n, top, count(*) filter (where abs(gap - mid) <= 100) as regular, count(*) filter (where top - gap <= 80) as longest from g join m using (film_id) group by film_id, mid, n, top)
select film_id, at_ms from g join s using (film_id) where n >= 8 and mid >= 400 and regular * 2 <= n - 1 and (gap is null or longest < 3 or top - gap > 80)""")
def shot_changes(k: DataFrame) -> DataFrame:
    return I.shot_changes(k, "film_id")


@query("near_cues", "points", sql="""with near as (select c.*, case when a.at_ms is null or c.start_ms - b.at_ms <= a.at_ms - c.start_ms then coalesce(b.at_ms, a.at_ms) else a.at_ms end as x
 from near_cues c asof left join points b on c.film_id = b.film_id and c.start_ms >= b.at_ms asof left join points a on c.film_id = a.film_id and c.start_ms <= a.at_ms),
s as (select film_id, cue_no, start_ms + mv as start_ms, end_ms + mv as e from (select *, case when abs(x - start_ms) <= 120 then x - start_ms else 0 end as mv from near) q),
n as (select *, lead(start_ms) over (partition by film_id order by start_ms, cue_no) as nx from s),
t as (select n.*, case when a.at_ms is null or n.e - b.at_ms <= a.at_ms - n.e then coalesce(b.at_ms, a.at_ms) else a.at_ms end as x
 from n asof left join points b on n.film_id = b.film_id and n.e >= b.at_ms asof left join points a on n.film_id = a.film_id and n.e <= a.at_ms)
select film_id, cue_no, start_ms, case when abs(x - e) <= 120 and x - start_ms >= 500 and (nx is null or x <= nx) then x else e end as end_ms from t""")
def snap_cues(c: DataFrame, p: DataFrame) -> DataFrame:
    return I.snap(c, p, "film_id", "cue_no")


@query("marks", sql="""select film_id, seq, at_ms as start_ms, least(case when nx > at_ms then nx else at_ms + 2000 end, at_ms + 10000) as end_ms from (select *, lead(at_ms) over (partition by film_id order by seq) as nx from marks) t where shown""")
def show_hide_spans(m: DataFrame) -> DataFrame:
    return I.shown_spans(m, "film_id", "seq")


@query("timeline", sql="""with b as (select film_id, 1.0 / (end_ms - start_ms) as h, start_ms, unnest(range(start_ms // 400, end_ms // 400 + 1)) as bin from timeline)
select film_id, bin, round(sum(h), 9) as block, count(*) filter (where start_ms // 400 = bin) as onset from b group by film_id, bin""")
def raster_bins(t: DataFrame) -> DataFrame:
    return I.raster(t, "film_id", 400).withColumn("block", F.round("block", 9))


@query("timeline", sql="""with c as (select film_id, span_no as cue_no, case when span_no > 40 then start_ms - 3000000 else start_ms end as start_ms from timeline), t as (select *, lag(start_ms) over w as prev, row_number() over w as k, greatest(30, count(*) over (partition by film_id) // 10) as part from c window w as (partition by film_id order by cue_no))
select t.film_id, t.cue_no, t.start_ms, t.prev from t join t l on l.film_id = t.film_id and l.k = t.k + t.part - 1 where t.start_ms < t.prev - 60000 and l.start_ms < t.prev""")
def backward_jumps(t: DataFrame) -> DataFrame:
    c = t.select("film_id", F.col("span_no").alias("cue_no"), F.when(F.col("span_no") > 40, F.col("start_ms") - 3_000_000).otherwise(F.col("start_ms")).alias("start_ms"))
    return I.backward_jumps(c, "film_id", "cue_no")


@query("timeline", sql="select film_id, round(sqrt(sum(weight * weight)) + 1e-12, 8) as energy, count(*) as n, round(avg(greatest(weight, 1 - weight)), 8) as certainty from timeline group by film_id having count(*) >= 10")
def energy_and_certainty(t: DataFrame) -> DataFrame:
    """L2 norm and mean certainty of timelines with enough cues."""
    g = t.groupBy("film_id").agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))) + 1e-12, 8).alias("energy"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.greatest(F.col("weight"), 1 - F.col("weight"))), 8).alias("certainty"))
    return g.where("n >= 10")


@query("timeline", sql="""with f as (select film_id, span_no // 10 as frame, sqrt(avg(weight * weight)) as rms from timeline group by film_id, span_no // 10) select film_id, round(list_sort(list(rms))[count(*) * 9 // 10 + 1], 8) as loud from f group by film_id""")
def loud_level(t: DataFrame) -> DataFrame:
    f = t.groupBy("film_id", F.floor(F.col("span_no") / 10).alias("frame")).agg(F.sqrt(F.avg(F.col("weight") * F.col("weight"))).alias("rms"))
    return f.groupBy("film_id").agg(F.round(F.element_at(F.array_sort(F.collect_list("rms")), F.floor(F.count(F.lit(1)) * 9 / 10).cast("int") + 1), 8).alias("loud"))


@query("timeline", sql="""with l as (select film_id, 25.0 * (max(end_ms) - min(start_ms)) / 7200000 as f from timeline group by film_id), r as (select film_id, f, fps, row_number() over (partition by film_id order by abs(fps - f), fps) as k from l, (select unnest([23.976e0, 24.0e0, 25.0e0, 29.97e0, 30.0e0]) as fps) v)
select film_id, case when abs(fps - f) <= 0.08 * fps then fps end as fps from r where k = 1""")
def fps_from_length(t: DataFrame) -> DataFrame:
    l = t.groupBy("film_id").agg((25.0 * (F.max("end_ms") - F.min("start_ms")) / 7_200_000).alias("f"))
    rates = F.array(*[F.struct(F.abs(F.lit(r) - F.col("f")).alias("d"), F.lit(r).alias("fps")) for r in (23.976, 24.0, 25.0, 29.97, 30.0)])
    return l.withColumn("best", F.array_min(rates)).select("film_id", F.when(F.col("best.d") <= 0.08 * F.col("best.fps"), F.col("best.fps")).alias("fps"))


@query("timeline", "near_cues", sql="""with d as (select unnest([0, -1400, -700, 700, 1400]) as x), s as (select film_id, x, sum(greatest(0, least(t.end_ms, c.end_ms + x) - greatest(t.start_ms, c.start_ms + x))) as s from timeline t join near_cues c using (film_id), d where t.start_ms < c.end_ms + x and c.start_ms + x < t.end_ms group by film_id, x)
select film_id, round(sum(s) / 5.0, 4) as mean, round(sqrt(greatest(0, sum(s * s) / 5.0 - (sum(s) / 5.0) * (sum(s) / 5.0))), 2) as sd from s group by film_id""")
def null_baseline(t: DataFrame, c: DataFrame) -> DataFrame:
    """Mean and population deviation of the overlap at a fixed table of offsets."""
    offsets = F.explode(F.array(*map(F.lit, (0, -1400, -700, 700, 1400)))).alias("x")
    a = t.select("film_id", F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    b = c.select("film_id", offsets, "start_ms", "end_ms").select("film_id", "x", (F.col("start_ms") + F.col("x")).alias("b_start"), (F.col("end_ms") + F.col("x")).alias("b_end"))
    each = I.overlap_join(a, b, "film_id").groupBy("film_id", "x").agg(F.sum(F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("s"))
    mean = F.sum("s") / 5.0
    return each.groupBy("film_id").agg(F.round(mean, 4).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("s").cast("double") * F.col("s")) / 5.0 - mean * mean)), 2).alias("sd"))
