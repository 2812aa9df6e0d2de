"""Interval tables derived from the driver's tables, as Spark DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (tables it needs, SQL that both engines read; {us} is microseconds since the epoch).
SQL = {
    "timeline": ("events", """select user_id as film_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as span_no,
        cast(floor(({us} - 1704067200000000) / 360000.0) as int) as start_ms,
        cast(floor(({us} - 1704067200000000) / 360000.0) as int) + 500 + cast(floor(value * 20) as int) as end_ms,
        event_type, cast((event_id % 7 + 4) / 10.0 as double) as weight from events"""),
    "cues": ("timeline", "select film_id, span_no as cue_no, start_ms + 33000 as start_ms, end_ms + 33000 as end_ms from timeline where span_no % 5 <> 0"),
    "near_cues": ("timeline", "select film_id, span_no as cue_no, start_ms + 700 as start_ms, end_ms + 650 as end_ms from timeline where span_no % 5 <> 0"),
    "points": ("timeline", "select film_id, start_ms as at_ms from timeline where event_type = 'purchase'"),
    "marks": ("timeline", "select film_id, span_no as seq, start_ms as at_ms, event_type <> 'error' as shown from timeline"),
    "keyframes": ("orders", "select distinct o_custkey % 50 as film_id, cast(o_orderkey as bigint) * 400 + (cast(o_orderkey as bigint) * o_custkey) % 371 as at_ms from orders"),
    "frames": ("timeline", "select film_id, span_no as frame_no, case when end_ms % 3 = 0 then 0.1 else weight end as p from timeline"),
    "measured": ("timeline", """select film_id, slice_no, cast(floor(avg((start_ms + end_ms) / 2.0)) as int) as at_ms, cast(sum(end_ms - start_ms) % 3000 as int) as offset_ms, cast(sum(end_ms) % 120 as int) / 10.0e0 as sigma
        from (select *, cast(least(floor((span_no - 1) / 8.0), 7) as int) as slice_no from timeline) t group by film_id, slice_no"""),
    "jobs": ("orders", """select o_orderkey as id, concat('/m/', cast(o_custkey % 97 as varchar({n})), '/v', cast(o_custkey as varchar({n})), '.mkv') as video_path, concat('/m/', cast(o_custkey % 97 as varchar({n})), '/s', cast(o_orderkey as varchar({n})), '.srt') as srt_path,
        case o_orderstatus when 'F' then 'done' when 'O' then 'lowconf' else 'failed' end as status, case when o_orderkey % 11 = 0 then null else o_totalprice / 10000 end as confidence, cast(o_orderkey % 5 as int) as attempts from orders"""),
    "lines": ("documents", """select doc_id as film_id, cast(pos as int) as cue_no, case cast((doc_id * 7 + pos * 3) % 13 as int) when 0 then concat('[', line, ']') when 1 then concat('(', line) when 2 then '{note} {note}' when 3 then 'NARRATOR:'
        when 4 then '- <i></i>' when 5 then concat('Synced by ', line) when 6 then concat('www.', line, '.org') when 7 then concat('- <b>', line, '</b>') when 8 then concat('ANNA: ', line) else line end as text from ({exploded}) l"""),
    "stamps": ("timeline", """select film_id, span_no, concat(lpad(cast(start_ms // 3600000 as varchar(20)), 2, '0'), ':', lpad(cast(start_ms // 60000 % 60 as varchar(20)), 2, '0'), ':', lpad(cast(start_ms // 1000 % 60 as varchar(20)), 2, '0'), case when span_no % 2 = 0 then ',' else '.' end, case span_no % 3 when 0 then lpad(cast(start_ms % 1000 as varchar(20)), 3, '0') when 1 then cast(start_ms % 10 as varchar(20)) else lpad(cast(start_ms % 100 as varchar(20)), 2, '0') end) as stamp, start_ms, end_ms from timeline"""),
    "tracks": ("orders", """select o_custkey % 500 as film_id, o_orderkey as idx, case cast(o_orderkey % 3 as int) when 0 then 'audio' when 1 then 'subtitle' else 'video' end as kind, o_orderkey % 7 = 0 as is_default, o_orderkey % 5 = 0 as forced, o_orderkey % 11 = 0 as impaired,
        cast(o_orderkey % 90 as int) as n_cues from orders"""),
    "tokens": ("events", """select user_id as film_id, event_id as tok_no, concat(chr(123), '"text": "', case cast(event_id % 5 as int) when 0 then '[_BEG_]' when 1 then '<|en|>' when 2 then ' ...' else concat(' ', event_type) end, '", "t_dtw": ', cast(event_id % 9000 - 5 as varchar(20)), chr(125)) as token from events"""),
    "packets": ("timeline", "select film_id, span_no, cast(span_no * (33 + film_id % 10) + case when span_no % 9 = 0 then 7 else 0 end as int) as pts_ms from timeline"),
    "srt_lines": ("documents", """select doc_id as film_id, cast(pos as int) as line_no, case cast((doc_id * 5 + pos * 7) % 11 as int) when 0 then '' when 1 then '12' when 2 then '00:00:01,000 --> 00:00:02,500' when 3 then 'WEBVTT' when 4 then 'NOTE a remark' when 5 then 'cue id' when 6 then '' else line end as line from ({exploded}) l"""),
    "files": ("orders", """select concat('/m/', case cast(o_custkey % 9 as int) when 0 then '@eaDir/' when 1 then '.hidden/' else concat('d', cast(o_custkey % 60 as varchar(20)), '/') end) as dir, concat(case when o_orderkey % 23 = 0 then '.' else '' end, 'f', cast(o_orderkey % 4000 as varchar(20)), case when o_orderkey % 19 = 0 then '.unsure' else '' end) as base,
        case cast(o_orderkey % 6 as int) when 0 then '.mkv' when 1 then '.SRT' when 2 then '.idx' when 3 then '.sub' when 4 then '.nfo' else '.vtt' end as ext from orders"""),
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
_FILL = {
    "spark": {"us": "unix_micros(cast(ts as timestamp))", "n": 20, "note": "♪", "exploded": "select doc_id, pos, line from documents lateral view posexplode(split(text, '\\n')) t as pos, line"},
    "duck": {"us": "epoch_us(ts)", "n": 20, "note": "♪", "exploded": "select doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as pos, unnest(string_split(text, chr(10))) as line from documents"},
}


def _text(name: str, engine: str) -> str:
    text = SQL[name][1]
    for k, v in _FILL[engine].items():
        text = text.replace("{" + k + "}", str(v))
    return text.replace(" // ", " div ") if engine == "spark" else text


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source = SQL[name][0]
    return spark.sql(_text(name, "spark").replace(f"from {source}", "from {src}"), src=load(spark, sf_dir, source))


def with_duck(names: tuple[str, ...], query: str) -> str:
    """query with the fixtures it needs in front."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name not in BASE and name not in needed:
            need(SQL[name][0])
            needed.append(name)

    for n in names:
        need(n)
    ctes, query = ",\n".join(f"{n} as ({_text(n, 'duck')})" for n in needed), query.strip()
    if not ctes:
        return query
    for start in ("with recursive ", "with "):
        if query.startswith(start):
            return f"{start}{ctes},\n{query[len(start) :]}"
    return f"with {ctes}\n{query}"
