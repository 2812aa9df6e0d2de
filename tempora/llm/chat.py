"""Operator 1 (native): perspective rotation of conversations.

For every participant the dialogue is rendered with that speaker as assistant and everyone else as a named
user; target_spans says which code points are to be learned: what the speaker says and its end mark. Context
roles (system) keep their own header in every rotation and are never a speaker.

A dialogue comes in parts of BLOCK turn numbers (an ordinary one is a single part 0); in order they add up to
the whole. So no task ever holds a whole hot conversation, and the plan is two exchanges on (conv_id, part)
and conv_id with partial aggregation before both.

Null roles are 'unknown', null texts empty, and turns without a number form part -1, before all others. Rows of
one turn go by role, then text; repeated rows are rendered as often as they occur. Null conv_ids make one
conversation. A conversation of context roles alone gives no rows, nor does an empty table; extra columns are
ignored. Spans count from the part's beginning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, CONTEXT = 64, ("system",)


def rotate(conversations: DataFrame, block: int = BLOCK, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn").cast("long") / block), F.lit(-1)).cast("long").alias("part"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parts = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = turns.where(~F.col("role").isin(*context)).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()

    def head(t):
        return F.when(t["role"] == F.col("speaker"), F.lit("assistant")).when(t["role"].isin(*context), t["role"]).otherwise(F.concat(F.lit("user name="), t["role"]))

    segment = lambda t: F.concat(F.lit("<|im_start|>"), head(t), F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))
    rendered = parts.join(speakers, parts.conv_id.eqNullSafe(speakers.of)).select(
        "conv_id", "speaker", "part", F.transform("turns", lambda t: F.struct(segment(t).alias("s"), (t["role"] == F.col("speaker")).alias("own"))).alias("segs")
    )
    ends = F.aggregate("segs", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x["s"]))))
    placed = rendered.withColumn("at", ends)
    start = len("<|im_start|>assistant\n")
    spans = F.filter(F.transform("segs", lambda x, i: F.when(x["own"], F.struct((F.get("at", i) + start).alias("b"), (F.get("at", i + 1) - 1).alias("e")))), lambda x: x.isNotNull())
    return placed.withColumn("spans", spans).select(
        "conv_id", "speaker", "part",
        F.size("segs").cast("long").alias("n_turns"),
        F.size("spans").cast("long").alias("n_own_turns"),
        F.array_join(F.transform("segs", lambda x: x["s"]), "").alias("text"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["b"], x["e"])), ",").alias("target_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["b"]).alias("target_chars"),
    )


ORACLE = """
with t as (select conv_id, coalesce(cast(floor(turn / 64.0) as bigint), -1) as part, coalesce(turn, -9223372036854775808) as turn,
                  coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
sp as (select distinct conv_id as cid, role as speaker from t where role <> 'system'),
s as (select conv_id, speaker, part, turn, role, role = speaker as own, text as raw,
             '<|im_start|>' || case when role = speaker then 'assistant' when role = 'system' then role else 'user name=' || role end
             || chr(10) || text || '<|im_end|>' || chr(10) as seg
      from t join sp on t.conv_id is not distinct from sp.cid),
p as (select *, row_number() over w as k, sum(length(seg)) over (w rows unbounded preceding) as stop
      from s window w as (partition by conv_id, speaker, part order by turn, role, raw))
select conv_id, speaker, part, count(*) as n_turns, count(*) filter (where own) as n_own_turns,
       string_agg(seg, '' order by k) as text,
       coalesce(string_agg(cast(stop - length(seg) + 22 as bigint) || ':' || cast(stop - 1 as bigint), ',' order by k) filter (where own), '') as target_spans,
       cast(coalesce(sum(length(seg) - 23) filter (where own), 0) as bigint) as target_chars
from p group by conv_id, speaker, part
"""
