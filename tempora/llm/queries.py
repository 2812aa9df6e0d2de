"""The queries of this subpackage, op1 to op10 and the pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tempora.llm import chat, cover_tree, fertility, merge_replay, packing, secrets, simhash, simhash_sql, toxicity, warc, wrapper
from tempora.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replay.encode_documents(table(spark, sf_dir, "documents"), RANKS)


def op4_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), RANKS)


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"), RANKS, PIECES)


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_chat_rotation, op2_toxicity, op3_byte_bpe, op4_wrapper_text, op5_secret_scan, op6_simhash, op7_warc, op8_best_fit, op9_fertility, op10_cover_tree)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


OP7_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as s from pages),
bits as (select page_id, octet_length(b) as n, s, list_reduce(list_transform(range(40), lambda i: right('000' || bin(('0x' || substr(s, i + 1, 1))::int), 4)), lambda x, y: x || y) as bits from p),
d as (select page_id, n, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      list_reduce(list_transform(range(5), lambda j: substr(bits, i * 5 + j + 1, 1)::int), lambda x, y: 2 * x + y) + 1, 1)), lambda x, y: x || y) as payload_digest from bits),
f as (select *, max(page_id) over (partition by payload_digest) as first from d)
select page_id, cast(n as bigint) as payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to from f
"""


OP10_SQL = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and len(embedding) > 0 and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false) and list_contains(list_transform(embedding, lambda x: x <> 0), true)),
link as (select a.vec_id as i, b.vec_id as j from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id as i, vec_id as c from embeddings union select link.j, reach.c from reach join link on link.i = reach.i where reach.c < link.j),
n as (select i, count(*) as n from link group by i)
select vec_id, coalesce(n.n, 0) as n_links, c.c as component_id, vec_id = c.c as kept from embeddings left join n on n.i = vec_id join (select i, min(c) as c from reach group by i) c on c.i = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_rotation": chat.ORACLE, "op4_wrapper_text": wrapper.ORACLE, "op5_secret_scan": secrets.ORACLE, "op6_simhash": simhash_sql.oracle(simhash.SHINGLE, simhash.RADIUS, simhash.SEED), "op7_warc": OP7_SQL, "op10_cover_tree": OP10_SQL}
