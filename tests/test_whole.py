"""Queries on whole tables and whole lines: no document and no part of a line is left out."""

from pyspark.sql import functions as F

from tempora.plans import fixtures
from tempora.plans.all_queries import ORACLE, QUERIES
from tempora.plans.format_queries import UNIT

SF = "/root/testdata/sf0.001"


def test_formats_take_every_document(spark):
    paths = {f"f{r[0]}" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    for name in [*(f"format_{k}" for k in UNIT), "format_sniffing", "rewrite_srt", "embedded_text"]:
        assert "%" not in ORACLE[name].rsplit("from lines", 1)[1], name
        assert {r["path"] for r in QUERIES[name](spark, SF).select("path").collect()} == paths, name


def test_lines_are_whole(spark):
    assert QUERIES["format_srt"](spark, SF).agg(F.max(F.length("text"))).first()[0] > 200


def test_text_queries_take_lines_and_all_keys(spark, tmp_path):
    longest = spark.read.parquet(f"{SF}/documents.parquet").select(F.max(F.array_max(F.transform(F.split("text", "\n"), F.length)))).first()[0]
    assert fixtures.load(spark, SF, "lines").agg(F.max(F.length("text"))).first()[0] >= longest > 60
    assert QUERIES["translatable_lines"](spark, SF).agg(F.max(F.length("line"))).first()[0] > 40
    assert QUERIES["junk_cues"](spark, SF).count() == QUERIES["drop_junk_cues"](spark, SF).count() == fixtures.load(spark, SF, "lines").count()
    far = [(5_000_000 + i * i, 3) for i in range(30)] + [(9_000_000_000, 3)]
    spark.createDataFrame(far, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = [r["at_ms"] for r in fixtures.load(spark, str(tmp_path), "keyframes").collect()]
    assert sorted(got) == [k * 400 + k * c % 371 for k, c in far]
