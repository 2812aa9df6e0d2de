"""Rows that joins make, so that work doesn't grow with the square of a group."""

import numpy as np
from pyspark.sql import functions as F

from tempora.functions import times
from tempora.operators import catalog, intervals
from tempora.plans import format_queries
from tempora.plans.all_queries import QUERIES
from tempora.sources import binary, rewriters


def most_joined(df):
    """The most rows that a join of a plan has put out."""
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        todo += [p.children().apply(i) for i in range(p.children().size())]
        if "Join" in p.nodeName():
            most = max(most, p.metrics().apply("numOutputRows").value())
    return most


def test_names_of_one_episode_are_not_paired_off(spark):
    subtitles = spark.range(1200).selectExpr("'d' as dir", "concat('The.Show-S1E2.s', id) as name")
    videos = spark.range(300).selectExpr("'d' as dir", "concat('The.Show-S1E', id % 3, '.v', id) as name")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = catalog.match_videos(subtitles.union(subtitles.where("name like '%.s7'")), videos)
        rows = df.collect()
        assert most_joined(df) <= 30_000  # 120,000 pairs
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(rows) == 1201 and {(r["video"], r["score"]) for r in rows} == {("The.Show-S1E2.v101", 0.75)}


def test_corners_of_a_sweep_are_not_sorted_by_the_engine(spark):
    for name in ("offset_sweep", "part_offsets", "score_curve"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        after = plan[: plan.index("FlatMapGroupsInPandas")]  # what is above the timelines' own work
        assert "Window" not in after and "Generate" not in after and "Aggregate" not in after, name


def test_slope_events_by_brute_force_and_in_blocks():
    rng = np.random.default_rng(2)
    rs, cs = rng.integers(0, 5000, 40), rng.integers(0, 5000, 30)
    re, ce, w = rs + rng.integers(1, 900, 40), cs + rng.integers(1, 900, 30), rng.random(40)
    want = {}
    for a, b, v in zip(rs, re, w, strict=True):
        for c, d in zip(cs, ce, strict=True):
            if a - d <= 1500 and b - c >= -1500:
                for x, sign in ((a - d, 1), (a - c, -1), (b - d, -1), (b - c, 1)):
                    want[x] = want.get(x, 0) + sign * v / max(b - a, d - c)
    for pairs in (1, 50, 1 << 20):
        x, ds = intervals.slope_events((rs, re, w), (cs, ce), 1500, pairs)
        assert x.tolist() == sorted(want) and np.allclose(ds, [want[k] for k in x])


def test_equal_intervals_are_paired_once_and_many_corners_are_placed():
    n = 200_000  # 40,000,000,000 pairs
    full = lambda v: np.full(n, v)
    x, ds = intervals.slope_events((full(1000), full(3000), full(0.5)), (full(1500), full(2500)), 1500)
    assert x.tolist() == [-1500, -500, 500, 1500] and np.allclose(ds, np.array([1, -1, -1, 1]) * n * n * 0.5 / 2000)
    rng = np.random.default_rng(3)
    rs, cs = np.sort(rng.integers(0, 2500, 300)), rng.integers(0, 2500, 250)
    ref, cues = (rs, rs + rng.integers(1, 60, 300), rng.random(300)), (cs, cs + rng.integers(1, 60, 250))
    for pairs in (100, 1 << 20):
        sorted_in, placed = (intervals.slope_events(ref, cues, 1500, pairs, dense) for dense in (0, 1 << 23))
        assert sorted_in[0].tolist() == placed[0].tolist() and np.allclose(sorted_in[1], placed[1])
    for ref_, cues_ in ((tuple(v[:0] for v in ref), cues), (ref, tuple(v[:0] for v in cues))):
        assert [len(v) for v in intervals.slope_events(ref_, cues_)] == [0, 0]


def test_times_are_worked_out_once(spark):
    x = spark.createDataFrame([("1:02:03.45",)], "x string")
    shift = rewriters.Shift(0.001, 0.25)
    a, b = shift.both(times.parse_timestamp(F.col("x")), times.parse_timestamp(F.col("x")))
    df = x.withColumn("offset_ms", F.lit(7)).select(times.clock(a, ".").alias("a"), times.clock(b, ".", 2).alias("b"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 20  # over a hundred for either, if each use works its argument out anew
    assert df.collect() == [("01:02:07.430", "01:02:07.43")]


def test_binary_files_are_not_made_one_group_at_a_time(spark):
    for name in ("format_stl", "format_sup", "move_stl", "move_sup"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "regexp" not in plan, name  # nor are texts read that such files don't hold
    rows = [("a", n, ms, ms + 1500, "x") for n, ms in ((300, 86_398_000 // 3), (0, 0), (255, 59_990), (256, 3_599_980))]
    cues = spark.createDataFrame([*rows, ("b", 7, 123_456, 130_000, "y")], "path string, cue_no int, start_ms int, end_ms int, text string")
    for kind, unit in (("stl", 40), ("sup", 1)):
        files = format_queries._binary(cues, kind)
        got = {(r["path"], r["cue_no"]): (r["start_ms"], r["end_ms"]) for r in binary.read(files, kind).collect()}
        want = {("a", k): r[2:4] for k, r in enumerate(sorted(rows))} | {("b", 0): (123_456, 130_000)}
        assert got == {k: tuple((x + unit // 2) // unit * unit for x in v) for k, v in want.items()}
        a = {r["path"]: bytes(r["content"]) for r in files.collect()}["a"]
        if kind == "stl":
            assert len(a) == 1024 + 4 * 128 and a[3:11] == b"STL25.01" and a[1024:1040].hex() == "000000ff000a0000000a00010d000000" and a[1024 + 3 * 128 + 1 : 1024 + 3 * 128 + 3] == b"\x2c\x01"
        else:
            assert len(a) == 4 * 2 * 24 and a[:24] == b"PG" + bytes(8) + b"\x16\x00\x0b" + bytes(10) + b"\x01" and a[26:30] == (1500 * 90).to_bytes(4, "big")


def test_cue_texts_are_cut_by_a_named_class_and_captions_have_no_arrays_of_codes(spark):
    from tempora.functions import text
    from tempora.sources import writers

    for name in ("move_spruce", "move_sbv", "convert_formats", "format_scc", "charsets", "embedded_text"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "[^A-Za-z .]" not in plan and text.NO_LETTERS in plan, name  # ten times as long in Java
    every = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x10FFF))))
    assert spark.createDataFrame([(every,)], "x string").select(F.regexp_replace("x", text.NO_LETTERS, "")).first()[0] == "".join(c for c in every if c.isascii() and (c.isalpha() or c in " ."))
    lines = spark.createDataFrame([("p", "00:00:01:00\t9420 6162 942F\n00:00:02;00 1c2f\n00:00:03:00 0000942c\n00:00:04:00 942fg 42f\n00:00:05:00 94a7 c1c2\n00:00:06:00 1425 9420 e1e2\r\nnote 942f")], "path string, text string")
    got = [(r["show"], r["hide"], r["load"]) for r in rewriters.scc_lines(lines).orderBy("piece_no").collect()]
    assert got == [(True, False, False), (True, False, False), (False, True, False), (False, False, False), (True, False, False), (False, False, True), (False, False, False)]
    assert "filter(" not in rewriters.scc_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    cues = spark.createDataFrame([("p", i, 4000 * i, 4000 * i + 1500, x) for i, x in enumerate(("", "abc", "é!"))], "path string, cue_no int, start_ms int, end_ms int, text string")
    assert [x.split("\t")[1] for x in writers.to_scc(cues).first()["text"].split("\n") if "942f" in x] == ["9420 9420  942f 942f", "9420 9420 6162 6320 942f 942f", "9420 9420 3f21 942f 942f"]
