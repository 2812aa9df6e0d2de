"""Binary formats from bytes built here, charsets, and the watcher on a folder of files."""

import struct

import numpy as np

from tempora.functions import times
from tempora.sources import binary, subtitles
from tempora.streaming import watch


def test_ebu_stl():
    head = bytearray(b" " * 1024)
    head[3:11], head[256:264] = b"STL25.01", b"10000000"
    record = lambda n, a, b, comment=0: struct.pack("<BHBB4B4BBBB", 0, n, 0xFF, 0, *a, *b, 0, 0, comment).ljust(128, b"\x8f")
    data = bytes(head) + record(0, (10, 0, 1, 12), (10, 0, 3, 0)) + record(0, (10, 0, 1, 12), (10, 0, 3, 0)) + record(1, (10, 0, 4, 0), (10, 0, 5, 0), 1) + record(2, (10, 1, 0, 0), (10, 1, 2, 0))
    assert binary.ebu_stl(data) == [(1480, 3000), (60_000, 62_000)]
    assert binary.ebu_stl(b"short") == []


def test_pgs_scc_and_idx():
    segment = lambda ms, objects: b"PG" + struct.pack(">IIBH", ms * 90, 0, 0x16, 11) + bytes(10) + bytes([objects])
    assert binary.pgs(segment(1500, 1) + segment(3000, 0) + segment(5000, 2)) == [(1500, 3000), (5000, 7000)]
    assert binary.scc(b"Scenarist_SCC V1.0\n\n00:00:01:15\t942f 942f\n\n00:00:03:00\t942c 942c\n") == [(1495, 3000)]
    assert binary.idx(b"timestamp: 00:00:01:500, filepos: 0\ndelay: 00:00:01:000\ntimestamp: 00:00:03:000, filepos: 8\n") == [(1500, 4000), (4000, 6000)]


def test_sup_files_as_a_source(spark, tmp_path):
    (tmp_path / "a.idx").write_bytes(b"timestamp: 00:00:01:500, filepos: 0\n")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [(r["cue_no"], r["start_ms"], r["end_ms"]) for r in binary.read(files, "idx").collect()] == [(0, 1500, 3500)]


def test_wav_frames(spark):
    loud = np.r_[np.zeros(1600), 8000 * np.sin(np.arange(3200)), np.zeros(1600)]
    df = spark.createDataFrame([("w", bytearray(binary.wav(loud)))], "path string, content binary")
    got = [r["p"] for r in binary.speech_frames(df).orderBy("frame_no").collect()]
    assert len(got) == 40 and max(got[:10]) == 0 and min(got[11:29]) > 0.9 and max(got[30:]) == 0


def test_charsets(spark, tmp_path):
    text = "1\n00:00:01,500 --> 00:00:03,000\nHélló\n"
    kinds = {"utf8": text.encode(), "bom": b"\xef\xbb\xbf" + text.encode(), "le": text.encode("utf-16-le"), "lebom": b"\xff\xfe" + text.encode("utf-16-le"), "be": text.encode("utf-16-be"), "bebom": b"\xfe\xff" + text.encode("utf-16-be"), "latin": text.encode("latin-1")}
    for name, data in kinds.items():
        (tmp_path / f"{name}.srt").write_bytes(data)
    got = subtitles.read_cues(subtitles.files(spark, str(tmp_path))).collect()
    assert {r["path"].rsplit("/", 1)[1] for r in got} == {f"{k}.srt" for k in kinds}
    assert {(r["start_ms"], r["end_ms"], r["text"]) for r in got} == {(1500, 3000, "Hélló")}


def test_odd_lines(spark):
    df = spark.createDataFrame([("x", "1\nbad --> worse\nkept\n\n2\n00:01.5 --> 00:02,75 align:start\ntwo\nlines\n")], "path string, text string")
    assert [(r["cue_no"], r["start_ms"], r["end_ms"], r["text"]) for r in subtitles.read_srt(df).orderBy("cue_no").collect()] == [(0, 0, 0, "kept"), (1, 1500, 2750, "two\nlines")]
    df = spark.createDataFrame([("x", "Format: Layer, End, Start, Text\nDialogue: 0,0:00:03.00,0:00:01.50,Hel,lo\\Nyou\n")], "path string, text string")
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in subtitles.read_ass(df).collect()] == [(1500, 3000, "Hel,lo\nyou")]


def test_times(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("1:02:03,4",), ("02:03.45",), ("00:00:01,5009",), ("25:00:00",), ("x",), ("1:2:3:4",)], "t string")
    assert [r[0] for r in df.select(times.parse_timestamp(F.col("t"))).collect()] == [3_723_400, 123_450, 1500, -1, -1, -1]


def test_watcher(spark, tmp_path):
    folder, jobs = tmp_path / "m", watch.JobTable(spark, str(tmp_path / "jobs"))
    folder.mkdir()
    (folder / "a.srt").write_text("x")
    (folder / "b.nfo").write_text("x")
    events = watch.file_events(spark, str(folder))
    watch.rescan(events, jobs, str(tmp_path / "check"))
    assert [(r["srt_path"].rsplit("/", 1)[1], r["status"]) for r in jobs.read().collect()] == [("a.srt", "queued")]
    (folder / "c.vtt").write_text("x")
    watch.rescan(events, jobs, str(tmp_path / "check"))
    assert {r["srt_path"].rsplit("/", 1)[1] for r in jobs.read().collect()} == {"a.srt", "c.vtt"}
    before = jobs.epochs()
    jobs.upsert(jobs.read(), before[-1])  # a batch that is run again changes nothing
    assert jobs.epochs() == before
    fresh = spark.read.format("binaryFile").load(str(folder)).select("path", "modificationTime", "length").withColumnsRenamed({"modificationTime": "modified", "length": "size"})
    assert watch.settled(fresh).count() == 0 and watch.settled(fresh, -1).count() == 3


def test_shares_of_nul_bytes_decide_as_pairs(spark):
    import random

    from pyspark.sql import functions as F

    def want(x):
        head = x[:4096]
        n = max(1.0, len(head) / 2)
        one, two = (sum(head[i + k] == 0 for i in range(0, len(head) - 1, 2)) / n for k in (0, 1))
        if x[:3] == b"\xef\xbb\xbf":
            return x[3:].decode()
        wide = "utf-16-le" if two > 0.3 and one < 0.05 else "utf-16-be" if one > 0.3 and two < 0.05 else None
        if wide:
            return None if len(x) % 2 else x.decode(wide)
        try:
            return x.decode()
        except UnicodeDecodeError:
            return x.decode("latin-1")

    r = random.Random(3)
    data = [bytes(r.choice((0, 0, 65, 10, 200)) if r.random() < share else 65 for _ in range(r.randrange(40))) for share in (0.1, 0.5, 0.9) for _ in range(60)]
    data += [bytes(r.choice((65, 66, 0xE9)) if i % 2 == side else 0 if r.random() < 0.8 else 7 for i in range(2 * r.randrange(30))) for side in (0, 1) for _ in range(60)]
    data += [t.encode(e) for t in ("é" * 5000, "a\n", "\n\0") for e in ("utf-16-le", "utf-16-be", "latin-1", "utf-8")] + [b"", b"\0", b"\xef\xbb\xbfa"]
    data = [x for x in data if want(x) is not None]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "i int, b binary").select("i", subtitles.decode(F.col("b")).alias("t"))
    assert "extract_all" not in df._jdf.queryExecution().optimizedPlan().toString().lower()  # nor an array of each pair of bytes
    assert dict(df.collect()) == {i: want(x) for i, x in enumerate(data)}
