"""Files whose times move: everything else must stay as it was, and a move by nothing changes nothing."""

import struct

import pytest
from pyspark.sql import functions as F

from tempora.sources import binary, rewriters, store, subtitles
from tempora.streaming import watch

FILES = {
    "srt": "1\r\n00:00:01,500 --> 00:00:03,000 X1:5\r\nHello\r\n\r\n2\r\nbad --> worse\r\nkept",
    "vtt": "WEBVTT\n\n00:00:01.500 --> 00:00:03.000 align:start\nHe<00:00:02.000>llo <b>you</b>\n\n00:00:05.000 --> 00:00:06.000\nEnd",
    "sbv": "00:00:01.500,00:00:03.000\nHello\n",
    "subviewer": "[INFORMATION]\n00:00:01.50,00:00:03.00\nHello\n",
    "ass": "[Events]\nFormat: Layer, End, Start, Text\nDialogue: 0, 0:00:03.00,0:00:01.50,Hel,lo\\Nyou\nComment: 0,0:00:09.00,0:00:08.00,no\n",
    "sub": "{1}{1}25.000\n{38}{75}Hello|you\n",
    "mpl2": "[15][30]/Hello|you",
    "spruce": "$FontName = Arial\n00:00:01:12 , 00:00:03:00 , Hello\n",
    "smi": "<SAMI><BODY>\n<SYNC Start=1500><P Class=E>Hello\n<sync start=\"3000\"><P>&nbsp;\n</BODY>",
    "ttml": '<tt ttp:frameRate="25"><p begin="00:00:01.500" end="00:00:03.000">Hello</p><tt:p begin="00:00:04:10" end="00:00:05:00">b</tt:p><p begin="x">c</p></tt>',
    "idx": "# index\ndelay: 00:00:01:000\ntimestamp: 00:00:01:500, filepos: 000000000\ntimestamp: 00:00:03:000, filepos: 000000800\n",
    "scc": "Scenarist_SCC V1.0\n\n00:00:01:15\t9420 c8e5 ecec\n\n00:00:02:00\t942f 942f\n\n00:00:03;00\t942c 942c\n",
}


def moved(spark, kind, shift):
    return rewriters.rewrite(spark.createDataFrame([("x", FILES[kind])], "path string, text string"), kind, shift).collect()[0]["text"]


def test_a_move_by_nothing_changes_nothing(spark):
    for kind in FILES:
        assert moved(spark, kind, rewriters.Shift()) == FILES[kind], kind


def test_what_moves_and_what_stays(spark):
    offsets = spark.createDataFrame([("x", 0, 1000), ("x", 1, 2000)], "path string, cue_no int, offset_ms int")
    got = {k: moved(spark, k, rewriters.Shift(offsets=offsets)) for k in FILES}
    assert got["srt"] == FILES["srt"].replace("00:00:01,500 --> 00:00:03,000", "00:00:02,500 --> 00:00:04,000")
    assert got["vtt"] == "WEBVTT\n\n00:00:02.500 --> 00:00:04.000 align:start\nHe<00:00:03.000>llo <b>you</b>\n\n00:00:07.000 --> 00:00:08.000\nEnd"
    assert got["ass"] == FILES["ass"].replace(" 0:00:03.00,0:00:01.50", " 0:00:04.00,0:00:02.50")
    assert got["sub"] == "{1}{1}25.000\n{63}{100}Hello|you\n"
    assert got["mpl2"] == "[25][40]/Hello|you"
    assert got["spruce"] == FILES["spruce"].replace("00:00:01:12 , 00:00:03:00", "00:00:02:12 , 00:00:04:00")
    assert got["smi"] == FILES["smi"].replace("1500", "2500").replace("3000", "4000")
    assert got["ttml"] == FILES["ttml"].replace("00:00:01.500", "00:00:02.500").replace("00:00:03.000", "00:00:04.000").replace("00:00:04:10", "00:00:06:10").replace("00:00:05:00", "00:00:07:00")
    assert got["idx"] == FILES["idx"].replace("00:00:01:500", "00:00:02:500").replace("00:00:03:000", "00:00:05:000")
    assert got["scc"] == FILES["scc"].replace("00:00:01:15", "00:00:02:15").replace("00:00:02:00", "00:00:03:00").replace("00:00:03;00", "00:00:04;00")
    assert moved(spark, "srt", rewriters.Shift(0.0, -2.0)).startswith("1\r\n00:00:00,000 --> 00:00:01,500 X1:5\r\n")  # slides to zero


def test_captions_read_as_a_plan_and_by_themselves(spark):
    texts = [FILES["scc"], "00:00:01:00\t9425 9425 c8e5\n00:00:02:00\t94ad ecec\n00:00:04:00\t1c2c\n", "Scenarist_SCC V1.0\n\n00:00:01:15\t942f 942f\n\n00:00:03:00\t942c 942c\n", "nothing"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {}
    for r in subtitles.read_scc(df).orderBy("path", "cue_no").collect():
        got.setdefault(int(r["path"]), []).append((r["start_ms"], r["end_ms"]))
    assert got == {i: binary.scc(t.encode()) for i, t in enumerate(texts) if binary.scc(t.encode())}
    assert got[1] == [(1000, 2000), (2000, 4000)]


def test_pictures_say_when_they_go():
    def picture(stop):
        control = struct.pack(">HH", 0, 12) + b"\x01\x03\x12\x34\x04\xff\xff\xff"
        control += struct.pack(">HH", stop * 90 // 1024, 16) + b"\x02\xff"
        return struct.pack(">HH", 4 + len(control), 4) + control

    def packet(body):
        return b"\0\0\1\xba" + bytes(10) + b"\0\0\1\xbd" + struct.pack(">H", 4 + len(body)) + b"\x80\0\0\x20" + body

    def shifted(stop):  # places count from the picture's beginning
        p = bytearray(picture(stop))
        struct.pack_into(">H", p, 6, 16)
        struct.pack_into(">H", p, 18, 16)
        return bytes(p)

    data = packet(shifted(4000)[:10]) + packet(shifted(4000)[10:])
    assert binary.spu(data, 0) == shifted(4000)
    assert abs(binary.spu_stop(binary.spu(data, 0)) - 4000) <= 12
    index = b"delay: 00:00:01:000\ntimestamp: 00:00:01:500, filepos: 000000000\ndelay: 00:00:02:000\ntimestamp: 00:00:30:000, filepos: 0000ffff\n"
    (first, second) = binary.idx(index, data)
    assert first[0] == 2500 and abs(first[1] - 6500) <= 12 and second == (32_000, 34_000)  # the later delay stands alone
    assert binary.spu_stop(b"") is None and binary.spu(b"junk", 0) == b""


def test_binary_files_are_patched(spark):
    segment = lambda ms, objects: b"PG" + struct.pack(">IIBH", ms * 90, 7, 0x16, 11) + bytes(10) + bytes([objects])
    data = segment(1500, 1) + segment(3000, 0) + b"tail"
    out = rewriters.patch_pgs(data, rewriters.Shift(0.0, 1.0), {0: 500})
    assert binary.pgs(out) == [(3000, 4500)] and out.endswith(b"tail") and len(out) == len(data)
    files = spark.createDataFrame([("x", bytearray(data)), ("y", bytearray(data))], "path string, content binary")
    moves = spark.createDataFrame([("x", 0, 700)], "path string, cue_no int, offset_ms int")
    got = {r["path"]: binary.pgs(bytes(r["content"])) for r in rewriters.patch(files, "sup", rewriters.Shift(offsets=moves)).collect()}
    assert got == {"x": [(2200, 3700)], "y": [(1500, 3000)]}
    assert rewriters.patch_ebu(b"short", rewriters.Shift(), {}) == b"short"


def test_saves_keep_their_history(spark, tmp_path):
    files = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    s = store.FileStore(spark, str(tmp_path / "store"))
    assert s.saves().count() == 0
    s.save(files(("a", "one"), ("b", "same")))
    s.save(files(("a", "two")))
    assert {r["path"]: r["text"] for r in s.current().collect()} == {"a": "two", "b": "same"}
    s.undo(files(("a", ""), ("b", ""), ("c", "")))
    assert {r["path"]: (r["text"], r["version"]) for r in s.current().collect()} == {"a": ("one", 3), "b": ("same", 1)}
    (tmp_path / "store" / "v9").mkdir()  # a save that never ended
    assert s.saves().select(F.max("version")).first()[0] == 3


def test_the_watcher_pauses(spark, tmp_path):
    (tmp_path / "m").mkdir()
    jobs = watch.JobTable(spark, str(tmp_path / "jobs"))
    w = watch.Watcher(watch.file_events(spark, str(tmp_path / "m")), jobs, str(tmp_path / "check"), "1 second")
    w.start()
    w.pause()
    assert w.paused and not w.query.isActive
    (tmp_path / "m" / "a.srt").write_text("x")
    w.start()  # paused: nothing begins
    assert not w.query.isActive and jobs.read().count() == 0
    w.resume()
    w.query.processAllAvailable()
    assert jobs.read().count() == 1 and not w.paused
    w.pause()


def test_by_hand_has_limits(spark):
    from tempora.operators import align

    df = spark.createDataFrame([(1, 1000, 2000)], "film_id long, start_ms int, end_ms int")
    with pytest.raises(ValueError, match="ratio"):
        align.by_hand(df, 3.0)
    assert align.by_hand(df, 2.0, -1500).select("start_ms", "end_ms").first() == (500, 2500)
