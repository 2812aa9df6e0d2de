"""Binary timed text: EBU STL, SCC, PGS and VobSub; WAV speech energy. Parsers of single files, run over Arrow batches."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CUES = "path string, cue_no int, start_ms int, end_ms int"


def shown(marks: list[tuple[int, bool]]) -> list[tuple[int, int]]:
    """Spans of (time, show) marks: to the next mark, 2 s without one that is later, 10 s at most."""
    out = []
    for i, (at, show) in enumerate(marks):
        if show:
            end = marks[i + 1][0] if i + 1 < len(marks) else at
            out.append((at, min(end if end > at else at + 2000, at + 10_000)))
    return out


def is_ebu(data: bytes) -> bool:
    return len(data) >= 1024 and data[3:6] == b"STL"


def ebu_fps(data: bytes) -> int:
    return 30 if data[6:8] == b"30" else 25


def ebu_ms(b: bytes, fps: int) -> int:
    return ((b[0] * 60 + b[1]) * 60 + b[2]) * 1000 + int(b[3] * 1000 / fps + 0.5)


def ebu_zero(data: bytes) -> int:
    """The programme's start."""
    start = data[256:264]
    return ebu_ms(bytes(int(start[i : i + 2]) for i in (0, 2, 4, 6)), ebu_fps(data)) if start.isdigit() else 0


def ebu_stl(data: bytes) -> list[tuple[int, int]]:
    """1024 bytes of header, then records of 128: comments and continued numbers are skipped, the programme's start is taken off."""
    if not is_ebu(data):
        return []
    fps, zero, out, last = ebu_fps(data), ebu_zero(data), [], None
    for i in range(1024, len(data) - 127, 128):
        r = data[i : i + 128]
        number = struct.unpack_from("<H", r, 1)[0]
        if r[15] or number == last:
            continue
        last = number
        out.append((max(0, ebu_ms(r[5:9], fps) - zero), max(0, ebu_ms(r[9:13], fps) - zero)))
    return out


def pgs(data: bytes) -> list[tuple[int, int]]:
    """Segments 'PG', 90 kHz time; a composition with objects shows, one without hides."""
    marks, i = [], 0
    while i + 13 <= len(data) and data[i : i + 2] == b"PG":
        pts, _, kind, size = struct.unpack_from(">IIBH", data, i + 2)
        if kind == 0x16 and size >= 11 and i + 24 <= len(data):
            marks.append((pts // 90, data[i + 23] > 0))
        i += 13 + size
    return shown(marks)


def scc(data: bytes) -> list[tuple[int, int]]:
    """Closed-caption codes without their parity bit; a frame is 33 ms. subtitles.read_scc says the same as a plan."""
    marks, popon = [], True
    for m in re.finditer(r"(?m)^[ \t]*(\d+):(\d+):(\d+)[:;](\d+)([^\n]*)", data.decode("latin-1")):
        h, mi, s, f = map(int, m.groups()[:4])
        codes = [int(x[-4:], 16) & 0x7F7F for x in m[5].split() if re.fullmatch("[0-9A-Fa-f]+", x)]
        plain = [c & 0xF7FF for c in codes]
        for c in plain:
            popon = True if c == 0x1420 else False if c in (0x1425, 0x1426, 0x1427, 0x1429) else popon
        show = 0x142F in plain or (not popon and any(c >= 0x2000 for c in codes))
        if show or 0x142C in plain:
            marks.append((((h * 60 + mi) * 60 + s) * 1000 + f * 33, show))
    return shown(marks)


def idx(data: bytes, pictures: bytes = b"") -> list[tuple[int, int]]:
    """timestamp: lines, each moved by the delay in force; shown until its picture's stop, else until the next."""
    delay, starts, stops = 0, [], []
    for line in data.decode("latin-1").splitlines():
        if m := re.match(r"delay: *([+-]?)(\d+):(\d+):(\d+):(\d+)", line):
            delay = _clock(m.groups()[1:]) * (-1 if m[1] == "-" else 1)
        elif m := re.search(r"timestamp: *(\d+):(\d+):(\d+):(\d+),?(?:.*filepos: *([0-9a-fA-F]+))?", line):
            starts.append(_clock(m.groups()[:4]) + delay)
            stops.append(spu_stop(spu(pictures, int(m[5], 16))) if m[5] and pictures else None)
    out = []
    for i, (start, stop) in enumerate(zip(starts, stops, strict=True)):
        end = starts[i + 1] if i + 1 < len(starts) and starts[i + 1] > start else start + 2000
        end = start + stop if stop else end
        out.append((max(0, start), max(0, min(end, start + 10_000))))
    return out


def _clock(x: tuple[str, ...]) -> int:
    h, m, s, ms = map(int, x)
    return ((h * 60 + m) * 60 + s) * 1000 + ms


def spu(data: bytes, at: int) -> bytes:
    """The picture whose packets begin at a place: the bodies of private stream 1, of one substream, as long as the picture says it is."""
    out, want, stream = b"", None, None
    while at + 14 <= len(data) and data[at : at + 3] == b"\0\0\1" and (want is None or len(out) < want):
        if data[at + 3] == 0xBA:  # a pack header
            at += 14 + (data[at + 13] & 7)
            continue
        size = struct.unpack_from(">H", data, at + 4)[0]
        body, end = at + 9 + data[at + 8], min(at + 6 + size, len(data))
        if data[at + 3] == 0xBD and body < end and stream in (None, data[body]):
            stream = data[body]
            out += data[body + 1 : end]
            want = struct.unpack_from(">H", out)[0] if want is None and len(out) >= 2 else want
        at += 6 + size
    return out


#: Bytes that follow a picture's commands.
_OPERANDS = {0x00: 0, 0x01: 0, 0x03: 2, 0x04: 2, 0x05: 6, 0x06: 4}


def spu_stop(picture: bytes) -> int | None:
    """When a picture leaves the screen, in ms after it came: the date of the sequence that holds command 02."""
    if len(picture) < 4:
        return None
    size, at = struct.unpack_from(">HH", picture)
    size = min(size, len(picture))
    while at + 4 <= size:
        date, following = struct.unpack_from(">HH", picture, at)
        p = at + 4
        while p < size and picture[p] in _OPERANDS:
            p += 1 + _OPERANDS[picture[p]]
        if p < size and picture[p] == 0x02:
            return date * 1024 // 90
        if following <= at:
            return None
        at = following
    return None


PARSERS: dict[str, Callable[[bytes], list[tuple[int, int]]]] = {"stl": ebu_stl, "sup": pgs, "scc": scc, "idx": idx}


def read(files: DataFrame, kind: str) -> DataFrame:
    """path, content (and pictures, those of an index's .sub file, if there is such a column) -> cues."""
    parse = PARSERS[kind]
    names = ["content", *[c for c in ("pictures",) if c in files.columns and kind == "idx"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = zip(*(pdf[c].tolist() for c in names), strict=True)
            rows = [(p, k, s, e) for p, x in zip(pdf["path"], parts, strict=True) for k, (s, e) in enumerate(parse(*(bytes(c or b"") for c in x)))]
            yield pd.DataFrame(rows, columns=["path", "cue_no", "start_ms", "end_ms"])

    return files.select("path", *names).mapInPandas(run, CUES)


def wav(samples: np.ndarray, rate: int = 16_000) -> bytes:
    pcm = np.clip(samples, -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


def speech_frames(files: DataFrame) -> DataFrame:
    """path, frame_no, p: of each 10 ms of a WAV file, a stand-in for speech probability, its loudness against the 90th percentile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(content)
                at = data.find(b"data")
                x = np.frombuffer(data[at + 8 : at + 8 + (len(data) - at - 8) // 2 * 2], "<i2").astype(float)
                x = x[: len(x) // 160 * 160].reshape(-1, 160)
                rms = np.sqrt((x * x).mean(1))
                loud = np.sort(rms)[len(rms) * 9 // 10] if len(rms) else 1.0
                yield pd.DataFrame({"path": path, "frame_no": np.arange(len(rms), dtype="int32"), "p": np.minimum(1, rms / max(loud, 1e-9))})

    return files.select("path", "content").mapInPandas(run, "path string, frame_no int, p double")
