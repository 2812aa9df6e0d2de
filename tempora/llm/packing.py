"""Operator 8: packing documents into sequences of at most SIZE tokens, by patterns fitted with
non-negative least squares.

Documents are tokenized where they lie; each becomes pieces (only those longer than SIZE are cut, the
first piece taking the remainder). All that planning needs is the histogram of piece lengths, SIZE numbers
however large the corpus. The driver enumerates patterns of two and three lengths that fill a sequence
exactly, fits repeat counts to the histogram by non-negative least squares, rounds them to what is
there, and packs the residual with best-fit decreasing over counts. The plan gives, for each length,
ranges of ranks -> (pattern, place). A piece's rank among those of its length comes from a counter within its
task and the sum over the tasks before, so no group of equal lengths ever meets in one task.

Null text is empty: one piece holding only the end id. Repeated rows are packed each for itself; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import bpe
from tempora.llm.common import documents_only, materialize

SIZE, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((i, size) for i in range(first, n, size))]


def piece_maker(path: str, size: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, seen, task = bpe.library_coder(path), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        end = np.asarray([end_id], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"].array, pdf["text"].tolist(), strict=True):
                ids = coder.ids(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def fit_patterns(h: np.ndarray, size: int, rounds: int = 200) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of two or three lengths that add up to size, with repeat counts whose use stays within h.

    Non-negative least squares of A x = h by multiplicative updates, A's columns being the patterns."""
    have = np.flatnonzero(h)
    have = have[(have > 0) & (have < size)]
    if not len(have):
        return []
    there = h > 0
    cols = [np.stack([have, size - have, np.zeros_like(have)], 1)[(have * 2 <= size) & there[size - have]]]
    for a in have[have * 3 <= size]:
        b = have[(have >= a) & (2 * have <= size - a)]
        c = size - a - b
        ok = (c >= b) & there[c]
        cols.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    pats = np.concatenate(cols)
    if not len(pats):
        return []
    target = h.astype(float).copy()
    target[0] = 0
    up = lambda v: v[pats].sum(1)  # noqa: E731  A' v
    wanted = np.maximum(up(target), 1e-12)
    x = np.full(len(pats), target.sum() / (3 * len(pats)) + 1e-9)
    for _ in range(rounds):
        made = np.bincount(pats.ravel(), np.repeat(x, 3), minlength=size + 1)
        made[0] = 0
        x *= wanted / np.maximum(up(made), 1e-12)
    left, out = h.copy(), []
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        lengths, times = np.unique(pats[i][pats[i] > 0], return_counts=True)
        repeat = int(min(np.floor(x[i] + 0.5), (left[lengths] // times).min()))
        if repeat:
            left[lengths] -= times * repeat
            out.append((tuple(int(v) for v in sorted(pats[i][pats[i] > 0], reverse=True)), repeat))
    return out


def plan(h: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, longest first; how many such sequences), using up h[1..size] exactly."""
    out = fit_patterns(h, size)
    left = h.copy()
    for pattern, repeat in out:
        np.subtract.at(left, list(pattern), repeat)
    while (rest := np.flatnonzero(left)).size:
        free, used, pattern = size, np.zeros_like(left), []
        while free and (fits := rest[(rest <= free) & (left[rest] > used[rest])]).size:
            best = int(fits[-1])
            many = min(free // best, int(left[best] - used[best]))
            used[best] += many
            pattern += [best] * many
            free -= best * many
        lengths = np.flatnonzero(used)
        repeat = int((left[lengths] // used[lengths]).min())
        left -= used * repeat
        out.append((tuple(pattern), repeat))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For binary search: key (length << 44 | first rank), times in the pattern, first sequence, first offset."""
    used, rows, sequence = {}, [], 0
    for pattern, repeat in patterns:
        offset = 0
        for length in dict.fromkeys(pattern):
            times = pattern.count(length)
            rank = used.get(length, 0)
            rows.append((length << 44 | rank, rank, times, sequence, offset))
            used[length] = rank + times * repeat
            offset += length * times
        sequence += repeat
    cols = np.asarray(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("key", "rank", "times", "sequence", "offset"), cols, strict=True))


def placer(s: dict[str, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), (pdf["nth"] + pdf["before"]).to_numpy(np.int64)
            i = np.searchsorted(s["key"], length << 44 | rank, "right") - 1
            k = rank - s["rank"][i]
            out = pdf[["doc_id", "piece", "start"]].copy()
            out["length"], out["ids_crc32"] = length, pdf["ids_crc32"]
            out["sequence_id"], out["offset"] = s["sequence"][i] + k // s["times"][i], s["offset"][i] + k % s["times"][i] * length
            yield out

    return run


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    pieces = materialize(documents_only(docs).mapInPandas(piece_maker(path, size, end_id), PIECES), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    h = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # size rows at most
        h[r["length"]] = r["n"]
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return pieces.join(before, ["task", "length"]).mapInPandas(placer(slots(plan(h, size))), RESULT)
