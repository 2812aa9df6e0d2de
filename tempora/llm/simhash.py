"""Operator 6: SimHash near-duplicates, with bit-sliced comparison.

Each distinct fingerprint is compared once, whatever its number of copies. 64 bits are cut into
radius + k parts; two fingerprints within the radius agree on at least k parts, so each is dealt to one
bucket for each k parts and no link is lost. k grows with the number of fingerprints: keys become wider and
more, so that chance meetings in a bucket stay few at any size. A bucket that holds more than CHUNK fingerprints
is dealt again, as pairs of chunks. Within a bucket the fingerprints stand vertically, one 64-bit plane for each
bit, 64 fingerprints in a word; carry-save adders count the differing bits of all lanes at once, and a query
stops as soon as all its lanes have more than the radius; buckets of up to FEW, far fewer than a word's lanes, are
compared pair by pair. Only a spanning forest of each bucket's links leaves it: a group of n near copies yields
n - 1 edges, not n * n.

Null and empty texts have fingerprint zero, linked like any other. Rows with a null doc_id get their
fingerprint's component if a row with an id shares it, else null. Repeated rows give repeated results; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import documents_only, materialize
from tempora.llm.components import components

SHINGLE, RADIUS, SEED, CHUNK, FEW = 4, 4, 42, 1024, 8
#: Fingerprints that a bucket of random ones may hold on average before keys get wider.
CROWD = 4
_U = np.uint64
_ALL = _U(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    begin = (ends - size)[: len(words) - k + 1].tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(begin, ends[k - 1 :].tolist(), strict=True)), _U, len(begin))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(h)).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.asarray([fingerprint(t, shingle) for t in pdf["text"].tolist()], _U)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "fp": fp.view(np.int64)})

    return documents_only(docs).mapInPandas(run, "doc_id long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of fingerprint 64 * w + i is bit i of [b, w]."""
    bits = np.zeros((-(-len(fps) // 64) * 64, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(_U)


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """(queries, words): lanes that differ from the query in at most radius (under 8) bits."""
    out = np.zeros((len(queries), planes.shape[1]), _U)
    alive = np.arange(len(queries))
    one = two = four = over = np.zeros_like(out)
    for start in range(0, 64, 8):
        x = [planes[b] ^ np.where(queries[alive] >> _U(b) & _U(1), _ALL, _U(0))[:, None] for b in range(start, start + 8)]
        one, a = _csa(one, x[0], x[1])
        one, b = _csa(one, x[2], x[3])
        two, c = _csa(two, a, b)
        one, a = _csa(one, x[4], x[5])
        one, b = _csa(one, x[6], x[7])
        two, d = _csa(two, a, b)
        four, eight = _csa(four, c, d)
        over = over | eight
        bits, more, equal = (one, two, four), over, ~over
        for i in (2, 1, 0):
            if radius >> i & 1:
                equal = equal & bits[i]
            else:
                more, equal = more | equal & bits[i], equal & ~bits[i]
        near = ~more
        keep = near.any(1)
        if not keep.all():  # every lane of these queries is beyond the radius
            alive, one, two, four, over, near = (v[keep] for v in (alive, one, two, four, over, near))
            if not len(alive):
                return out
    out[alive] = near
    return out


def spanning(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the links among fps; each is a query once, against what isn't reached yet."""
    rest, planes, edges = np.arange(len(fps)), planes_of(fps), []
    free = np.ones(len(fps), bool)  # by lane
    while free.any():
        front = np.flatnonzero(free)[:1]
        free[front] = False
        while len(front):
            new = []
            for part in np.array_split(front, -(-len(front) // 64)):
                hit = np.unpackbits(within(planes, fps[rest[part]], radius).astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(rest)].astype(bool) & free
                for q, lanes in zip(part.tolist(), hit, strict=True):
                    got = np.flatnonzero(lanes & free)
                    if len(got):
                        free[got] = False
                        edges += [(int(rest[q]), int(rest[j])) for j in got]
                        new.append(got)
            front = np.concatenate(new) if new else front[:0]
            if len(front) and 2 * (free.sum() + len(front)) < len(rest):  # fewer lanes from here on
                keep = np.union1d(front, np.flatnonzero(free))
                front = np.searchsorted(keep, front)
                rest, free, planes = rest[keep], free[keep], planes_of(fps[rest[keep]])
    return edges


def _linker(radius: int):
    def of(fp: np.ndarray, rep: np.ndarray, key: np.ndarray) -> pd.DataFrame:
        """The rows of whole buckets, in order of their key."""
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[at, len(key)])
        a, b = [], []
        for n in range(2, FEW + 1):
            first = at[size == n]
            for i, j in itertools.combinations(range(n), 2):
                near = first[np.bitwise_count(fp[first + i] ^ fp[first + j]) <= radius]
                a.append(rep[near + i])
                b.append(rep[near + j])
        for i, n in zip(at[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
            if edges := spanning(fp[i : i + n], radius):
                e = np.asarray(edges)
                a.append(rep[i + e[:, 0]])
                b.append(rep[i + e[:, 1]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = np.cumsum(np.r_[False, (np.diff(pdf["bucket"].to_numpy()) != 0) | (np.diff(pdf["part"].to_numpy()) != 0)])[: len(pdf)]
            end = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on in the next batch
            held = pdf.iloc[end:]
            if end:
                yield of(pdf["fp"].to_numpy(np.int64)[:end].view(_U), pdf["rep"].to_numpy(np.int64)[:end], key[:end])
        if held is not None and len(held):
            yield of(held["fp"].to_numpy(np.int64).view(_U), held["rep"].to_numpy(np.int64), np.zeros(len(held), np.int64))

    return run


def agreeing(n: int, radius: int) -> int:
    """k: on how many of radius + k parts the fingerprints of a bucket agree, for n fingerprints."""
    k = 2
    while k < 5 and n > CROWD << (64 * k // (radius + k)):
        k += 1
    return k


def buckets(fp: str, radius: int, k: int = 2) -> list:
    """A column for each k of radius + k parts of the bits: a hash of which they are and what they hold."""
    parts = radius + k
    edge = [64 * i // parts for i in range(parts + 1)]
    mask = lambda chosen: sum(((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in chosen)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [F.xxhash64(F.lit(m), F.col(fp).bitwiseAND(F.lit(signed(mask(chosen))))) for m, chosen in enumerate(itertools.combinations(range(parts), k))]


def _classes(each: DataFrame, radius: int) -> DataFrame:
    """fp, component (a fp of its component, the same for all): of (fp) with repeats."""
    distinct = materialize(each.select("fp").distinct(), "distinct")
    n = distinct.count()
    rows = distinct.select(F.explode(F.array(*buckets("fp", radius, agreeing(n, radius)))).alias("bucket"), "fp")
    shared = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    chunks = F.ceil(F.col("n") / CHUNK).cast("long")
    dealt = rows.join(shared, "bucket").select("bucket", "fp", chunks.alias("g")).withColumn("mine", F.pmod(F.xxhash64("fp"), "g"))
    dealt = dealt.select("bucket", F.explode(F.expr("transform(sequence(0L, g - 1), j -> least(mine, j) * g + greatest(mine, j))")).alias("part"), "fp", F.col("fp").alias("rep"))
    # a number of partitions given: the rows are few bytes, what is done with them isn't little
    tasks = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = dealt.repartition(tasks, "bucket", "part").sortWithinPartitions("bucket", "part").mapInPandas(_linker(radius), "a long, b long")
    found = components(edges)
    return materialize(distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component")), "classes")


def _check(radius: int) -> None:
    if not 0 <= radius < 8:
        raise ValueError("the radius must be from 0 to 7")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    _check(radius)
    each = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = _classes(each, radius)
    least = each.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes, "fp")
    smallest = materialize(least.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    known = materialize(classes.join(smallest, "component").select("fp", "component_id"), "known")
    return each.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id (null last), the smallest hash of the text among its rows, any of those with equal texts.

    Rows are told apart by a number of their own, given as they are written with their fingerprints, so repeated and null ids lose nothing else."""
    _check(radius)
    names = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = pdf["text"].astype(object).where(pdf["text"].notna(), "").tolist()
            pdf["fp_"] = np.asarray([fingerprint(t, shingle) for t in text], _U).view(np.int64)
            yield pdf

    with_fp = docs.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", fp_ long")
    rows = materialize(with_fp.withColumn("row_", F.monotonically_increasing_id()), "numbered")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col("row_").alias("row"))
    best = rows.groupBy(F.col("fp_").alias("fp")).agg(F.min(order).alias("first"))
    best = materialize(best, "first")
    kept = best.join(_classes(best, radius), "fp").groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("kept_"))
    # by an exchange at any size: what small inputs would save by a broadcast says nothing of large ones
    return rows.join(materialize(kept, "kept").hint("merge"), F.col("row_") == F.col("kept_"), "left_semi").select(*names)
