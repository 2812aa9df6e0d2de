"""Operator 10: embedding near-duplicates, by dual traversal of cover trees.

Equal vectors of a label are one class, with a weight. A bounded sample of pivots (the classes of smallest hash, one
for PER_PIVOT classes of the largest label, PIVOTS at most) is the top level. Each class is an owner in the cell of its
nearest pivot, and visits a cell of a lower pivot only if it is no farther from that pivot than the cell's covering
radius and the threshold distance together; so each pair meets in one cell at most, and no pair of cells is listed.
Owners and visitors of a cell are dealt to chunks of about CELL, and chunks of owners meet chunks of either.

Where two chunks meet, each becomes a cover tree, levels with halving radii down to single vectors, and both are
descended together. A pair of nodes whose covering balls are too far apart is pruned; one whose balls are so close
that every pair of members is a link is counted whole; what is left is compared in double precision. Nothing is
approximate: both bounds follow from the triangle inequality on unit vectors. A meeting returns counts of links and a
spanning forest of its links, an edge for a vector at most.

Links: same label (not null), same number of components, cosine >= threshold. Vectors that are null, zero,
empty, or hold null or non-finite components, and rows with a null label or vec_id, link with nothing. Components
are scaled by a power of two first, so that very large and very small ones neither overflow nor vanish.
Rows that repeat a vec_id count as vectors of their own. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import materialize
from tempora.llm.components import components

THRESHOLD, PIVOTS, PER_PIVOT, CELL, LEAF = 0.93, 1024, 4096, 2048, 16
_SLACK = 1e-9


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, the largest component of each then being in [0.5, 1): exact, and safe to square."""
    top = np.abs(v).max(1, keepdims=True)
    exponent = np.frexp(top)[1]
    return np.ldexp(v, -exponent)


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(1))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors; may be off by up to 1e-7 for near ones, which callers allow for."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


@dataclass
class Node:
    """members in order of children, the center first; all lie within radius of it. Children that are single vectors are only listed in centers."""

    members: np.ndarray
    radius: float
    centers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    radii: np.ndarray = field(default_factory=lambda: np.zeros(0))
    children: list[Node | None] = field(default_factory=list)

    def parts(self) -> tuple[np.ndarray, np.ndarray, list]:
        """Centers, radii and nodes of its children; without any, its own."""
        return (self.centers, self.radii, self.children) if self.children else (self.members[:1], np.asarray([self.radius]), [self])


#: What float error may add to a distance of unit vectors: sqrt of a few units in the last place.
_ERROR = 1e-7


def net(u: np.ndarray, members: np.ndarray, reach: float) -> tuple[list[int], np.ndarray]:
    """Centers over reach apart, in order of members, and for each member the number of the first center within reach of it."""
    centers: list[int] = []
    of = np.full(len(members), -1)
    for i in range(0, len(members), 256):
        block = members[i : i + 256]
        if centers:
            near = distances(u[block], u[centers]) <= reach
            of[i : i + 256] = np.where(near.any(1), near.argmax(1), -1)
        left = np.flatnonzero(of[i : i + 256] < 0)
        if len(left):
            near = distances(u[block[left]], u[block[left]]) <= reach
            for k in range(len(left)):
                if of[i + left[k]] < 0:
                    free = left[near[k] & (of[i + left] < 0)]
                    of[i + free] = len(centers)
                    of[i + left[k]] = len(centers)
                    centers.append(int(block[left[k]]))
    return centers, of


def build(u: np.ndarray, members: np.ndarray, center: int) -> Node:
    """The cover tree of members: the children's centers are over half the radius apart and cover what is theirs within it."""
    radius = float(distances(u[members], u[[center]]).max()) + _ERROR
    if len(members) <= LEAF or radius <= 4 * _ERROR:
        return Node(members, radius)
    first = np.r_[center, members[members != center]]
    centers, of = net(u, first, radius / 2)
    order = np.argsort(of, kind="stable")
    parts = np.split(first[order], np.flatnonzero(np.diff(of[order])) + 1)
    children = [None if len(p) == 1 else build(u, p, c) for p, c in zip(parts, centers, strict=True)]
    return Node(np.concatenate(parts), radius, np.asarray(centers), np.asarray([0.0 if c is None else c.radius for c in children]), children)


class Links:
    """Counts of links and components of the vectors a, then b (none: a with itself)."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None, weights: np.ndarray, threshold: float):
        self.raw = scaled(a if b is None else np.concatenate([a, b]))
        self.norm = np.sqrt((self.raw * self.raw).sum(1))
        self.u, self.weights, self.threshold = self.raw / self.norm[:, None], weights, threshold
        self.n, self.root, self.computed = np.zeros(len(self.raw), np.int64), np.arange(len(self.raw)), 0
        self.far = math.sqrt(max(0.0, 2 - 2 * threshold)) + 2 * _ERROR  # beyond it, no link
        self.sure = math.sqrt(max(0.0, 2 - 2 * threshold - _SLACK)) - 2 * _ERROR  # within it, a link for certain
        top = build(self.u, np.arange(len(a)), 0)
        if b is None:
            self.within(top)
        elif len(b):
            self.between(top, build(self.u, np.arange(len(a), len(self.raw)), len(a)))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            p, q = self.root[i], self.root[j]
            if (differ := p != q).any():
                low, high = np.minimum(p, q)[differ], np.maximum(p, q)[differ]
                np.minimum.at(self.root, high, low)
                while (self.root != (up := self.root[self.root])).any():
                    self.root = up
            else:
                return

    def whole(self, x: np.ndarray, y: np.ndarray | None) -> None:
        """Every pair of x and y is a link; every pair within x, if y is None."""
        w = self.weights
        if y is None:
            self.n[x] += w[x].sum() - w[x]
            self.join(x[1:], np.full(len(x) - 1, x[0]))
        else:
            self.n[x] += w[y].sum()
            self.n[y] += w[x].sum()
            both = np.r_[x, y]
            self.join(both[1:], np.full(len(both) - 1, both[0]))

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs that may be links are compared as the definition says."""
        for k in range(0, len(i), 1 << 18):
            a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            ok = np.einsum("ij,ij->i", self.raw[a], self.raw[b]) / (self.norm[a] * self.norm[b]) >= self.threshold
            a, b = a[ok], b[ok]
            np.add.at(self.n, a, self.weights[b])
            np.add.at(self.n, b, self.weights[a])
            self.join(a, b)

    def leaves(self, x: np.ndarray, y: np.ndarray | None) -> None:
        y_ = x if y is None else y
        self.computed += len(x) * len(y_)
        cos = self.u[x] @ self.u[y_].T >= self.threshold - _SLACK
        i, j = np.nonzero(np.triu(cos, 1) if y is None else cos)
        self.pairs(x[i], y_[j])

    def within(self, top: Node) -> None:
        stack = [top]
        while stack:
            x = stack.pop()
            if 2 * x.radius <= self.sure:
                self.whole(x.members, None)
            elif not x.children:
                self.leaves(x.members, None)
            else:
                stack += [c for c in x.children if c is not None]
                self.between(x, x)

    def between(self, x: Node, y: Node) -> None:
        """Members of x with those of y; if they are one node, those of different children of it."""
        stack = [(x, y)]
        while stack:
            x, y = stack.pop()
            if not x.children and not y.children:
                self.leaves(x.members, y.members)
                continue
            (a, ra, of_a), (b, rb, of_b) = x.parts(), y.parts()
            d, reach = distances(self.u[a], self.u[b]), ra[:, None] + rb
            self.computed += d.size
            live = d <= self.far + reach
            i, j = np.nonzero(np.triu(live, 1) if x is y else live)
            single = np.asarray([c is None for c in of_a])[i] & np.asarray([c is None for c in of_b])[j]
            self.pairs(a[i[single]], b[j[single]])
            i, j = i[~single], j[~single]
            for k, m, sure in zip(i.tolist(), j.tolist(), (d[i, j] + reach[i, j] <= self.sure).tolist(), strict=True):
                p, q = of_a[k] or Node(a[[k]], 0.0), of_b[m] or Node(b[[m]], 0.0)
                if sure:
                    self.whole(p.members, q.members)
                else:
                    stack.append((p, q))


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = (pdf["side"] == 0).to_numpy()
        pdf = pd.concat([pdf[first], pdf[~first]])
        v, rep, k, alone = np.stack(pdf["v"].to_numpy()).astype(float), pdf["rep"].to_numpy(np.int64), int(first.sum()), bool(pdf["alone"].iat[0])
        if not k or (k == len(v)) != alone:
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        got = Links(v[:k], None if alone else v[k:], pdf["m"].to_numpy(np.int64), threshold)
        has = np.flatnonzero(got.n)
        return pd.DataFrame({"a": rep[has], "b": rep[got.root[has]], "n": got.n[has]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("label"))
    sound = F.expr("vec_id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and abs(x) < double('inf')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = materialize(rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m")), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    wanted = min(PIVOTS, 1 + largest // PER_PIVOT)
    picked = classes.orderBy(F.xxhash64("v"), "rep").limit(wanted).select("v").collect()  # PIVOTS rows at most
    by_size: dict[int, list[int]] = {}
    for k, r in enumerate(picked):
        by_size.setdefault(len(r["v"]), []).append(k)
    tops = {d: (np.asarray(ks), unit(np.asarray([picked[k]["v"] for k in ks]))) for d, ks in by_size.items()}

    def to_pivots(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, numbers of the pivots of their size, distances from these), some rows at a time."""
        size = pdf["v"].map(len).to_numpy()
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            if d in tops:
                for i in range(0, len(at), 1024):
                    yield at[i : i + 1024], tops[d][0], distances(unit(np.stack(pdf["v"].iloc[at[i : i + 1024]].to_numpy())), tops[d][1])

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pivot, far = np.full(len(pdf), -1), np.full(len(pdf), 2.0)  # -1: no pivot has as many components
            for at, ks, d in to_pivots(pdf):
                pivot[at], far[at] = ks[d.argmin(1)], d.min(1)
            yield pdf.assign(pivot=pivot, far=far, dim=pdf["v"].map(len).astype("int32"))

    fields = f"label {dict(classes.dtypes)['label']}, v array<double>, rep long, m long, pivot int, far double, dim int"
    homes = materialize(classes.mapInPandas(home, fields), "homes")
    cover = np.full(len(picked), -1.0)
    for r in homes.where("pivot >= 0").groupBy("pivot").agg(F.max("far").alias("far")).collect():  # PIVOTS rows at most
        cover[r["pivot"]] = r["far"]
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 4 * _ERROR

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, to = pdf["pivot"].to_numpy(), [[-1]] * len(pdf)
            for at, ks, d in to_pivots(pdf):
                near = (ks < own[at][:, None]) & (d <= cover[ks] + reach)
                for i, row in zip(at.tolist(), near, strict=True):
                    to[i] = [int(own[i]), *ks[row].tolist()]
            yield pdf.drop(columns="far").assign(to=to)

    spread = homes.mapInPandas(visits, fields.replace("far double", "to array<int>").replace("pivot int, to array<int>, dim int", "pivot int, dim int, to array<int>"))
    spread = spread.select("label", "dim", F.explode("to").alias("cell"), "pivot", "v", "rep", "m").withColumn("owner", F.col("cell") == F.col("pivot")).drop("pivot")
    spread = materialize(spread, "spread")
    cells = ["label", "dim", "cell"]
    share = lambda mine: F.ceil(F.sum(mine.cast("long")) / CELL).cast("int")
    sizes = materialize(spread.groupBy(*cells).agg(share(F.col("owner")).alias("g"), share(~F.col("owner")).alias("h")), "sizes").where("g > 0")
    chunk = F.pmod(F.xxhash64("rep"), F.when(F.col("owner"), F.col("g")).otherwise(F.col("h"))).cast("int")
    # chunk i of the owners meets itself, those after it, and each chunk of the visitors
    meetings = F.expr("""case when owner then concat(transform(sequence(c, g + h - 1), j -> struct(c as i, j as j, 0 as side)), filter(transform(sequence(0, c), i -> struct(i as i, c as j, 1 as side)), x -> x.i < c))
        else transform(sequence(0, g - 1), i -> struct(i as i, g + c as j, 1 as side)) end""")
    dealt = spread.join(sizes, cells).withColumn("c", chunk).select(*cells, F.explode(meetings).alias("x"), "rep", "m", "v").select(*cells, "x.*", "rep", "m", "v").withColumn("alone", F.col("i") == F.col("j"))
    found = materialize(dealt.groupBy(*cells, "i", "j").applyInPandas(_compare(threshold), "a long, b long, n long"), "found")
    groups_of = components(found.where("a <> b").select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    known = classes.join(counts, classes.rep == counts.a, "left").join(groups_of, classes.rep == groups_of.node, "left")
    known = materialize(known.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    linked = rows.where("sound").join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    return linked.union(rows.where("not sound").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
