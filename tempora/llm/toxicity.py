"""Operator 2: toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Strings are words between a start and an end mark. The kernel is the gap-weighted subsequence kernel of order
three: each subsequence of three characters, within a window of SPAN, weighs DECAY to the number of skipped
characters. So an insult with inserted or missing characters still shares most of its subsequences; words
spelled out with blanks or dots are joined first. A word's value for a landmark is relative to the landmark's
own (values under FLOOR count as 0), squared. A text has two values for each landmark: that of its most similar
word (a match kernel of word sets), and the mean over its words, in units of RATE and 1 at most (a mean-map
kernel), so that a chance likeness in a long text says little. The Nystroem map whitens both by the inverse root
of the kernel among landmarks, and a linear support vector machine is trained on them. Landmarks are words and word
beginnings chosen greedily by how many toxic training texts hold them, once or at least twice, that fewer than
COVER landmarks explain so far, against their share of clean texts.

Training takes at most PER_CLASS labelled texts of each class, those of smallest hash among texts of at most
LONGEST characters, and adds a variant of each toxic text with characters inserted into its most telling words.
Where margins turn into predictions is found by FOLDS-fold cross-validation within these rows: each part's margins
come from landmarks and weights chosen without it.
Scoring covers every whole text; a word's values are computed once a task while they stay in a bounded cache.

Null and empty texts get the score of a text without any similar word. If a class has no training rows the
score is 0 for all. Repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import documents_only

SPAN, DECAY, FLOOR, LANDMARKS, COVER, PER_CLASS, LONGEST, CUT, RATE = 6, 0.7, 0.5, 64, 3, 1500, 20_000, 0.7, 0.02
#: Clean texts for each toxic one, where scores are cut; parts of the training rows whose margins come from models of the other parts.
WEIGHT, FOLDS, SLOPE = 10, 3, 4.0
RESULT = "doc_id long, held_out boolean, score double, predicted int"
_WORD = re.compile(r"[^\s.,;:!?()\[\]{}\"|]+")
_SPELLED = re.compile(r"(?<!\S)(?:\w[ .*_-]){3,}\w(?!\S)")
_CODES = 64


def words_of(text: str) -> Counter[str]:
    """The words in lower case and how often they occur, spelled-out ones joined as well."""
    text = text.lower().replace("\x00", " ")
    out = Counter(_WORD.findall(text))
    if m := _SPELLED.findall(text):
        out.update(re.sub(r"[ .*_-]", "", x) for x in m)
    return out


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers under _CODES, and the word of each; a word's beginning (with a trailing NUL) has no end mark."""
    marked = [f"\x02{w[:-1]}" if w[-1:] == "\x00" else f"\x02{w}\x03" for w in words]
    c = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
    table = np.where((c >= 97) & (c <= 122), c - 96, np.where(c == 2, 27, np.where(c == 3, 28, 29 + c % (_CODES - 29))))
    return table, np.repeat(np.arange(len(words)), [len(w) for w in marked])


def _triples(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape of gap: the word and the code of each subsequence of that shape, and its weight."""
    c, of = _codes(words)
    for b in range(2, SPAN):
        for a in range(1, b):
            if len(c) > b:
                same = of[:-b] == of[b:]
                yield of[:-b][same], ((c[:-b] * _CODES + c[a : len(c) - b + a]) * _CODES + c[b:])[same], DECAY ** (b - 2)


class Kernel:
    """Values of words for landmarks, relative to each landmark's own."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        table = np.zeros((_CODES**3, len(landmarks)), np.float32)
        for of, code, weight in _triples(landmarks):
            np.add.at(table, (code, of), weight)
        self.own = (table**2).sum(0)
        self.used = table.any(1)
        self.row = np.cumsum(self.used) - 1
        self.table = table[self.used] / self.own
        self.most = np.zeros(_CODES**3, np.float32)
        self.most[self.used] = self.table.max(1)

    def raw(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for of, code, weight in _triples(words):
            hit = self.used[code]
            of, rows = of[hit], self.row[code[hit]]
            if len(of):
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                out[of[first]] += weight * np.add.reduceat(self.table[rows], first, axis=0)
        return out

    def values(self, words: list[str]) -> np.ndarray:
        bound = np.zeros(len(words), np.float32)  # of any landmark's value; most words stay below the floor
        for of, code, weight in _triples(words):
            if len(of):
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                bound[of[first]] += weight * np.add.reduceat(self.most[code], first)
        near = np.flatnonzero(bound >= FLOOR * 0.999)
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if len(near):
            v = np.minimum(self.raw([words[i] for i in near.tolist()]), 1)
            v[v < FLOOR] = 0
            out[near] = v * v
        return out


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # on the pooled values, most and mean, the Nystroem map included
    bias: float
    slope: float
    middle: float  # the margin whose score is 0.5

    def margin(self, values: np.ndarray) -> np.ndarray:
        return values @ self.weights + self.bias

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.margin(values) - self.middle), -40, 40)))


def _candidates(words: Counter[str]) -> Iterator[str]:
    """Words and beginnings of words (marked by a trailing NUL) of a text, and those that occur twice or more again with another NUL."""
    n: Counter[str] = Counter()
    for w, k in words.items():
        if 3 <= len(w) <= 24:
            n[w] += k
        for i in range(4, min(len(w), 9)):
            n[w[:i] + "\x00"] += k
    yield from n
    yield from (x.rstrip("\x00") + "\x00" * (2 + x.endswith("\x00")) for x, k in n.items() if k > 1)


def choose_landmarks(toxic: list[Counter[str]], clean: list[Counter[str]], most: int = LANDMARKS) -> list[str]:
    """Words, or beginnings of words, that explain the toxic texts. Only what is frequent among these is kept in memory."""
    n1: Counter[str] = Counter()
    for w in toxic:
        n1.update(_candidates(w))
    least = max(2, len(toxic) // 400)
    n1 = Counter({x: n for x, n in n1.items() if n >= least})
    n0: Counter[str] = Counter()
    for w in clean:
        n0.update(x for x in _candidates(w) if x in n1)
    odds = {x: math.log((n / len(toxic) + 1e-4) / (n0[x] / len(clean) + 2.0 / len(clean))) for x, n in n1.items()}
    good = {x: x for x, o in odds.items() if o > 1.5}
    left, out = [(COVER, {good[x] for x in _candidates(w) if x in good}) for w in toxic], []
    gain = Counter(x for _, s in left for x in s)
    while gain and len(out) < most:
        best = max(gain, key=lambda x: (gain[x] * odds[x], len(x), x))
        if gain[best] < max(3, len(toxic) // 80):
            break
        stem = best.rstrip("\x00")
        out.append(stem + "\x00" * ((len(best) - len(stem)) % 2))
        alike = {x for x in gain if x.startswith(stem) or stem.startswith(x.rstrip("\x00"))}  # they would say the same
        rest = []
        for n, s in left:  # a text counts until COVER landmarks explain it
            got = s & alike
            s -= got
            if best in got:
                if n == 1:
                    gain.subtract(s)
                    continue
                n -= 1
            rest.append((n, s))
        left = rest
        gain = Counter({x: n for x, n in gain.items() if n > 0 and x not in alike})
    return out


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate descent; y in -1, 1; c: the cost of each row."""
    x = np.c_[x, np.ones(len(x))]
    w, a, q, order = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1), np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            new = min(max(a[i] - (y[i] * (w @ x[i]) - 1) / q[i], 0.0), c[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w[:-1], float(w[-1])


def pooled(texts: list[Counter[str]], known: dict[str, np.ndarray], landmarks: int) -> np.ndarray:
    """For each text, each landmark's value of the most similar word, then the mean over all words in units of RATE."""
    out = np.zeros((len(texts), 2 * landmarks))
    for k, words in enumerate(texts):
        if hits := words.keys() & known.keys():
            v = np.stack([known[w] for w in hits])
            out[k, :landmarks] = v.max(0)
            out[k, landmarks:] = np.minimum(1, np.fromiter((words[w] for w in hits), float, len(hits)) @ v / (RATE * words.total()))
    return out


def _pool(kernel: Kernel, texts: list[Counter[str]]) -> np.ndarray:
    known: dict[str, np.ndarray] = {}
    every = sorted({w for t in texts for w in t})
    for i in range(0, len(every), 20_000):
        part = every[i : i + 20_000]
        v = kernel.values(part)
        known.update((part[k], v[k]) for k in np.flatnonzero(v.any(1)).tolist())
    return pooled(texts, known, len(kernel.landmarks))


def machine(words: list[Counter[str]], y: np.ndarray, landmarks_at_most: int = LANDMARKS) -> Model:
    """Landmarks and weights from texts of both classes; scores are not yet placed."""
    toxic, clean = ([w for w, l in zip(words, y, strict=True) if l == k] for k in (1, 0))
    landmarks = choose_landmarks(toxic, clean, landmarks_at_most) or ["none"]
    kernel = Kernel(landmarks)
    values = _pool(kernel, words)
    rng, bent = random.Random(0), []
    for t in toxic:  # variants with inserted characters
        hits = [w for w in t if any(w == l or l[-1] == "\x00" and w.startswith(l[:-1]) for l in landmarks)]
        new = Counter({w: n for w, n in t.items() if w not in hits})
        for w in hits:
            k = rng.randrange(1, max(2, min(len(w), 6)))
            new[w[:k] + rng.choice(["-", "*", "_", "1", "x"]) + w[k:]] += t[w]
        bent.append(new)
    gram = kernel.values(landmarks).astype(float)
    gram = (gram + gram.T) / 2 + 1e-3 * np.eye(len(gram))
    value, vector = np.linalg.eigh(gram)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    both = np.kron(np.eye(2), root)
    x = np.r_[values, _pool(kernel, bent)] @ both
    target = np.r_[np.where(y == 1, 1, -1), np.ones(len(bent))]
    n1, n0 = (target == 1).sum(), (target == -1).sum()
    w, bias = svm(x, target, np.where(target == 1, 1.0, 2.0 * n1 / n0))
    return Model(landmarks, both @ w, bias, SLOPE, 0.0)


def best_cut(margin: np.ndarray, y: np.ndarray) -> float:
    """The margin from which on a text counts as toxic: the middle of those with the best F1, clean texts being WEIGHT times as frequent as toxic ones.

    0 is the margin of a text without any similar word, which never counts as toxic, however little there was to learn from."""
    cuts = np.unique(np.r_[margin, 0.0])
    cuts = np.r_[(cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
    cuts = cuts[cuts > 0]
    rarity = WEIGHT * (y == 1).sum() / (y == 0).sum()
    over = lambda k: (y == k).sum() - np.searchsorted(np.sort(margin[y == k]), cuts, "right")
    hit, wrong = over(1), over(0)
    f1 = 2 * hit / np.maximum(hit + (y == 1).sum() + rarity * wrong, 1e-9)
    return float(np.median(cuts[f1 >= f1.max() - 1e-12]))


def train(texts: list[str], labels: list[int]) -> Model:
    """A model of all texts, its cut from the margins that each FOLDS-th of the texts has under a model of the others."""
    one: dict[str, str] = {}
    words, y = [Counter({one.setdefault(w, w): n for w, n in words_of(t).items()}) for t in texts], np.asarray(labels)
    if not (y == 1).any() or not (y == 0).any():
        return Model(["none"], np.zeros(2), 0.0, 1.0, 40.0)
    model = machine(words, y)
    fold = np.zeros(len(y), int)
    for k in (0, 1):
        fold[y == k] = np.arange((y == k).sum()) % FOLDS
    if min((y == 1).sum(), (y == 0).sum()) >= FOLDS:
        margin = np.zeros(len(y))
        for f in range(FOLDS):
            out = np.flatnonzero(fold == f)
            other = machine([w for w, k in zip(words, fold.tolist(), strict=True) if k != f], y[fold != f])
            margin[out] = other.margin(_pool(Kernel(other.landmarks), [words[i] for i in out.tolist()])) - other.bias
    else:
        margin = model.margin(_pool(Kernel(model.landmarks), words)) - model.bias
    model.middle = model.bias + best_cut(margin, y) - math.log(CUT / (1 - CUT)) / SLOPE
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from the labelled rows with crc32(doc_id) mod 3 other than 1; a bounded number of texts reaches the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1) and crc32(cast(doc_id as string)) % 3 <> 1")
    texts = documents_only(docs).where(F.length("text").between(1, LONGEST))
    key = F.xxhash64("doc_id")
    rows = []
    for kind in (0, 1):
        chosen = known.where(F.col("toxic") == kind).orderBy(key, "doc_id").limit(2 * per_class)
        got = texts.join(F.broadcast(chosen), "doc_id").orderBy(key, "doc_id", "text").limit(per_class)  # 2 * per_class ids at most
        rows += got.select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def scorer(model: Model):
    """A function from a list of texts to their scores, with a cache of bounded size."""
    kernel, known, dull = Kernel(model.landmarks), {}, set()

    def run(texts: list[str]) -> np.ndarray:
        nonlocal dull
        words = [words_of(t) for t in texts]
        new = list(set().union(*words).difference(known, dull)) if words else []
        if len(known) > 100_000:
            known.clear()
            new = list(set().union(*words).difference(dull))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            v = kernel.values(part)
            hit = v.any(1)
            known.update((part[k], v[k]) for k in np.flatnonzero(hit).tolist())
            dull.update(part[k] for k in np.flatnonzero(~hit).tolist())
        values = pooled(words, known, len(model.landmarks))
        if len(dull) > 400_000:
            dull = set()
        return model.score(values)

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = scorer(model)
        for pdf in batches:
            texts = pdf["text"].tolist()
            s = np.concatenate([of(texts[i : i + 256]) for i in range(0, len(texts), 256)] or [np.zeros(0)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "score": s})

    got = documents_only(docs).mapInPandas(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, unchanged and without a shuffle."""
    model = fit(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = scorer(model)
        for pdf in batches:
            texts = pdf["text"].astype(object).where(pdf["text"].notna(), "").tolist()
            s = np.concatenate([of(texts[i : i + 256]) for i in range(0, len(texts), 256)] or [np.zeros(0)])
            yield pdf[s < CUT]

    return docs.mapInPandas(run, docs.schema)
