"""Operator 3: byte-level BPE by corpus-level merge replay, and decoding.

A block of documents is one corpus. Its distinct words stand in one linked list of symbols; an inverted
index leads from each adjacent pair (named by the rank of what it merges to) to the positions where it
occurs. Merges are taken in rank order from a heap; each touches only its positions and the two
neighbours there, so a merge's cost is its number of occurrences. Words seen before come from a cache.

Results: null text counts as empty; an empty text has no ids, and both digests are those of no bytes.
Repeated rows give repeated results, extra columns are ignored, an empty table gives no rows. Very long
words are no special case: the replay is n log n in a word's length.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tempora.llm import bpe
from tempora.llm.common import documents_only

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Documents are replayed together in blocks of about so many characters.
BLOCK_CHARS = 2_000_000


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, as if each were merged alone, lowest rank first and leftmost first; a word that is a token needs no merge."""
        raw = [w.encode("utf-8") for w in words]
        whole = [self.ranks.get(x) for x in raw]
        merged = iter(self.replay([x for x, i in zip(raw, whole, strict=True) if i is None]))
        return [next(merged) if i is None else [i] for i in whole]

    def replay(self, raw: list[bytes]) -> list[list[int]]:
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64).tolist()
        byte, pairs, token, ranks = self.byte, self.pairs, self.token, self.ranks
        if len(pairs) > 2_000_000:
            pairs.clear()
        sym = [byte[x] for x in b"".join(raw)]
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        for e in ends:
            if e:
                right[e - 1] = -1
            if e < n:
                left[e] = -1
        index: dict[int, list[int]] = {}
        for p, (a, b, q) in enumerate(zip(sym, sym[1:], right, strict=False)):
            if q > 0:
                key = a << 20 | b
                r = pairs.get(key)
                if r is None:
                    r = pairs[key] = ranks.get(token[a] + token[b], -1)
                if r >= 0:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r, ())
            if len(at) > 1:
                at.sort()
            for i, p in enumerate(at):
                q = right[p]
                a = sym[p]
                if a < 0 or q < 0 or pairs[a << 20 | sym[q]] != r:
                    continue  # a neighbour has changed since this was noted
                sym[p], sym[q] = r, -1
                after = right[p] = right[q]
                before, lower = left[p], False
                if after >= 0:
                    left[after] = p
                    key = r << 20 | sym[after]
                    s = pairs.get(key)
                    if s is None:
                        s = pairs[key] = ranks.get(token[r] + token[sym[after]], -1)
                    if s >= 0:
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heapq.heappush(heap, s)
                        lower = s < r
                if before >= 0:
                    key = sym[before] << 20 | r
                    s = pairs.get(key)
                    if s is None:
                        s = pairs[key] = ranks.get(token[sym[before]] + token[r], -1)
                    if s >= 0:
                        if s in index:
                            index[s].append(before)
                        else:
                            index[s] = [before]
                            heapq.heappush(heap, s)
                        lower |= s < r
                if lower and i + 1 < len(at):  # what has come up goes before the rest of this rank
                    index[r] = index.get(r, []) + at[i + 1 :]
                    heapq.heappush(heap, r)
                    break
        out, begin = [], 0
        for e in ends:
            out.append([s for s in sym[begin:e] if s >= 0])
            begin = e
        return out


class Coder(bpe.WordCoder):
    """Knows, of each word, its number of ids, the ids in decimal, and the bytes that they decode to."""

    def __init__(self, path: str):
        self.merges = MergeReplay(bpe.load_ranks(path))
        super().__init__(self.merges.encode)

    def keep(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), " ".join(map(str, ids)), b"".join(map(self.merges.token.__getitem__, ids))


@functools.lru_cache(None)
def coder(path: str) -> Coder:
    """One for each Python worker, so that a task finds the words of those before it."""
    return Coder(path)


def encoder(path: str):
    """A mapInPandas function from doc_id, text to SCHEMA."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(path)
        for pdf in batches:
            texts, rows, i = pdf["text"].tolist(), [], 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars < BLOCK_CHARS):
                    chars += len(texts[j])
                    j += 1
                block = [bpe.split(t) for t in texts[i:j]]
                own.learn(set().union(*block))
                for words in block:
                    n, ids, raw = zip(*map(own.known.__getitem__, words), strict=True) if words else ((), (), ())
                    rows.append((sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()))
                i = j
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    return documents_only(docs).mapInPandas(encoder(path), SCHEMA)
