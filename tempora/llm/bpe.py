"""Byte-level BPE shared by the encoding, packing and fertility operators.

``split`` cuts a text into the matches of public_tokenizers.PATTERN with array operations over code
points: the pattern's alternatives depend only on the class of neighbouring characters, so the token
starts come from one pass of comparisons. ``WordCoder`` keeps the ids of words it has seen, as
little-endian unsigned 32-bit bytes, in a cache of bounded size, and asks a coder for the others.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Callable
from struct import pack

import numpy as np

_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@functools.lru_cache(None)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[_SPACES] = _SPACE
    return out


def starts(text: str) -> np.ndarray:
    """Offsets (code points) at which the pattern's matches begin; they cover the text without gaps."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(c)
    if not n:
        return np.zeros(0, np.int64)
    k = _classes()[c]
    space = k == _SPACE
    b = np.ones(n, bool)
    same = k[1:] == k[:-1]
    after_blank = (c[:-1] == 32) & ~space[1:]
    b[1:] = ~same & ~after_blank
    # in a run of white space, the last character stands alone (or with what follows) if something follows
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    b |= last
    quotes = np.flatnonzero(c == 39)
    for i in quotes.tolist():
        if i and (k[i - 1] == _OTHER or c[i - 1] == 32):
            continue
        tail = text[i + 1 : i + 3]
        size = 2 if tail[:1] in ("s", "t") and tail else 3 if tail in ("re", "ve") else 2 if tail[:1] == "m" else 3 if tail == "ll" else 2 if tail[:1] == "d" else 0
        if size:
            b[i + 1 : i + size] = False
            if i + size < n and k[i + size] == _LETTER:
                b[i + size] = True
    return np.flatnonzero(b)


def split(text: str) -> list[str]:
    at = starts(text).tolist()
    return [text[i:j] for i, j in zip(at, [*at[1:], len(text)])]  # noqa: B905  an empty text has none


@functools.lru_cache(None)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class WordCoder:
    """Ids of whole texts, word by word; ``encode`` maps new words to lists of ids, in one call a text or block.

    The cache has two generations of ``room`` words at most: a word that comes again moves to the younger one."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], room: int = 300_000):
        self.encode, self.room, self.known, self.older = encode, room, {}, {}

    def ids(self, text: str) -> bytes:
        words = split(text)
        self.learn(words)
        return b"".join(map(self.known.__getitem__, words))

    def learn(self, words: list[str]) -> None:
        """Afterwards known has all of words."""
        new = set(words).difference(self.known)
        if not new:
            return
        if len(self.known) + len(new) > self.room:
            self.known, self.older = {}, self.known
            new = set(words)
        known, older = self.known, self.older
        if again := new & older.keys():
            for w in again:
                known[w] = older[w]
            new -= again
        rest = list(new)
        for w, ids in zip(rest, self.encode(rest), strict=True):
            known[w] = self.keep(ids)

    def keep(self, ids: list[int]):
        """What is known of a word."""
        return pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(None)
def library_coder(path: str) -> WordCoder:
    """One for each Python worker. New words go to tiktoken with the same ranks; on one match of the pattern it merges just as the json file's model does."""
    import public_tokenizers
    import tiktoken

    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    return WordCoder(lambda words: [coder.encode_ordinary(w) for w in words])
