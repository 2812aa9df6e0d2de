"""Operator 9: quality rules with tokenizer fertility.

Base rules count words, symbols, repeated lines and repeated three-word windows in every whole text. The method
then measures, with public vocabularies, characters per token and the entropy of the token distribution
(byte-level BPE), the share of tokens without a letter, digit or blank, and the share of bytes that only byte-fallback
tokens can spell (piece BPE), and rejects texts outside the band of their script. Bands are wide on purpose: prose of any kind lies well inside, while runs of
symbols, shouting, gibberish bytes and endless repetition don't.

Null text has no words, so it fails the base rules, as empty texts do. Repeated rows give repeated results; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import bpe
from tempora.llm.common import WORD, documents_only

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, fallback_share double, token_entropy double, symbol_share double, script string"
_PLAIN = re.compile(rb" ?[!-/:-@\[-`{-~]+")
_SYMBOLS, _BLANK = b"#*$%&|<>", " \t\n\r\x0b\f"


class Band(NamedTuple):
    """What texts of a script may have: characters per token from least to most, shares of fallback bytes and symbol tokens, bits of token entropy."""

    least: float
    most: float
    fallback: float
    symbols: float
    entropy: float


#: By script; texts of fewer than ENOUGH tokens are judged by the base rules alone.
BANDS = {"latin": Band(1.5, 8.0, 0.10, 0.15, 3.5), "cyrillic": Band(0.7, 8.0, 0.10, 0.15, 3.5), "greek": Band(0.5, 8.0, 0.20, 0.15, 3.5), "cjk": Band(0.25, 4.0, 0.90, 0.3, 3.0), "other": Band(0.2, 8.0, 0.95, 0.5, 3.0)}
ENOUGH = 50


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    raw = text.encode()
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen, repeat = Counter(windows), 0
    if len(seen) < len(windows):
        end = 0  # words before it are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return len(words), sum(map(len, words)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat


def script_of(text: str) -> str:
    """The script of most letters."""
    if not text or max(text) < "\u0250":
        return "latin" if any(map(str.isalpha, text)) else "other"
    n: Counter[str] = Counter()
    for ch, k in Counter(text).items():
        if ch.isalpha():
            name = "latin" if ch < "\u0250" else unicodedata.name(ch, "").split(" ")[0].lower()
            n["cjk" if name in ("cjk", "hiragana", "katakana", "hangul") else name if name in BANDS else "other"] += k
    return min(n, key=lambda s: (-n[s], s)) if n else "other"


class Pieces:
    """Which characters the piece vocabulary can only spell in byte tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model, self.known = sentencepiece.SentencePieceProcessor(model_file=path), {}

    def spelled(self, ch: str) -> bool:
        got = self.known.get(ch)
        if got is None:
            got = self.known[ch] = any(map(self.model.is_byte, self.model.encode(ch)))
        return got

    def share(self, text: str) -> float:
        """Of the text's bytes, those that become byte tokens."""
        odd = [ch for ch in set(text) if self.spelled(ch)]
        return sum(text.count(ch) * len(ch.encode()) for ch in odd) / len(text.encode()) if odd else 0.0


@functools.lru_cache(None)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def entropy(ids: np.ndarray) -> float:
    """Bits a token."""
    if not len(ids):
        return 0.0
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(p * np.log2(p)).sum())


def measure(bpe_path: str, piece_path: str, bands: dict[str, Band]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, vocabulary, ranks = bpe.library_coder(bpe_path), pieces(piece_path), bpe.load_ranks(bpe_path)
        plain = np.zeros(1 + max(ranks.values()), bool)
        plain[[i for t, i in ranks.items() if _PLAIN.fullmatch(t)]] = True
        for pdf in batches:
            rows = []
            for text in pdf["text"].tolist():
                counts = base_counts(text)
                n_words, *_, n_repeat = counts
                failed = n_words < 50 or 100 * n_repeat > 50 * n_words
                ids = np.frombuffer(coder.ids(text), "<u4")
                fallback, symbols = vocabulary.share(text), float(plain[ids].mean()) if len(ids) else 0.0
                per, bits, script = len(text) / len(ids) if len(ids) else 0.0, entropy(ids), script_of(text)
                b = bands[script]
                good = len(ids) < ENOUGH or b.least <= per <= b.most and fallback <= b.fallback and symbols <= b.symbols and bits >= b.entropy
                rows.append((*counts, failed, good and not failed, per, fallback, bits, symbols, script))
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "fallback_share", "token_entropy", "symbol_share", "script"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    return run


def judge(docs: DataFrame, bpe_path: str, piece_path: str, bands: dict[str, Band] = BANDS) -> DataFrame:
    return documents_only(docs).mapInPandas(measure(bpe_path, piece_path, bands), SCHEMA)


def keep_good(docs: DataFrame, bpe_path: str, piece_path: str, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows of docs whose text is kept, unchanged and without a shuffle."""
    run = measure(bpe_path, piece_path, bands)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = pdf["text"].astype(object).where(pdf["text"].notna(), "")
            (got,) = run(iter([pd.DataFrame({"doc_id": pdf["doc_id"], "text": text})]))
            yield pdf[got["kept"].to_numpy(bool)]

    return docs.mapInPandas(kept, docs.schema)
