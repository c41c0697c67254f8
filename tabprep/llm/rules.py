"""Quality rules: repetition coverage.

Rolling hashes of word n-grams of several lengths find the n-grams that occur again within a document; the
share of its characters inside such repeats, and inside repeated lines, decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tabprep.llm.common import SPACES, blocks, map_batches, mix

SYMBOLS = b"#*$%&|<>"

#: Largest share of characters inside later occurrences of n-grams of each length (fixed values, as published for
#: web-text filtering), and inside lines equal to an earlier one.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20

FIELDS = [
    ("doc_id", "long"), ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
    ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("dup_line_share", "double"),
    ("dup_ngram_shares", "array<double>"),
]


def _covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``length`` words that begins at one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def _triples(ids: np.ndarray, distinct: int) -> np.ndarray:
    """A number for each three-word window, equal exactly for equal windows."""
    pair = ids[:-2] * distinct + ids[1:-1]
    if distinct >= 1 << 21:
        _, pair = np.unique(pair, return_inverse=True)
    return pair * distinct + ids[2:]


def repetition(text: str | None) -> tuple:
    """The counts of one document and its shares of repeated characters."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip(SPACES):
            if line in seen:
                dup_lines += 1
                dup_chars += len(line.translate(None, SPACES).decode())
            seen.add(line)
    places: dict[bytes, int] = {}
    ids = np.fromiter((places.setdefault(word, len(places)) for word in words), np.int64, n)
    repeat_words, shares = 0, []
    if n >= 3:
        keys = _triples(ids, len(places))
        ordered = np.sort(keys)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if twice.size:
            repeat_words = int(_covered(np.flatnonzero(np.isin(keys, twice)), 3, n).sum())
    chars = np.fromiter((len(word.decode()) for word in places), np.int64, len(places))[ids] if n else ids
    value = mix(ids + 1)
    rolling, width = value, 1
    for length in sorted(NGRAM_LIMITS):
        while width < length and rolling.size > 1:
            rolling = rolling[:-1] * np.uint64(0x9E3779B97F4A7C15) + value[width:]
            width += 1
        share = 0.0
        if width == length and rolling.size > 1:
            ordered = np.sort(rolling)
            if (ordered[1:] == ordered[:-1]).any():
                _, first = np.unique(rolling, return_index=True)
                later = np.ones(rolling.size, bool)
                later[first] = False
                share = float(chars[_covered(np.flatnonzero(later), length, n)].sum() / max(word_chars, 1))
        shares.append(share)
    return n, word_chars, symbols, dup_lines, repeat_words, dup_chars / max(word_chars, 1), shares


def repetition_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Counts, base verdict and verdict of every row of ``docs``, from whole texts.

    ``dup_ngram_shares`` holds a share for each length of ``NGRAM_LIMITS``. ``kept`` is false if the base rules fail
    or a share is over its limit. Null and empty texts have no words: all counts 0, base rules failed, not kept.
    Repeated rows and ids each give their own row; a null id stays null; other columns are ignored. No shuffle.
    """
    limits = [NGRAM_LIMITS[n] for n in sorted(NGRAM_LIMITS)]

    def run(batches):
        for ids, texts in blocks(batches):
            rows = []
            for key, text in zip(ids, texts):
                n, chars, symbols, dup_lines, repeat, line_share, shares = repetition(text)
                failed = n < min_words or 100 * repeat > max_repeat_percent * n
                kept = not failed and line_share <= LINE_LIMIT and all(s <= m for s, m in zip(shares, limits))
                rows.append((key, n, chars, symbols, dup_lines, repeat, failed, kept, line_share, shares))
            yield {name: column for (name, _), column in zip(FIELDS, zip(*rows))}

    return map_batches(docs.select("doc_id", "text"), FIELDS, run)
