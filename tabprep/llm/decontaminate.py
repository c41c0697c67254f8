"""Benchmark decontamination with an FM-index over every shard of training text.

A shard is a run of documents as numbers of words. Its Burrows-Wheeler transform is kept in a wavelet tree; test phrases are
found by backward search, all at once, with ranks in the tree. Suffix positions are kept for every few text places; other
rows walk there by the last-to-first mapping. Found spans are merged per document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import blocks, map_batches, rewrite_texts

#: Bytes to themselves if they are part of words, A-Z to a-z, all others to a space.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")
WINDOW = 10
SHARD_CHARS = 3_000_000
SAMPLE = 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start places of the suffixes in order, by prefix doubling; only suffixes still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranks = np.empty(n, np.int64)
    sorted_text = text[order]
    starts = np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]])
    ranks[order] = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    step = 1
    while True:
        group = ranks[order]
        tied = np.zeros(n, bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        rows = np.flatnonzero(tied)
        if not len(rows):
            return order
        places = order[rows]
        after = places + step
        second = np.where(after < n, ranks[np.minimum(after, n - 1)], -1)
        resorted = np.argsort(group[rows] * (n + 1) + second + 1, kind="stable")
        places, first, second = places[resorted], group[rows][resorted], second[resorted]
        order[rows] = places
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        ranks[places] = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        step *= 2


class Wavelet:
    """A wavelet matrix: one level of bits per bit of the symbols, with the ones before every place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(places), places
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = ((symbols >> level) & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(bit, zeros + low_ones, low - low_ones)
            high = np.where(bit, zeros + high_ones, high - high_ones)
        return high - low

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbols = np.zeros_like(places)
        low, high = np.zeros_like(places), places
        for k in range(self.bits):
            ones, zeros = self.ones[k], self.zeros[k]
            bit = ones[high + 1] > ones[high]
            symbols = symbols * 2 + bit
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(bit, zeros + low_ones, low - low_ones)
            high = np.where(bit, zeros + high_ones, high - high_ones)
        return symbols, high - low


class FMIndex:
    """Index of a shard: an array of symbols from 1 on, where 1 stands for words that no phrase holds."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.concatenate([text, [0]])  # the end, smaller than all
        suffixes = suffix_array(text)
        self.transform = text[suffixes - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = Wavelet(self.transform, max(int(symbols - 1).bit_length(), 1))
        marked = suffixes % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.sampled = suffixes[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the phrases that occur and their ranges of rows. ``phrases`` is right-aligned, one per row."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.before[-1], np.int64)
        width = phrases.shape[1]
        for step in range(width):
            active = lengths[alive] > step
            if not active.any():
                break
            going = alive[active]
            symbol = phrases[going, width - 1 - step]
            new_low = self.before[symbol] + self.tree.rank(symbol, low[going])
            new_high = self.before[symbol] + self.tree.rank(symbol, high[going])
            low[going], high[going] = new_low, new_high
            alive = alive[high[alive] > low[alive]]
            if not len(alive):
                break
        return alive, low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of the suffixes in these rows."""
        places = np.zeros(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows.copy()
        while len(todo):
            marked = self.marks[at + 1] > self.marks[at]
            places[todo[marked]] = self.sampled[self.marks[at[marked]]] + steps[todo[marked]]
            todo, at = todo[~marked], at[~marked]
            symbol, rank = self.tree.at(at)
            at = self.before[symbol] + rank
            steps[todo] += 1
        return places


class Phrases:
    """Distinct windows of test items as rows of symbols, and which items each belongs to."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        place: dict[tuple[int, ...], int] = {}
        self.item_ids: list[int | None] = []
        pairs: set[tuple[int, int]] = set()
        for key, text in items:
            row = [self.symbols.setdefault(word, len(self.symbols) + 2) for word in words_of(text)]
            if not row:
                continue
            item = len(self.item_ids)
            self.item_ids.append(key)
            for i in range(max(len(row) - window, 0) + 1):
                pairs.add((place.setdefault(tuple(row[i : i + window]), len(place)), item))
        self.lengths = np.array([len(row) for row in place], np.int64)
        self.rows = np.zeros((len(place), window), np.int64)
        for row, i in place.items():
            self.rows[i, window - len(row) :] = row
        links = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.items = links[:, 1]
        self.offsets = np.searchsorted(links[:, 0], np.arange(len(place) + 1))
        self.count = len(self.symbols) + 2

    def matches(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hit marks of all words of a shard, document starts, and (document, item) pairs found in it."""
        sizes = np.array([len(words) for words in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # one more place after each document, never part of a phrase
        shard = np.ones(starts[-1], np.int64)
        get = self.symbols.get
        for words, start in zip(texts, starts):
            shard[start : start + len(words)] = list(map(get, words, repeat(1)))
        hits = np.zeros(len(shard) + 1, np.int64)
        empty = np.zeros(0, np.int64)
        if not len(self.lengths) or not (shard > 1).any():
            return hits[:-1] > 0, starts, empty, empty
        # a run of words that no phrase holds stays as one of them
        kept = np.flatnonzero((shard > 1) | np.concatenate([[True], shard[:-1] > 1]))
        index = FMIndex(shard[kept], self.count)
        found, low, high = index.search(self.rows, self.lengths)
        if not len(found):
            return hits[:-1] > 0, starts, empty, empty
        counts = high - low
        which = np.repeat(np.arange(len(found)), counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
        places = kept[index.locate(rows)]
        np.add.at(hits, places, 1)
        np.add.at(hits, places + self.lengths[found[which]], -1)
        document = np.searchsorted(starts, places, side="right") - 1
        # a phrase that occurs often in one document counts once before its items are looked up
        pair = np.unique(document * len(self.lengths) + found[which])
        document, phrase = pair // len(self.lengths), pair % len(self.lengths)
        fan = self.offsets[phrase + 1] - self.offsets[phrase]
        base = np.repeat(self.offsets[phrase] - (np.cumsum(fan) - fan), fan)
        items = self.items[base + np.arange(fan.sum())]
        return np.cumsum(hits[:-1]) > 0, starts, np.repeat(document, fan), items


def phrase_blocks(benchmark: DataFrame, max_bytes: int = 8_000_000) -> Iterator[list[tuple[int | None, str | None]]]:
    """Test items in blocks of at most about ``max_bytes`` of text, which is what one broadcast holds."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= max_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def spans_of(hits: np.ndarray) -> list[int]:
    """Merged runs of hit words as start, end, start, end, ..."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hits, [False]]).astype(np.int8)))
    return edges.tolist()


def _digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.size("spans") / 2 - 1, F.lit(0)).cast("int")), F.lit(0).cast("long"),
        lambda total, i: total + F.coalesce(F.get("spans", 2 * i + 1) - F.get("spans", 2 * i), F.lit(0)),
    )
    names = F.array_sort(F.transform(F.array_distinct("items"), lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def find_all_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, extra: bool = False) -> DataFrame:
    """Like ``find_spans`` for all items: one task holds its shard's words while the blocks of phrases go through it."""
    shares = [docs.sparkSession.sparkContext.broadcast(Phrases(block, window)) for block in phrase_blocks(benchmark)]
    fields = [("doc_id", "long"), ("n_words", "long"), ("spans", "array<long>"), ("items", "array<long>")]
    fields += [("text", "string")] if extra else []

    def run(batches):
        for ids, texts in blocks(batches, SHARD_CHARS):
            words = [words_of(text) for text in texts]
            sizes = [len(w) for w in words]
            found: list[set] = [set() for _ in ids]
            touched: set[int] = set()
            hits = starts = None
            for share in shares:
                phrases = share.value
                own, starts, documents, items = phrases.matches(words)
                hits = own if hits is None else hits | own
                touched.update(documents.tolist())
                for d, item in zip(documents.tolist(), items.tolist()):
                    found[d].add(phrases.item_ids[item])
            yield {
                "doc_id": ids, "n_words": sizes, "text": texts,
                "spans": [spans_of(hits[starts[i] : starts[i] + n]) if i in touched else [] for i, n in enumerate(sizes)],
                "items": [[x for x in row if x is not None] for row in found],
            }

    return map_batches(docs.select("doc_id", "text"), fields, run)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``.

    Null and empty texts have no words and no hits; items without a word have no window; an item without an id marks
    hits but is not listed. Repeated rows each give a row; other columns are ignored. Test items are broadcast
    in blocks of bounded size, and spans are merged over all blocks. No shuffle.
    """
    return _digest(find_all_spans(docs, benchmark, window))


def remove_spans(text: str, spans: list[int]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    raw = text.encode()
    places = [(m.start(), m.end()) for m in WORD.finditer(raw.translate(TABLE))]
    out, at = [], 0
    for start, end in zip(spans[::2], spans[1::2]):
        out.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode()


def cut_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all columns, without the words of occurrences of test windows; rows of which no word is left go.

    Rows without a word before stay. No shuffle.
    """
    shares = [docs.sparkSession.sparkContext.broadcast(Phrases(block, window)) for block in phrase_blocks(benchmark)]

    def change(texts):
        new, kept = list(texts), [True] * len(texts)
        for start, end in block_bounds(texts):
            words = [words_of(text) for text in texts[start:end]]
            hits, starts = np.zeros(sum(map(len, words)) + len(words), bool), None
            touched: set[int] = set()
            for share in shares:
                own, starts, documents, _ = share.value.matches(words)
                hits |= own
                touched.update(documents.tolist())
            for d in touched:
                own = hits[starts[d] : starts[d] + len(words[d])]
                new[start + d] = remove_spans(new[start + d], spans_of(own))
                kept[start + d] = not own.all()
        return kept, new

    return rewrite_texts(docs, docs.schema, change)


def block_bounds(texts: list[str | None], size: int = SHARD_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``size`` characters."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
