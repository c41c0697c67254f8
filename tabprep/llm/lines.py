"""Line de-duplication with overlapping windows of three lines.

The hashes of every three consecutive lines are compared over all documents; all occurrences but the first are
removed by merging the positions they cover. Lines are physical lines, the sentences that they wrap to, and short pieces whose
bounds follow from the words around them alone, so that a repeated passage shares whole pieces wherever it starts and ends.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabprep.llm.common import SPACES, STEP, blocks, map_batches, mix, rewrite_texts, span_hashes
from tabprep.workspace import pin

SPAN = 3
#: Of every so many words in a row one begins a piece. Which one follows from these words and the one before, so two copies of
#: a passage agree on bounds REACH words from its ends. Passages of more than 50 words hold at least one whole window:
#: 51 words have 51 - 2 * REACH + 1 such places, and the first bound and a window from there take REACH + SPAN * REACH of them.
REACH = 8
#: Characters that are a word each, as their scripts are written without spaces.
UNSPACED = [
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0xA4CF),
    (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF),
    (0x20000, 0x3FFFF),
]
_kinds = np.zeros(0x110000, np.uint8)
for _low, _high in UNSPACED:
    _kinds[_low : _high + 1] = 1
for _code in range(0x300, 0x20000):
    if unicodedata.category(chr(_code))[0] == "M":
        _kinds[_code] = 2  # belongs to the character before
_kinds[list(SPACES)] = 3
_BREAK = ord("\n")
_SECOND = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Pieces:
    """Words and pieces of several texts, numbered through. ``owner``: text of a piece; ``first``: its first word, and the end of all."""

    word_hash: np.ndarray
    last: np.ndarray  # index behind every word in its text
    first: np.ndarray
    owner: np.ndarray
    lines: np.ndarray  # first words, of physical lines
    sentences: np.ndarray  # and of sentences or lines
    content: np.ndarray  # and of texts and where the words around say so
    ends: np.ndarray  # number of words up to the end of each text


def pieces_of(texts: list[str | None]) -> Pieces:
    """A piece begins where a line, a sentence within a line, or a content-defined stretch of at most ``REACH`` words does."""
    raw = ("\n".join(text or "" for text in texts) + "\n").encode("utf-32-le", "surrogatepass")
    chars = np.frombuffer(raw, np.uint32)
    bounds = np.cumsum([len(text or "") + 1 for text in texts])
    kind = _kinds[chars]
    space = kind == 3
    before = np.concatenate([[True], space[:-1]])
    start = ~space & before
    if ((kind == 1) | (kind == 2)).any():
        base = np.maximum.accumulate(np.where(kind == 2, 0, np.arange(len(chars))))
        alone = kind[base] == 1
        start |= (kind == 1) | (~space & (kind != 2) & np.concatenate([[False], alone[:-1]]))
    begins = np.flatnonzero(start)
    after = np.concatenate([space[1:], [True]]) | np.concatenate([start[1:], [True]])
    closes = np.flatnonzero(~space & after) + 1
    word_hash = span_hashes(chars.astype(np.uint64) + np.uint64(1), begins, closes)
    n, of = len(begins), np.searchsorted(bounds, begins, "right")
    ends = np.searchsorted(begins, bounds)

    opens = np.ones(n, bool)  # the first word of a text
    opens[1:] = of[1:] != of[:-1]
    breaks = np.concatenate([[0], np.cumsum(chars == _BREAK)])
    plain = np.concatenate([[0], np.cumsum(space & (chars != 32))])
    line, sentence = opens.copy(), opens.copy()
    if n:
        line[1:] |= breaks[begins[1:]] > breaks[closes[:-1]]
        gap = (begins[1:] > closes[:-1]) & (plain[begins[1:]] == plain[closes[:-1]])
        sentence[1:] |= line[1:] | (gap & np.isin(chars[closes[:-1] - 1], [ord(c) for c in ".!?"]))
    content = opens.copy()
    if n > REACH:
        around = mix(np.concatenate([[np.uint64(0)], word_hash[:-1]]) * STEP + word_hash)
        lowest = np.lib.stride_tricks.sliding_window_view(around, REACH).argmin(axis=1)
        places = np.arange(n - REACH + 1)
        inside = ~opens[places] & (of[places] == of[places + REACH - 1])
        content[(places + lowest)[inside]] = True
    first = np.flatnonzero(line | sentence | content)
    return Pieces(
        word_hash, closes - (bounds - [len(text or "") + 1 for text in texts])[of], np.append(first, n), of[first],
        np.flatnonzero(line), np.flatnonzero(sentence), np.flatnonzero(content), ends,
    )


def windows(texts: list[str | None], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A hash and check bits, text, first piece and number of pieces of every window, by text and first piece.

    Windows are three physical lines that hold a word; three sentences or lines of ``min_words`` words or more; and at least three
    content-defined pieces, or as many as it takes to ``min_words``. The words of a window count, not the spaces between.
    """
    found = pieces_of(texts)
    n = len(found.word_hash)
    starts, stops = [], []

    def add(bounds: np.ndarray, least: int, lengthen: bool) -> None:
        bounds = np.append(bounds, n)
        k = np.arange(len(bounds) - 1)
        stop = k + SPAN
        if lengthen:
            stop = np.maximum(stop, np.searchsorted(bounds, bounds[:-1] + least))
        whole = stop < len(bounds)
        begin, end = bounds[k[whole]], bounds[stop[whole]]
        text = np.searchsorted(found.ends, begin, "right")
        good = (end <= found.ends[text]) & (end - begin >= least)
        starts.append(begin[good])
        stops.append(end[good])

    add(found.lines, 0, False)
    add(found.sentences, min_words, False)
    add(found.content, min_words, True)
    both = np.unique(np.concatenate(starts) * (n + 1) + np.concatenate(stops)) if n else np.zeros(0, np.int64)
    start, stop = both // (n + 1), both % (n + 1)
    values = mix(found.word_hash)
    whole = span_hashes(values, start, stop)
    check = span_hashes(values, start, stop, _SECOND) >> np.uint64(64 - CHECK_BITS)
    piece = np.searchsorted(found.first, start)
    text = np.searchsorted(found.ends, start, "right")
    origin = np.searchsorted(found.owner, np.arange(len(texts)))
    return (
        whole.view(np.int64), check.astype(np.int64), text, piece - origin[text], np.searchsorted(found.first, stop) - piece,
    )


#: Bytes of the texts whose windows are made at once, and windows that a task holds before it sends the first of each.
TOGETHER = 500_000
HELD = 500_000
#: Bits beside the 64 of the hash by which windows are told apart.
CHECK_BITS = 16


def row_key() -> list[Column]:
    """Two numbers that name a row, ``__id, __tag``: its id and 31 bits of a hash of id and text, or 64 bits of that hash where there is no id.

    Rows equal in both are one row to this operator and are cut alike. The tag's last bit says that there is no id.
    """
    whole = F.xxhash64("doc_id", "text")
    tag = F.shiftleft(whole.bitwiseAND((1 << 31) - 1), 1) + F.col("doc_id").isNull().cast("long")
    return [F.coalesce(F.col("doc_id").cast("long"), whole).alias("__id"), tag.alias("__tag")]


class Held:
    """Windows of one task. Of equal ones only the first is sent on; the places of the others are known to be later ones."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, ids: list[int], tags: list[int], found: tuple[np.ndarray, ...]) -> None:
        whole, check, text, start, size = found
        ids, tags = np.array(ids, np.int64), np.array(tags, np.int64)
        self.parts.append((whole, check, ids[text], tags[text], start, size))
        self.size += len(whole)

    def take(self) -> dict[str, np.ndarray]:
        """Columns of the rows to send: first windows, and merged stretches of later ones by document
        (``mark`` below 0)."""
        whole, check, ids, tags, start, size = (np.concatenate(columns) for columns in zip(*self.parts))
        self.parts, self.size = [], 0
        document = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]))
        place = np.lexsort((tags[document], ids[document], tags[document] & 1))  # documents in their order
        if (np.diff(place) < 0).any():
            sizes = np.diff(np.append(document, len(ids)))[place]
            order = np.repeat(document[place] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))
            whole, check, ids, tags, start, size = (column[order] for column in (whole, check, ids, tags, start, size))
        order = np.argsort(whole, kind="stable")
        opens = np.ones(len(order), bool)
        opens[1:] = (whole[order[1:]] != whole[order[:-1]]) | (check[order[1:]] != check[order[:-1]])
        first = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
        same = (ids[order] == ids[first]) & (tags[order] == tags[first]) & (start[order] == start[first])
        later = np.sort(order[~same])  # copies of a whole row stand at the same place and take nothing from each other
        lead = np.sort(order[opens])  # by document: neighbouring rows then differ little but for the hash
        group = np.cumsum(np.concatenate([[0], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]))[later]
        ends = np.maximum.accumulate((group << 32) + start[later] + size[later]) if len(later) else later
        breaks = np.ones(len(later), bool)
        breaks[1:] = (group[1:] << 32) + start[later[1:]] > ends[:-1]
        begin = np.flatnonzero(breaks)
        stop = ends[np.append(begin[1:], len(later)) - 1] - (group[begin] << 32) if len(later) else ends
        at = later[begin]
        return {
            "hash": np.concatenate([whole[lead], mix(ids[at].view(np.uint64)).view(np.int64)]),
            "mark": np.concatenate([tags[lead] << CHECK_BITS | check[lead], -1 - tags[at]]),
            "id": np.concatenate([ids[lead], ids[at]]),
            "span": np.concatenate([start[lead] << 32 | size[lead], start[at] << 32 | (stop - start[at])]),
        }


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """``__id, __tag, __covered`` of every row with later occurrences of repeated windows: spans of start << 32 | size, in pieces.

    The first occurrence is that of the smallest document id (rows without one last), then the smallest tag, then the
    first position. Every task sends one row of a window however often it met it, so a window that a third of all documents
    share reaches no more rows than there are tasks; the places of its other occurrences are merged and sent by document.
    """
    fields = [("hash", "long"), ("mark", "long"), ("id", "long"), ("span", "long")]

    def run(batches):
        held = Held()
        for ids, tags, texts in blocks(batches, TOGETHER):
            held.add(ids, tags, windows(texts, min_words))
            if held.size >= HELD:
                yield held.take()
        if held.size:
            yield held.take()

    found = map_batches(docs.select(*row_key(), "text"), fields, run)
    tag = F.when(F.col("mark") < 0, -1 - F.col("mark")).otherwise(F.shiftright("mark", CHECK_BITS))
    check = F.when(F.col("mark") >= 0, F.col("mark").bitwiseAND((1 << CHECK_BITS) - 1)).otherwise(-1)
    place = [tag.bitwiseAND(1), "id", tag, F.shiftright("span", 32)]
    sent = found.repartition("hash")  # by the hash alone: other columns are taken apart behind the shuffle
    ranked = sent.withColumn("rank", F.rank().over(W.partitionBy("hash", check).orderBy(*place)))
    later = ranked.where("mark < 0 OR rank > 1")
    return later.groupBy(F.col("id").alias("__id"), tag.alias("__tag")).agg(F.collect_list("span").alias("__covered"))


def cut(texts: list[str | None], covered: list[list[int] | None]) -> list[tuple[str | None, int, int]]:
    """For every text: without the covered pieces, the number of its pieces, and of those removed.

    A piece includes the spaces before it. A text without words is one piece.
    """
    found = pieces_of(texts)
    origin = np.searchsorted(found.owner, np.arange(len(texts) + 1))
    out = []
    for k, (text, spans) in enumerate(zip(texts, covered)):
        n = int(origin[k + 1] - origin[k])
        if not spans or not n:
            out.append((text, 0 if text is None else max(n, 1), 0))
            continue
        steps = np.zeros(n + 1, np.int64)
        for span in spans:
            steps[span >> 32] += 1
            steps[(span >> 32) + (span & 0xFFFFFFFF)] -= 1
        gone = np.cumsum(steps[:-1]) > 0
        stops = [0, *found.last[found.first[origin[k] + 1 : origin[k + 1] + 1] - 1].tolist()]
        stops[-1] = len(text)
        kept = "".join(text[a:b] for a, b, g in zip(stops, stops[1:], gone) if not g)
        out.append((kept.strip(SPACES.decode()) if gone[0] or gone[-1] else kept, n, int(gone.sum())))
    return out


def with_cuts(docs: DataFrame, min_words: int) -> tuple[DataFrame, str]:
    """``docs`` with the windows to remove in one more column, and the name of that column, in one join by the key of a row.

    The spans are written first: the join is then one of plain tables, whose hot keys adaptive execution splits.
    """
    free = "_"
    while any(name.startswith(f"{free}_") for name in docs.columns):
        free += "_"
    keys = [column.alias(f"{free}{name}") for column, name in zip(row_key(), ("_id", "_tag"))]
    cuts = pin(repeated_windows(docs, min_words), "line-cuts").toDF(f"{free}_id", f"{free}_tag", f"{free}_covered")
    joined = docs.select("*", *keys).join(cuts, [f"{free}_id", f"{free}_tag"], "left")
    return joined.select(*docs.columns, f"{free}_covered"), f"{free}_covered"


def cut_documents(docs: DataFrame, min_words: int = 12) -> DataFrame:
    """``docs``, all columns, with shortened texts as in ``deduplicate_lines``; rows of which no word is left go.

    Rows without a word before stay.
    """

    def change(covered, texts):
        some = [i for i, spans in enumerate(covered) if spans]
        new = list(texts)
        for i, (text, _, _) in zip(some, cut([texts[i] for i in some], [covered[i] for i in some])):
            new[i] = text
        return [a == b or bool(a.strip()) for a, b in zip(new, texts)], new

    joined, covered = with_cuts(docs, min_words)
    return rewrite_texts(joined, docs.schema, change, covered, size=TOGETHER)


def deduplicate_lines(docs: DataFrame, min_words: int = 12) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` of every row of ``docs``; lines are pieces as in ``pieces_of``.

    Later occurrences of repeated windows of three lines, sentences or pieces are removed, within a document too; a single repeated
    line stays. Of a passage of over 50 words that stands in an earlier text too, no such run stays.
    Null texts stay null with 0 lines; texts without words have one line; empty texts and texts of fewer than three pieces are never changed. Rows equal in id
    and text count as one row and are cut alike. Other columns are ignored. Documents meet their cuts in one join by a hash of the row.
    """
    joined, covered = with_cuts(docs.select("doc_id", "text"), min_words)
    joined = joined.select("doc_id", covered, "text")
    fields = [("doc_id", "long"), ("n_lines", "long"), ("n_removed", "long"), ("text", "string")]

    def run(batches):
        for ids, spans, texts in blocks(batches, TOGETHER):
            rows = [(key, n, gone, text) for key, (text, n, gone) in zip(ids, cut(texts, spans))]
            yield {name: column for (name, _), column in zip(fields, zip(*rows))}

    return map_batches(joined, fields, run)
