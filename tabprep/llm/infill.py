"""Fill-in-the-middle transformation by secondary sort.

Every text is cut into pieces of at most CHUNK code points, keyed by document and position in the output. One
``repartitionAndSortWithinPartitions`` brings the pieces of a document together in output order, and they stream into a digest;
no text is ever held whole. For restoration the pieces of the output are keyed by their place in the original and sorted
again: the partitioning is the same, so this sort moves nothing between tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import find_package

#: Code points of a piece.
CHUNK = 4_096
#: Bytes of text that a partition of the sort gets on average.
SORTED_BYTES = 16 << 20
# The marks, and where each part goes in either form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
ORIGINAL = (PREFIX, MIDDLE, SUFFIX)
_MARKS = {mark.encode(): ORIGINAL.index(mark) for mark in ORIGINAL}


class Whole:
    """Takes pieces like a digest does, and gives them back as one text."""

    def __init__(self):
        self.pieces: list[bytes] = []

    def update(self, piece: bytes) -> None:
        self.pieces.append(piece)

    def hexdigest(self) -> str:
        return b"".join(self.pieces).decode("utf-8", "surrogatepass")


def plan(doc_id: int | None, text: str) -> tuple[str, int, int]:
    """Form and the two cuts of a text, from a hash of the id (of the empty id where there is none)."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(mark in text for mark in ORIGINAL) or h3 % 100 >= 90:
        return "plain", 0, 0
    cuts = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    return ("spm" if h4 % 100 < 20 else "psm"), cuts[0], cuts[1]


def transform(text: str, form: str, first: int, second: int) -> Iterator[str]:
    """The output in pieces: marks, and chunks of the parts."""
    parts = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, len(text))}
    for mark in FORMS.get(form, (None,)):
        if mark:
            yield mark
        low, high = parts[mark] if mark else (0, len(text))
        for at in range(low, high, CHUNK):
            yield text[at : min(at + CHUNK, high)]


def emit(split: int, rows) -> Iterator[tuple[tuple, object]]:
    """Pieces of the rows of a partition, by (document, output position); position -1 tells about the document.

    A document's key is a digest of id and text with the number of the partition. Rows equal in both meet under one key; those of
    one partition are counted there, so a third of all rows may be copies and still be spread like the input.
    """
    for doc_id, text in rows:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        name = hashlib.blake2b(raw, digest_size=16, key=f"{doc_id}".encode(), salt=split.to_bytes(8, "big")).digest()
        form, first, second = plan(doc_id, text)
        yield (name, -1), (doc_id, len(text), form, first, second - first)
        for place, piece in enumerate(transform(text, form, first, second)):
            yield (name, place), piece.encode("utf-8", "surrogatepass")


def read_outputs(pieces, sink: Callable) -> Iterator[tuple[tuple, object]]:
    """From pieces in output order to pieces keyed by (document, part, position), part -1 being facts and what ``sink`` made of the output.

    Parts are told by the marks found in the output alone; the marks themselves do not go on.
    """
    name = about = made = None
    copies, part, last = 0, 0, -1
    for (key, place), piece in pieces:
        if key != name:
            if name is not None:
                yield (name, -1, 0), (about, copies, made.hexdigest())
            name, about, made, copies, part, last = key, piece, sink(), 0, 0, -1
        if place < 0:
            copies += 1
        elif place > last:  # copies of a piece lie side by side
            last = place
            made.update(piece)
            if about[2] != "plain" and piece in _MARKS:
                part = _MARKS[piece]
            else:
                yield (name, part, place), piece
    if name is not None:
        yield (name, -1, 0), (about, copies, made.hexdigest())


def read_originals(pieces, sink: Callable) -> Iterator[tuple]:
    """One row for every document and copy from pieces in the order of the original."""
    name = facts = made = None

    def rows():
        (doc_id, n, form, prefix, middle), copies, output = facts
        cuts = (None, None) if form == "plain" else (prefix, middle)
        for _ in range(copies):
            yield doc_id, n, form, *cuts, output, made.hexdigest()

    for (key, part, _), piece in pieces:
        if key != name:
            if name is not None:
                yield from rows()
            name, facts, made = key, piece, sink()
        if part >= 0:
            made.update(piece)
    if name is not None:
        yield from rows()


def document_of(key: tuple) -> int:
    """Number that deals documents over partitions: leading bytes of the digest, which are the same in every worker."""
    return int.from_bytes(key[0][:7], "big")


def fill_in_middle(docs: DataFrame, texts: bool = False) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every row of ``docs``.

    With ``texts`` the last two are the texts ``output, restored`` themselves. Form and cuts follow from a hash of the id. Null texts
    count as empty; empty texts and texts that hold a mark stay plain, with null counts. A row without an id is cut by the hash of
    the empty id; repeated rows each give a row; other columns are ignored. A document key is made from contents and input
    partition, so a task that is run again gives the same pieces. The size of all texts decides in how many partitions they are sorted.
    """
    sink = Whole if texts else hashlib.sha256
    names = ("output", "restored") if texts else ("output_sha256", "restored_sha256")
    find_package(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SORTED_BYTES))
    pieces = rows.rdd.mapPartitionsWithIndex(emit).repartitionAndSortWithinPartitions(tasks, document_of)
    output = pieces.mapPartitions(lambda some: read_outputs(some, sink), preservesPartitioning=True)
    restored = output.repartitionAndSortWithinPartitions(tasks, document_of).mapPartitions(lambda some: read_originals(some, sink))
    schema = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {names[0]} string, {names[1]} string"
    return docs.sparkSession.createDataFrame(restored, schema, verifySchema=False)
