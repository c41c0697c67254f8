"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: two blocks of 23 bits of a fingerprint are each covered by the perfect binary Golay
code, every block lying within RADIUS bits of exactly one code word. A fingerprint is replicated to every anchor within the
covering radius plus the threshold, which the two blocks share. If two fingerprints differ in at most THRESHOLD bits, the
anchor nearest to one has the other among its replicas, so comparing what is at home with all replicas, anchor by anchor, finds
every link.
"""

from __future__ import annotations

from functools import cache
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import blocks, components, map_batches
from tabprep.workspace import discard, pin

THRESHOLD = 2
SEED = 42
# Length, check bits, covering radius and generator polynomial of the perfect binary Golay code.
LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b1010_1110_0011
#: Bits of an anchor: the message bits of both blocks.
ANCHOR_BITS = 2 * (LENGTH - CHECKS)
#: Fingerprints at home at an anchor that one task compares with its replicas; more are dealt over parts.
HOMES = 2_000
#: Fingerprints that one task replicates.
PRINTS = 1 << 15
#: Pairs compared at once, and fingerprints replicated at once.
PAIRS, TOGETHER = 1 << 20, 1 << 13
_ROWS = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, each set if over half the shingle hashes have it; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, total, _ROWS):
        cuts = zip(starts[at : min(at + _ROWS, total)].tolist(), ends[at + size - 1 : at + size - 1 + _ROWS].tolist())
        digests = b"".join(map(xxhash.xxh64_digest, (joined[a:b] for a, b in cuts), repeat(SEED)))
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def syndrome(values: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator polynomial."""
    rest = values.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECKS)), rest)
    return rest


@cache
def covering() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error to the nearest code word; and code words to add to that one, in rows of equal excess distance.

    ``words[first[s, e] : first[s, e] + count[s, e]]`` lead from the nearest code word of a block with syndrome ``s`` to all
    that are RADIUS + e bits from the block (RADIUS or fewer for e = 0).
    """
    code = np.zeros(1, np.int64)
    for shift in range(LENGTH - CHECKS):
        code = np.concatenate([code, code ^ (GENERATOR << shift)])
    errors = np.zeros(1, np.int64)
    for _ in range(RADIUS):
        errors = np.unique(errors[:, None] ^ np.concatenate([[0], 1 << np.arange(LENGTH)]))
    leader = np.zeros(1 << CHECKS, np.int64)
    leader[syndrome(errors)] = errors
    words, first, count = [], np.zeros((len(leader), THRESHOLD + 1), np.int64), np.zeros((len(leader), THRESHOLD + 1), np.int64)
    done = 0
    for s, error in enumerate(leader.tolist()):
        excess = np.maximum(np.bitwise_count(code ^ error).astype(np.int64) - RADIUS, 0)
        for e in range(THRESHOLD + 1):
            found = code[excess == e]
            first[s, e], count[s, e] = done, len(found)
            done += len(found)
            words.append(found)
    return leader, np.concatenate(words), first, count


def home_anchors(prints: np.ndarray) -> np.ndarray:
    """The anchor nearest to every fingerprint."""
    leader = covering()[0]
    block = [(prints >> np.uint64(shift) & np.uint64((1 << LENGTH) - 1)).astype(np.int64) for shift in (0, LENGTH)]
    near = [values ^ leader[syndrome(values)] for values in block]
    return (near[0] >> CHECKS) << (LENGTH - CHECKS) | near[1] >> CHECKS


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, index into ``prints``, and whether it is not the home anchor, of every replica."""
    leader, words, first, count = covering()
    block = [(prints >> np.uint64(shift) & np.uint64((1 << LENGTH) - 1)).astype(np.int64) for shift in (0, LENGTH)]
    rest = [syndrome(values) for values in block]
    near = [values ^ leader[s] for values, s in zip(block, rest)]
    found, owner, away = [], [], []
    for e in range(THRESHOLD + 1):
        for f in range(THRESHOLD + 1 - e):
            wide = count[rest[1], f]
            copies = count[rest[0], e] * wide
            row = np.repeat(np.arange(len(prints)), copies)
            place = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            a = near[0][row] ^ words[first[rest[0], e][row] + place // np.maximum(wide[row], 1)]
            b = near[1][row] ^ words[first[rest[1], f][row] + place % np.maximum(wide[row], 1)]
            found.append((a >> CHECKS) << (LENGTH - CHECKS) | b >> CHECKS)
            owner.append(row)
            away.append(np.full(len(row), e + f > 0))
    return np.concatenate(found), np.concatenate(owner), np.concatenate(away)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the links ``a, b``, one per linked value: to the smallest of its component."""
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for ends in (x, y):
            np.minimum.at(new, ends, low)
            np.minimum.at(new, label[ends], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(values)))
    return values[other], values[label[other]]


def compare(batches):
    """Links within rows of ``key, print`` sorted by key: anchor and part, fingerprints at home before replicas."""
    group, homes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        of, home = keys >> 1, (keys & 1) == 0
        group, homes = np.concatenate([group, of[home]]), np.concatenate([homes, prints[home]])
        low, high = np.searchsorted(group, of, "left"), np.searchsorted(group, of, "right")
        done = np.concatenate([[0], np.cumsum(high - low)])
        at = 0
        while at < len(of):
            stop = max(int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1, at + 1)
            many = (high - low)[at:stop]
            row = np.repeat(np.arange(at, stop), many)
            place = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            a, b = prints[row], homes[place]
            close = (a != b) & (np.bitwise_count(a ^ b) <= THRESHOLD)
            if close.any():
                x, y = forest(a[close], b[close])
                yield {"a": x.view(np.int64), "b": y.view(np.int64)}
            at = stop
        if len(of):
            same = group == of[-1]
            group, homes = group[same], homes[same]


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints ``print`` which differ in at most THRESHOLD bits.

    Fingerprints meet by anchor in one shuffle; a task reads them in the order of the anchors and holds those at home at one
    anchor, at most about HOMES, and a batch of replicas. Anchors with more at home deal them over parts, and every part gets all as replicas.
    """

    def replicate(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), TOGETHER):
                some = values[at : at + TOGETHER]
                anchor, owner, away = anchors(some)
                yield {"anchor": anchor, "away": away, "print": some[owner].view(np.int64)}

    def settle(batches):
        for batch in batches:
            yield {"anchor": home_anchors(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))}

    at_home = map_batches(prints, [("anchor", "long")], settle).groupBy("anchor").agg(F.count("*").alias("homes"))
    hot = pin(
        at_home.where(F.col("homes") > HOMES).select("anchor", F.ceil(F.col("homes") / HOMES).cast("long").alias("parts")),
        "simhash-hot",
    )
    tasks = max(-(-prints.count() // PRINTS), prints.rdd.getNumPartitions())
    spread = prints.repartition(tasks, "print")
    rows = map_batches(spread, [("anchor", "long"), ("away", "boolean"), ("print", "long")], replicate)
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = rows.join(hot, "anchor", "left").select(
        "anchor", "print", F.col("away").alias("far"), F.pmod(F.xxhash64("print"), parts).alias("own"),
        F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"),
    ).withColumn("away", F.expr("far OR part <> own"))  # at home in one part, a replica in the others
    key = F.shiftleft(F.shiftleft("part", ANCHOR_BITS) + F.col("anchor"), 1) + F.col("away").cast("long")
    sorted_rows = dealt.select(key.alias("key"), "print").repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return map_batches(sorted_rows, [("a", "long"), ("b", "long")], compare)


def simhash_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    Documents link when their fingerprints differ in at most THRESHOLD bits; ``component_id`` is the smallest id reachable by
    links. Null and empty texts have fingerprint zero and link like any other. Rows of equal fingerprints are one before
    links are searched, so copies make no pairs. A row without an id takes part and gets the smallest id of its component,
    null if there is none; repeated rows each give a row; other columns are ignored.
    """

    def run(batches):
        for ids, texts in blocks(batches):
            prints = np.array([fingerprint(text, width) for text in texts], np.uint64)
            yield {"doc_id": ids, "print": prints.view(np.int64)}

    marks = pin(map_batches(docs.select("doc_id", "text"), [("doc_id", "long"), ("print", "long")], run), "simhash-marks")
    first = pin(marks.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-prints")
    linked = pin(components(links(first.select("print")), "simhash-links").withColumnRenamed("node", "print"), "simhash-linked")
    lowest = pin(linked.join(first, "print").groupBy("component").agg(F.min("first").alias("lowest")), "simhash-lowest")
    reached = linked.join(lowest, "component").select("print", "lowest")
    final = pin(
        first.join(reached, "print", "left").select("print", F.coalesce("lowest", "first").alias("component_id")), "simhash-final"
    )
    discard(first, linked, lowest)
    return marks.join(final, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
