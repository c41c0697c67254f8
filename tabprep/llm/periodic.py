"""Periodic runs of words, found by seeds that are extended along diagonals.

A diagonal holds the pairs of words that lie one lag apart. A run of period q and length of at least max(6, 4 * q) matches
along the diagonal of lag q on at least max(6, 4 * q) - q words: 5 for q = 1 and 3 * q from q = 2 on. Lags are taken in
classes [2**j, 2**(j+1)), and in each class k-grams of the least of these overlaps are indexed. They are longer than one and a
half periods, so the next occurrence of a k-gram of a run lies exactly its smallest period further on: were it nearer, the run
would have a smaller period. Pairs of neighbouring occurrences are therefore all that has to be enumerated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from tabprep.llm.common import STEP, blocks, map_batches, mix, span_hashes

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Characters of the texts whose seeds are searched at once.
TOGETHER = 1_000_000

Run = tuple[int, int, int]  # start, length, period


def least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * period)


def lag_classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """Lowest lag, lag behind the highest, and words that a run of the class matches along its diagonal at least."""
    low = 1
    while low <= longest:
        yield low, 2 * low, least_length(low) - low
        low *= 2


def seeds(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and lags of neighbouring occurrences of k-grams in the same document, by position.

    ``values`` are the word hashes of several documents, ``ends`` the end of each. Classes of longer lags look only at positions
    whose shortest k-gram occurs twice in the document. Of seeds of one lag in a row only the first is given.
    """
    n = len(values)
    starts = np.concatenate([[0], ends[:-1]])
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    sizes = ends - starts
    longest = int(sizes.max(initial=0)) // LEAST_PERIODS
    places, lags = [], []
    some = np.arange(n)
    for low, high, k in lag_classes(longest):
        some = some[(some + k <= ends[owner[some]]) & (sizes[owner[some]] >= least_length(low))]
        if not len(some):
            break
        grams = span_hashes(values, some, some + k) ^ mix(owner[some].astype(np.uint64) * STEP + np.uint64(1))
        order = np.argsort(grams, kind="stable")  # positions of equal grams stay in order
        same = grams[order[1:]] == grams[order[:-1]]
        here, there = some[order[:-1][same]], some[order[1:][same]]
        lag = there - here
        wanted = (lag >= low) & (lag < high)
        places.append(here[wanted])
        lags.append(lag[wanted])
        twice = np.zeros(len(some), bool)
        twice[order[:-1][same]] = twice[order[1:][same]] = True
        some = some[twice]
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, lag = np.concatenate(places), np.concatenate(lags)
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    opens = np.ones(len(place), bool)
    opens[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    place, lag = place[opens], lag[opens]
    order = np.argsort(place, kind="stable")
    return place[order], lag[order]


def _agree(values: np.ndarray, left: int, right: int, most: int, step: int) -> int:
    """How many words agree from ``left`` and ``right`` on, in the direction of ``step``, at most ``most``."""
    done, size = 0, 32
    while done < most:
        size = min(size, most - done)
        if step > 0:
            differ = values[left + done : left + done + size] != values[right + done : right + done + size]
        else:
            differ = (values[left - done - size + 1 : left - done + 1] != values[right - done - size + 1 : right - done + 1])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done += size
        size *= 2
    return done


def extend(values: np.ndarray, places: list[int], lags: list[int], end: int) -> list[Run]:
    """Runs of one document (its words end at ``end`` of ``values``, positions count from 0) that the seeds lead to.

    Seeds come by position. ``covered`` holds for every lag how far its diagonal has been followed: a seed that lies
    within is not extended again.
    """
    covered: dict[int, int] = {}
    found = []
    for place, lag in zip(places, lags):
        if covered.get(lag, 0) > place:
            continue
        begin = place - _agree(values, place - 1, place - 1 + lag, place, -1)
        stop = place + _agree(values, place, place + lag, end - lag - place, 1)
        covered[lag] = max(stop, place + 1)
        if stop - begin + lag >= least_length(lag):
            found.append((begin, stop - begin + lag, lag))
    return sorted(found, key=lambda run: (run[0], run[2]))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def runs_of(documents: list[list[bytes]]) -> list[list[Run]]:
    """The runs of every document, given as lists of words."""
    values = [word_hashes(words) for words in documents]
    sizes = np.array([len(v) for v in values], np.int64)
    ends = np.cumsum(sizes)
    places, lags = seeds(np.concatenate([np.zeros(0, np.uint64), *values]), ends)
    of = np.searchsorted(ends, places, "right")
    found: list[list[Run]] = [[] for _ in documents]
    bounds = np.searchsorted(of, np.arange(len(documents) + 1))
    for k in np.unique(of).tolist():
        mine = slice(int(bounds[k]), int(bounds[k + 1]))
        first = int(ends[k] - sizes[k])
        found[k] = extend(values[k], (places[mine] - first).tolist(), lags[mine].tolist(), int(sizes[k]))
    return found


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    gone = np.cumsum(steps[:-1]) > 0
    return [word for word, out in zip(words, gone.tolist()) if not out]


def strongest(runs: list[Run]) -> Run | tuple[None, None, None]:
    """The run with the greatest length / period; of equal ones the first to start, then that of the smallest period."""
    best: Run | tuple[None, None, None] = (None, None, None)
    for start, length, period in runs:  # by start, then period: only a greater one takes over
        if best[0] is None or length * best[2] > best[1] * period:
            best = start, length, period
    return best


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a period made by rule in a tenth of the documents, by a hash of the id; rows without an id are left as they are."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed`` of every row of ``docs``.

    A run is a stretch of words of smallest period q, of at least max(6, 4 * q) words, that no neighbouring word extends. The
    strongest run is given (nulls without any); ``runs`` lists all, a line ``start,length,period`` each; ``collapsed`` is the text
    without what repeats the first period of a run, words joined by one space. ``change`` may give other words for an id and its
    words. Null, empty and blank texts have no words and no runs; repeated rows each give a row; a null id stays null; other
    columns are ignored.
    """
    fields = [
        ("doc_id", "long"), ("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"),
        ("exponent_milli", "long"), ("runs", "string"), ("collapsed", "string"),
    ]

    def run(batches):
        for ids, texts in blocks(batches, TOGETHER):
            documents = [(text or "").encode("utf-8", "surrogatepass").split() for text in texts]
            if change:
                documents = list(map(change, ids, documents))
            rows = []
            for key, words, runs in zip(ids, documents, runs_of(documents)):
                start, length, period = strongest(runs)
                listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
                kept = b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass")
                rows.append((key, len(runs), start, length, period, start if start is None else 1000 * length // period, listed, kept))
            yield {name: list(column) for (name, _), column in zip(fields, zip(*rows))}

    return map_batches(docs.select("doc_id", "text"), fields, run)
