"""Fingerprints, periodic runs and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tabprep.llm import infill, periodic, simhash
from tabprep.llm.queries import all_queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- fingerprints


def plain_print(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    joined = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in joined]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    lowest = {}
    for i, key in enumerate(ids):
        if key is not None:
            lowest[find(i)] = min(key, lowest.get(find(i), key))
    return [lowest.get(find(i)) for i in range(len(prints))]


def test_the_code_covers_every_block_once():
    leader, words, first, count = simhash.covering()
    assert len(words) == 44_552 and (count[:, 0] == 1).all()  # 2**11 syndromes, words within 5 of each
    values = np.random.default_rng(5).integers(0, 1 << simhash.LENGTH, 200)
    code = {int(v) for v in np.arange(1 << simhash.LENGTH)[simhash.syndrome(np.arange(1 << simhash.LENGTH)) == 0]}
    for value in values.tolist():
        s = int(simhash.syndrome(np.array([value]))[0])
        for e in range(3):
            found = (value ^ leader[s] ^ words[first[s, e] : first[s, e] + count[s, e]]).tolist()
            least = 0 if e == 0 else simhash.RADIUS + e
            wanted = {c for c in code if least <= (c ^ value).bit_count() <= simhash.RADIUS + e}
            assert set(found) == wanted and len(found) == len(wanted)


def test_fingerprints_and_components_against_all_pairs(spark, docs, odd_docs):
    rng = random.Random(3)
    base = [r.text for r in docs.limit(40).collect()]
    near = []
    for text in base[:12]:
        words = (text or "x").split()
        for _ in range(4):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
            near.append(" ".join(words))
    for table in (docs, odd_docs, spark.createDataFrame(list(enumerate(base + near)), "doc_id long, text string")):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        prints = [plain_print(text) for _, text in rows]
        wanted = sorted(zip((k for k, _ in rows), (f"{p:016x}" for p in prints), plain_components(prints, [k for k, _ in rows])), key=str)
        found = sorted(map(tuple, simhash.simhash_components(table).collect()), key=str)
        assert found == wanted


@pytest.mark.parametrize("homes", [2_000, 7])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, homes):
    """Clusters around a few centres, dense and in chains, with many at home at one anchor."""
    monkeypatch.setattr(simhash, "HOMES", homes)
    rng = random.Random(homes)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            value = centre
            for _ in range(rng.randrange(6)):
                value ^= 1 << rng.randrange(64)
            prints.add(value)
        for _ in range(15):
            centre ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(centre)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long").repartition(5)).collect()
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in found:
        root[find(a)] = find(b)
    same = {}
    for p, component in zip(signed, plain_components(prints, range(len(prints)))):
        assert same.setdefault(component, find(p)) == find(p)
    assert len(set(same.values())) == len(same)
    assert len(found) <= 40 * len(prints)


def test_no_rows_have_no_fingerprints(no_docs):
    assert simhash.simhash_components(no_docs).collect() == []


# -- periodic runs


def plain_runs(words):
    found = []
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            stretch = words[start : start + length]
            least = next(p for p in range(1, length + 1) if all(stretch[k] == stretch[k + p] for k in range(length - p)))
            if least == q and length >= max(6, 4 * q):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(words):
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    return runs, best, " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcd"), max_size=40), max_size=4))
def test_runs_of_small_alphabets(documents):
    found = periodic.runs_of([[w.encode() for w in words] for words in documents])
    assert found == [plain_runs(words) for words in documents]


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=30), st.integers(1, 7), st.integers(0, 20)), max_size=4)
)
def test_runs_of_planted_repeats(parts):
    words = [w for unit, times, rest in parts for w in (unit * times + unit[:rest])]
    words = words + ["z"] + words
    assert periodic.runs_of([[w.encode() for w in words]]) == [plain_runs(words)]


def test_long_runs_are_followed_once():
    words = [b"x"] * 50_000 + [b"y", b"z"] * 30_000 + [f"w{i % 9_000}".encode() for i in range(40_000)]
    runs = periodic.runs_of([words])[0]
    assert runs == [(0, 50_000, 1), (50_000, 60_000, 2), (110_000, 40_000, 9_000)]
    kept = periodic.collapse(words, runs)
    assert len(kept) == 1 + 2 + 9_000


def test_strongest_run_ties():
    assert periodic.strongest([(0, 12, 3), (5, 8, 2), (9, 8, 2)]) == (0, 12, 3)
    assert periodic.strongest([(0, 12, 3), (0, 24, 6), (4, 9, 2)]) == (4, 9, 2)
    assert periodic.strongest([]) == (None, None, None)


def test_periodic_query_against_a_plain_version(spark, docs):
    found = {r.doc_id: r for r in all_queries()["op12_periodic_runs"](spark, SF).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    with_runs = 0
    for row in rows:
        words, n = WORD.findall(row.text or ""), len(WORD.findall(row.text or ""))
        h = zlib.crc32(str(row.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, = (g % n,)
            p = 1 + int((n - a) / (3 + g % 8))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 600:
            continue  # the plain version takes the square of the words
        runs, best, kept = plain_row(words)
        with_runs += bool(runs)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        assert tuple(found[row.doc_id]) == (row.doc_id, len(runs), *best, milli, sha(listed), sha(kept))
    assert with_runs >= 5


def test_periodic_runs_on_odd_rows(odd_docs, no_docs):
    found = periodic.periodic_runs(odd_docs, periodic.planted).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted((r.doc_id for r in odd_docs.collect()), key=str)
    for row in found:
        if row.doc_id in (3, 4, 5):
            assert row.n_runs == 0 and row.start is None and row.runs == "" and row.collapsed == ""
    assert periodic.periodic_runs(no_docs).collect() == []


# -- fill in the middle


def plain_infill(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_infill_of_odd_rows(spark, odd_docs, no_docs):
    marked = [(k, t) for k, t in enumerate(["<P>", "a<S>b", "x<M", "<" * 9, "<P" * 6, ">P<", "é" * 9_000, "x" * 4_096, None, ""] * 3)]
    for table in (odd_docs, spark.createDataFrame(marked, "doc_id long, text string").repartition(3)):
        wanted = sorted((plain_infill(r.doc_id, r.text) for r in table.collect()), key=str)
        assert sorted(map(tuple, infill.fill_in_middle(table, texts=True).collect()), key=str) == wanted
        hashed = sorted(((*row[:5], sha(row[5]), sha(row[6])) for row in wanted), key=str)
        assert sorted(map(tuple, infill.fill_in_middle(table).collect()), key=str) == hashed
    assert infill.fill_in_middle(no_docs).collect() == []


def test_restoration_sorts_without_a_second_shuffle(spark, odd_docs):
    plan = infill.fill_in_middle(odd_docs).rdd.toDebugString().decode()
    assert plan.count("ShuffledRDD") == 1


def test_copies_are_spread_like_the_input(spark):
    table = spark.createDataFrame([(None, "same text")] * 900, "doc_id long, text string").repartition(6)
    found = infill.fill_in_middle(table).rdd.glom().map(len).collect()
    assert sum(found) == 900 and max(found) <= 600 and sum(map(bool, found)) >= 3
