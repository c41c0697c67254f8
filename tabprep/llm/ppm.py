"""Language-model scoring: prediction by partial matching over bytes, and word counts beside it.

A trie of byte contexts, kept as sorted arrays of packed n-grams per order, is learned from the training documents. A
byte that its context has not seen escapes to the next shorter context, where the symbols of the longer one are excluded
(escape estimate: distinct / (total + distinct)). Code lengths add up per document.

All n-grams count, whatever the size of the corpus: each order of the trie is a table of contexts with all that followed
them. Contexts of up to two bytes and, of the longer ones, those with the most occurrences, are sent to the tasks; an n-gram
whose walk down the orders meets another context is met with the tables by a join, once for all its occurrences.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import blocks, map_batches, remainder
from tabprep.workspace import pin

ORDER = 4  # at most 6: an n-gram of order + 1 bytes is a positive 64-bit number
SHORT = 2  # contexts of up to this many bytes go to the tasks whole: at most 2 ** 24 n-grams
EDGE = 0xFF  # never a byte of UTF-8: stands before every text and, as its end, behind it


def frames(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (order + 1)-grams of all symbols, ends included, and how many each text has."""
    edge = bytes([EDGE])
    raw = np.frombuffer(b"".join(edge * order + text + edge for text in texts), np.uint8).astype(np.int64)
    sizes = np.array([len(text) + 1 for text in texts], np.int64)
    n = max(len(raw) - order, 0)
    grams = np.zeros(n, np.int64)
    for k in range(order + 1):
        grams = (grams << 8) | raw[k : k + n]
    inside = np.ones(n, bool)  # leave out grams that end in the symbols before the next text
    starts = np.cumsum(sizes + order)[:-1]
    for k in range(order):
        inside[starts - order + k] = False
    return grams[inside], sizes


def low_bytes(n: int) -> int:
    return (1 << 8 * n) - 1


class Trie:
    """Byte contexts of up to ``order`` symbols with the counts of what followed."""

    def __init__(
        self, levels: list[tuple[np.ndarray, np.ndarray]], excluded: list[np.ndarray] | None = None, complete: list[bool] | None = None
    ):
        """``levels[j]``: packed grams of j + 1 bytes, ascending, and their counts, with all that follows a context they hold.

        ``excluded[j]``: for each context, the counts its symbols have behind the next shorter one; found in the levels if
        none is given. An order that is not ``complete`` holds some contexts only.
        """
        self.order = len(levels) - 1
        self.complete = complete or [True] * len(levels)
        self.grams = [grams for grams, _ in levels]
        self.counts = [counts.astype(np.float64) for _, counts in levels]
        self.contexts, self.total, self.kinds, self.excluded = [], [], [], []
        for j, (grams, _) in enumerate(levels):
            contexts, first, kinds = np.unique(grams >> 8, return_index=True, return_counts=True)
            add = lambda values: np.add.reduceat(values, first) if len(first) else values  # noqa: E731, B023
            self.contexts.append(contexts)
            self.total.append(add(self.counts[j]))
            self.kinds.append(kinds.astype(np.float64))
            if excluded is not None:
                self.excluded.append(excluded[j].astype(np.float64))
                continue
            lower = np.zeros(len(grams))
            if j:
                below, seen = self._place(self.grams[j - 1], grams & low_bytes(j))
                lower[seen] = self.counts[j - 1][below[seen]]
            self.excluded.append(add(lower))

    @staticmethod
    def _place(ordered: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(ordered):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
        return place, ordered[place] == keys

    def _facts(self, j: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total, kinds and excluded count of each context and the count of its symbol, as rows; and which contexts are held."""
        facts = np.zeros((4, len(own)))
        at, held = self._place(self.contexts[j], own >> 8)
        for row, values in zip(facts, (self.total[j], self.kinds[j], self.excluded[j])):
            row[held] = values[at[held]]
        place, hit = self._place(self.grams[j], own)
        facts[3][hit] = self.counts[j][place[hit]]
        return facts, held

    def costs(self, grams: np.ndarray, given: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """-log10 probability of the last symbol of every packed (order + 1)-gram.

        Where the walk meets an order that is not complete and a context it does not hold, ``given[j]`` has its facts (rows as in
        ``_facts``); without them the cost is not a number.
        """
        out = np.zeros(len(grams), np.float64)
        rows = np.arange(len(grams))
        gone_total, gone_kinds = np.zeros(len(rows)), np.zeros(len(rows))
        for j in range(self.order, -1, -1):
            own = grams[rows] & low_bytes(j + 1)
            facts, held = self._facts(j, own)
            if not self.complete[j]:
                if given is None:
                    out[rows[~held]] = np.nan
                    rows, gone_total, gone_kinds, facts = rows[held], gone_total[held], gone_kinds[held], facts[:, held]
                else:
                    facts[:, ~held] = given[j][:, rows[~held]]
            seen, hit = facts[0] > 0, facts[3] > 0
            total, kinds = facts[0] - gone_total, facts[1] - gone_kinds
            out[rows[hit]] += np.log10((total[hit] + kinds[hit]) / facts[3][hit])
            escaped = seen & ~hit & (kinds > 0)
            out[rows[escaped]] += np.log10((total[escaped] + kinds[escaped]) / kinds[escaped])
            gone_total = np.where(seen, facts[2] if j else 0.0, gone_total)[~hit]
            gone_kinds = np.where(seen, facts[1], gone_kinds)[~hit]
            rows = rows[~hit]
            if not len(rows):
                return out
        out[rows] += np.log10(np.maximum(256 - gone_kinds, 1))
        return out

    def log_probabilities(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every text the sum over n-grams whose cost is known here; and text, n-gram, times of all others."""
        grams, sizes = frames(texts, self.order)
        keys, place = np.unique(grams, return_inverse=True)
        costs = self.costs(keys)
        known = np.isfinite(costs)
        total = np.concatenate([[0.0], np.cumsum(np.where(known, costs, 0.0)[place])])
        ends = np.cumsum(sizes)
        open_at = np.flatnonzero(~known[place])
        pair, times = np.unique(np.searchsorted(ends, open_at, "right") * max(len(keys), 1) + place[open_at], return_counts=True)
        return -(total[ends] - total[ends - sizes]), pair // max(len(keys), 1), keys[pair % max(len(keys), 1)], times


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """``gram, n`` of all rows of ``text``: counted in tasks, summed by Spark."""

    def run(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(place, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

        for (column,) in blocks(batches):
            grams, _ = frames([(text or "").encode() for text in column], order)
            parts.append(np.unique(grams, return_counts=True))
            if len(parts) >= 16:
                parts = [merged()]
                if len(parts[0][0]) >= HELD_IN_TASK:
                    yield dict(zip(("gram", "n"), parts.pop()))
        if parts:
            yield dict(zip(("gram", "n"), merged()))

    counted = map_batches(texts.select("text"), [("gram", "long"), ("n", "long")], run)
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


HELD_IN_TASK = 2_000_000  # distinct n-grams a task holds before it sends their counts


def context_tables(counted: DataFrame, order: int) -> list[DataFrame]:
    """For every order ``context, total, kinds, excluded, followers``; ``followers`` are at most 256 (gram, n)."""
    levels = [counted]
    for j in range(order, 0, -1):
        suffix = F.col("gram").bitwiseAND(low_bytes(j)).alias("gram")
        levels.insert(0, pin(levels[0].groupBy(suffix).agg(F.sum("n").alias("n")), f"ppm-order-{j - 1}"))
    tables = []
    for j, level in enumerate(levels):
        if j:
            below = levels[j - 1].select(F.col("gram").alias("suffix"), F.col("n").alias("below"))
            level = level.withColumn("suffix", F.col("gram").bitwiseAND(low_bytes(j))).join(below, "suffix")
        else:
            level = level.withColumn("below", F.lit(0).cast("long"))
        tables.append(pin(level.groupBy(F.shiftright("gram", 8).alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("below").alias("excluded"),
            F.collect_list(F.struct("gram", "n")).alias("followers"),
        ), f"ppm-contexts-{j}"))
    return tables


def _sorted(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of numbers on the driver, in the order of the first."""
    keys, values = (column.to_numpy() for column in pairs.toArrow().columns)
    order = np.argsort(keys)
    return keys[order], values[order]


def train(texts: DataFrame, order: int = ORDER, max_grams: int = 500_000, short: int = SHORT) -> tuple[Trie, dict[int, DataFrame]]:
    """The trie for the tasks, and for each of its orders that is not complete the table of the other contexts.

    Of contexts longer than ``short`` bytes the most frequent (by powers of two of their occurrences) are in the trie, as many as
    have at most ``max_grams`` n-grams for each order.
    """
    tables = context_tables(pin(count_grams(texts, order), "ppm-grams"), order)
    levels, excluded, others = [], [], {}
    for j, table in enumerate(tables):
        table = table.withColumn("size", F.floor(F.log2("total")).cast("int"))
        least = kept = 0
        if j > short:
            sizes = {row["size"]: row["n"] for row in table.groupBy("size").agg(F.sum("kinds").alias("n")).collect()}
            for size in sorted(sizes, reverse=True):
                kept += sizes[size]
                if kept > max_grams:
                    least = size + 1
                    others[j] = table.where(F.col("size") < least)
                    break
        held = table.where(F.col("size") >= least)
        grams, counts = _sorted(held.select(F.explode("followers").alias("f")).select("f.gram", "f.n"))
        levels.append((grams, counts))
        excluded.append(_sorted(held.select("context", "excluded"))[1])
    return Trie(levels, excluded, [j not in others for j in range(order + 1)]), others


def gram_costs(grams: DataFrame, trie: Trie, others: dict[int, DataFrame]) -> DataFrame:
    """``gram, cost`` of distinct n-grams, with the facts of contexts that ``trie`` does not hold joined from ``others``."""
    facts, orders = ["total", "kinds", "excluded", "n"], list(others)
    for j, table in others.items():
        own = F.col("gram").bitwiseAND(low_bytes(j + 1))
        met = grams.withColumn("context", F.shiftright(own, 8)).join(table, "context", "left")
        followed = F.get(F.filter("followers", lambda f: f["gram"] == own), 0)["n"]  # noqa: B023
        cells = [*[F.col(c) for c in facts[:3]], followed]
        grams = met.select(*grams.columns, *[F.coalesce(c, F.lit(0)).alias(f"{name}{j}") for c, name in zip(cells, facts)])

    def run(batches):
        for batch in batches:
            columns = {name: batch.column(i).to_numpy() for i, name in enumerate(batch.schema.names)}
            given = {j: np.array([columns[f"{name}{j}"] for name in facts], np.float64) for j in orders}
            yield {"gram": columns["gram"], "cost": trie.costs(columns["gram"], given)}

    return map_batches(grams, [("gram", "long"), ("cost", "double")], run)


def token_hash(word: bytes) -> int:
    """64 bits of a token, signed; the end token is the empty word."""
    value = xxhash.xxh3_64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def token_counts(texts: DataFrame, held_in_task: int = 400_000) -> DataFrame:
    """``token, n``: counts of lower-cased words and of one end per row, by 64-bit hash."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def rows():
            return {"token": [token_hash(word) for word in counts], "n": list(counts.values())}

        for (column,) in blocks(batches):
            counts[b""] += len(column)
            for text in column:
                counts.update((text or "").encode().lower().split())
            if len(counts) >= held_in_task:
                yield rows()
                counts = Counter()
        if counts:
            yield rows()

    counted = map_batches(texts.select("text"), [("token", "long"), ("n", "long")], run)
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def language_model_scores(
    docs: DataFrame, divisor: int = 7, held: int = 2, order: int = ORDER, common_tokens: int = 2_000_000, max_grams: int = 500_000,
    short: int = SHORT,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Learned from all rows whose remainder is not ``held``. Tokens that make up more than 1 / ``common_tokens`` of the training
    tokens (so fewer than that many) are looked up where the text is read; the others are joined by hash, so that no
    frequent word reaches a shuffle. Orders of the trie with more than ``max_grams`` n-grams are met in the same way (see
    ``train``). Null texts count as empty: one end token. Repeated rows each give a row, a null id
    counts as the empty text in the split, other columns are ignored. Without training rows all counts are 0 and bytes are uniform.
    """
    learn = docs.where(remainder("doc_id", divisor) != held).select("text")
    trie, others = train(learn, order, max_grams, short)
    counts = pin(token_counts(learn), "token-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"], totals["v"]
    cut = n // common_tokens
    common = counts.where(F.col("n") > cut).toPandas().sort_values("token")
    tokens, logs = common["token"].to_numpy(np.int64), np.log10(common["n"].to_numpy(float) + 1)
    end_count = int(common.loc[common["token"] == token_hash(b""), "n"].sum())
    fields = [
        ("doc_id", "long"), ("n_tokens", "long"), ("known", "long"), ("logs", "double"), ("score", "double"),
        ("rare", "array<long>"), ("times", "array<long>"), ("grams", "array<long>"), ("gram_times", "array<long>"),
    ]
    if not end_count:  # an end so rare that it is not common: as good as never with more than one word per text
        end_row = counts.where(F.col("token") == token_hash(b"")).first()
        end_count = end_row["n"] if end_row else 0

    def run(batches):
        for ids, texts in blocks(batches):
            raw = [(text or "").encode() for text in texts]
            words = [text.lower().split() for text in raw]
            place: dict[bytes, int] = {}
            cells = np.array([place.setdefault(word, len(place)) for row in words for word in row], np.int64)
            hashes = np.array([token_hash(word) for word in place], np.int64)
            sizes = np.array([len(row) for row in words], np.int64)
            owner = np.repeat(np.arange(len(ids)), sizes)
            at = np.minimum(np.searchsorted(tokens, hashes), max(len(tokens) - 1, 0))
            found = tokens[at] == hashes if len(tokens) else np.zeros(len(hashes), bool)
            value = np.where(found, logs[at], 0.0) if len(tokens) else np.zeros(len(hashes))
            known = np.bincount(owner, weights=found[cells], minlength=len(ids)).astype(np.int64)
            total = np.bincount(owner, weights=value[cells], minlength=len(ids))
            rest = ~found[cells]
            pair, times = np.unique(owner[rest] * max(len(place), 1) + cells[rest], return_counts=True)
            bounds = np.searchsorted(pair, np.arange(len(ids) + 1) * max(len(place), 1))
            rare = hashes[pair % max(len(place), 1)] if len(pair) else pair
            cut_at = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            score, open_in, grams, gram_times = trie.log_probabilities(raw)
            edges = np.searchsorted(open_in, np.arange(len(ids) + 1)).tolist()
            yield {
                "doc_id": ids, "n_tokens": sizes + 1, "known": known + (end_count > 0),
                "logs": total + np.log10(end_count + 1), "score": score,
                "rare": [rare[a:b] for a, b in cut_at], "times": [times[a:b] for a, b in cut_at],
                "grams": [grams[a:b] for a, b in zip(edges, edges[1:])],
                "gram_times": [gram_times[a:b] for a, b in zip(edges, edges[1:])],
            }

    scored = map_batches(docs.select("doc_id", "text"), fields, run)
    scored = pin(scored.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select(
        "row", F.col("t.rare").alias("token"), F.col("t.times").alias("times")
    )
    sums = (
        rare.join(counts.where(F.col("n") <= cut), "token").groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    )
    scored = scored.join(sums, "row", "left").withColumn("open_cost", F.lit(0.0))
    if others:
        met = scored.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("t"))
        met = met.select("row", F.col("t.grams").alias("gram"), F.col("t.gram_times").alias("times"))
        costs = pin(gram_costs(met.select("gram").distinct(), trie, others), "ppm-costs")
        costs = met.join(costs, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("open_cost"))
        scored = scored.drop("open_cost").join(costs, "row", "left")
    zero = F.lit(0)
    return scored.select(
        "doc_id", (remainder("doc_id", divisor) == held).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1))))
        .alias("base_score"), (F.col("score") - F.coalesce("open_cost", F.lit(0.0))).alias("score"),
    )
