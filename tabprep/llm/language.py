"""Language identification with interpolated Kneser-Ney character models.

Highest-order counts come from all training text; lower orders use continuation counts derived from them. Both, and the
probabilities, are computed by Spark over all n-grams. Where a language has more n-grams of an order than a model may hold, its rarest
are taken out afterwards and the back-off weights made to sum to one again, language by language, so no language loses its
model to a larger one. Models live in sorted arrays of 64-bit n-gram hashes, one column of log probabilities per language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import HashArray, blocks, hash_sample, map_batches, remainder
from tabprep.workspace import discard, pin

ORDER = 4  # n-grams of 16-bit units, packed into 64 bits
SPACE = 32
_letters = np.array([chr(i).isalpha() for i in range(1 << 16)])
_letters[0xD800:0xE000] = True  # halves of letters beyond 16 bits; other such characters are taken out before


def letter_units(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other as 16-bit units, and how many each has.

    Lower case, every run of other characters than letters as one space, ``order - 1`` spaces before each text and one after. A text
    without letters has no units.
    """
    raw = []
    for text in texts:
        low = (text or "").lower()
        if not low.isascii() and max(low) > "\uffff":
            low = "".join(c if c <= "\uffff" or c.isalpha() else " " for c in low)
        raw.append((" " * (order - 1) + low + " ").encode("utf-16-le"))
    sizes = np.array([len(part) // 2 for part in raw], np.int64)
    units = np.frombuffer(b"".join(raw), np.uint16)
    letter = _letters[units]
    starts = np.cumsum(sizes) - sizes
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    for k in range(order - 1):
        kept[starts + k] = True
    counts = np.add.reduceat(kept, starts, dtype=np.int64) if len(starts) else sizes
    has = np.add.reduceat(letter, starts, dtype=np.int64) > 0 if len(starts) else sizes > 0
    if not has.all():
        kept &= np.repeat(has, sizes)
        counts = counts * has
    return np.where(letter, units, SPACE)[kept], counts


def packed(units: np.ndarray, order: int) -> np.ndarray:
    """All n-grams of ``order`` <= 4 units as 64-bit numbers, by their first unit."""
    n = max(len(units) - order + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(order):
        out = (out << np.uint64(16)) | units[k : k + n]
    return out


def whole_grams(units: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that lie within one text, and how many each text has."""
    grams = packed(units, order)
    counts = np.maximum(sizes - order + 1, 0)
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(grams), bool)
    for k in range(1, order):
        at = starts[(sizes > 0) & (starts >= k)] - k
        inside[at[at < len(grams)]] = False
    return grams[inside], counts


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, n`` over whole texts: counted in tasks block by block, then summed by Spark."""

    def run(batches):
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in parts[lang]]), return_inverse=True)
            return keys, np.bincount(place, weights=np.concatenate([c for _, c in parts[lang]])).astype(np.int64)

        for langs, texts in blocks(batches):
            by_lang: dict[str, list[str | None]] = {}
            for lang, text in zip(langs, texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                grams, _ = whole_grams(*letter_units(own, order), order)
                parts.setdefault(lang, []).append(np.unique(grams, return_counts=True))
                if len(parts[lang]) >= 32:
                    parts[lang] = [merged(lang)]
        for lang in parts:
            keys, counts = merged(lang)
            yield {"lang": [lang] * len(keys), "gram": keys.view(np.int64), "n": counts}

    fields = [("lang", "string"), ("gram", "long"), ("n", "long")]
    return map_batches(docs.select("lang", "text"), fields, run).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Models:
    """For each order a sorted hash array of n-grams, with log10 probability and back-off weight per language (rows)."""

    languages: list[str]
    arrays: list[HashArray | None]
    logs: list[np.ndarray]
    backoffs: list[np.ndarray]
    base: np.ndarray
    order: int
    slope: float = 1.0
    reject: float = 0.0

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean -log10 probability per symbol, by text and language, and which texts have a letter."""
        grams, counts = whole_grams(*letter_units(texts, self.order), self.order)
        has = counts > 0
        starts = (np.cumsum(counts) - counts)[has]
        place, hit = self.arrays[self.order].find(grams)
        missed = np.flatnonzero(~hit)
        rest = self._lower(grams[missed])
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            cost = -self.logs[self.order][k][place]
            cost[missed] = rest[k]
            if len(starts):
                out[has, k] = np.add.reduceat(cost, starts, dtype=np.float64) / counts[has]
        return out, has

    def _lower(self, grams: np.ndarray) -> np.ndarray:
        """Costs of n-grams that no language has, by language: back-off weights and shorter n-grams."""
        cost = np.zeros((len(self.languages), len(grams)), np.float32)
        rows = np.arange(len(grams))
        for order in range(self.order - 1, -1, -1):
            if not len(rows):
                break
            context = (grams[rows] >> np.uint64(16)) & np.uint64((1 << 16 * order) - 1)
            if order:
                place, hit = self.arrays[order].find(context)
                cost[:, rows[hit]] -= self.backoffs[order][:, place[hit]]
                place, hit = self.arrays[order].find(grams[rows] & np.uint64((1 << 16 * order) - 1))
                cost[:, rows[hit]] -= self.logs[order][:, place[hit]]
                rows = rows[~hit]
            else:
                cost[:, rows] -= self.base[:, None]
        return cost


def estimate(counted: dict[str, tuple[np.ndarray, np.ndarray]], order: int, discount: float = 0.75) -> Models:
    """Interpolated Kneser-Ney from ascending highest-order n-grams and their counts, by language."""
    languages = sorted(counted)
    mask = [np.uint64((1 << 16 * k) - 1) for k in range(order + 1)]
    probabilities: list[list[tuple[np.ndarray, np.ndarray]]] = []
    weights: list[list[tuple[np.ndarray, np.ndarray]]] = []
    bases = []
    for lang in languages:
        grams: list = [None] * order + [counted[lang][0].astype(np.uint64)]
        counts: list = [None] * order + [counted[lang][1].astype(float)]
        for k in range(order - 1, 0, -1):  # how many different units stand before
            grams[k], kinds = np.unique(grams[k + 1] & mask[k], return_counts=True)
            counts[k] = kinds.astype(float)
        base, lower = 1.0 / (len(grams[1]) + 1), None
        own_p, own_w = [(np.zeros(0, np.uint64), np.zeros(0))], []
        for k in range(1, order + 1):
            contexts, first, owner = np.unique(grams[k] >> np.uint64(16), return_index=True, return_inverse=True)
            total, kinds = np.add.reduceat(counts[k], first), np.add.reduceat(np.ones(len(grams[k])), first)
            back = discount * kinds / total
            shorter = base if lower is None else lower[np.searchsorted(grams[k - 1], grams[k] & mask[k - 1])]
            lower = np.maximum(counts[k] - discount, 0) / total[owner] + back[owner] * shorter
            own_p.append((grams[k], lower))
            own_w.append((contexts, back))
        probabilities.append(own_p)
        weights.append(own_w)
        bases.append(base * own_w[0][1][0])
    return assemble(languages, probabilities, weights, bases, order)


def assemble(languages: list[str], probabilities: list, weights: list, bases: list[float], order: int) -> Models:
    """Models from, by language: ascending n-grams and their probabilities by order, contexts and their back-off weights by
    order of what they precede, and the probability of an unknown unit."""
    mask = [np.uint64((1 << 16 * k) - 1) for k in range(order + 1)]

    def look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[1][place], table[0][place] == keys

    arrays: list[HashArray | None] = [None]
    logs, backoffs = [np.zeros((len(languages), 0))], [np.zeros((len(languages), 0))]
    below: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(1, np.uint64), np.array([b])) for b in bases]
    for k in range(1, order + 1):
        keys = np.unique(np.concatenate([p[k][0] for p in probabilities] + [w[k][0] for w in weights if k < order]))
        array, table, rest, complete = HashArray(keys), [], [], []
        for which in range(len(languages)):
            value, there = look(probabilities[which][k], keys)
            weight, known = look(weights[which][k - 1], keys >> np.uint64(16))
            shorter, _ = look(below[which], keys & mask[k - 1])
            backed = shorter if k == 1 else np.where(known, weight, 1.0) * shorter
            value = np.where(there, value, backed)
            complete.append((keys, value))
            table.append(np.log10(np.maximum(value, 1e-12))[array.order])
            if k < order:
                weight, known = look(weights[which][k], keys)
                rest.append(np.log10(np.where(known, weight, 1.0))[array.order])
        below = complete
        arrays.append(array)
        logs.append(np.array(table, np.float32))
        backoffs.append(np.array(rest, np.float32))
    return Models(languages, arrays, logs, backoffs, np.log10(np.array(bases)).astype(np.float32), order)


def _gram(k: int) -> Column:
    """The last ``k`` units, fewer than four, of a packed n-gram."""
    return F.col("gram").bitwiseAND((1 << 16 * k) - 1)


def statistics(counted: DataFrame, order: int, discount: float = 0.75) -> list[DataFrame]:
    """``lang, gram, context, suffix, c, p, lower`` for every order from 1 on: counts, probabilities, and those of the suffix.

    ``counted`` has the n-grams of the highest order with their counts ``n``; those of lower orders count by how many
    different units stand before them.
    """
    levels = [counted.select("lang", "gram", F.col("n").cast("double").alias("c"))]
    for k in range(order - 1, 0, -1):
        longer = levels[0].select("lang", _gram(k).alias("gram"))
        levels.insert(0, pin(longer.groupBy("lang", "gram").agg(F.count("*").cast("double").alias("c")), f"lang-counts-{k}"))
    units = levels[0].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("lower"))
    out: list[DataFrame] = []
    for k, level in enumerate(levels, 1):
        level = level.select("*", F.shiftrightunsigned("gram", 16).alias("context"), _gram(k - 1).alias("suffix"))
        totals = level.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        below = units if k == 1 else out[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        rows = level.join(totals, ["lang", "context"]).join(below, "lang" if k == 1 else ["lang", "suffix"])
        p = F.greatest(F.col("c") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("lower")
        out.append(pin(rows.select("lang", "gram", "context", "suffix", "c", (p / F.col("total")).alias("p"), "lower"), f"lang-{k}"))
    discard(*levels[:-1])
    return out


def pruned(levels: list[DataFrame], max_grams: int) -> list[DataFrame]:
    """For every order and language about ``max_grams`` n-grams of the greatest counts (whole powers of two), and what longer kept ones end in."""
    kept: list[DataFrame] = []
    size = F.floor(F.log2("c")).cast("int")
    for level in reversed(levels):
        least: dict[str, int] = {}
        held: dict[str, int] = {}
        rows = level.groupBy("lang", size.alias("size")).count().collect()  # at most 63 rows a language
        for row in sorted(rows, key=lambda r: -r["size"]):
            held[row["lang"]] = held.get(row["lang"], 0) + row["count"]
            if held[row["lang"]] > max_grams and row["lang"] not in least:
                least[row["lang"]] = row["size"] + 1
        if not least:
            kept.insert(0, level)
            continue
        floors = level.sparkSession.createDataFrame(list(least.items()), "lang string, least int")
        wanted = F.coalesce(F.col("least"), F.lit(0)) <= size
        if kept:
            ends = kept[0].select("lang", F.col("suffix").alias("gram"), F.lit(True).alias("needed")).distinct()
            level = level.join(ends, ["lang", "gram"], "left")
            wanted = wanted | F.col("needed").isNotNull()
        kept.insert(0, pin(level.join(floors, "lang", "left").where(wanted).drop("least", "needed"), "lang-kept"))
    return kept


def fit(
    training: DataFrame, order: int = ORDER, max_grams: int = 250_000, calibration_rows: int = 4_000
) -> Models | None:
    """Models from all rows ``doc_id, lang, text``; None without any letter.

    Counts and probabilities cover all text. ``max_grams`` bounds, by language and order, what is sent to the driver and broadcast.
    The rejection level is the margin between best and second-best language that all but 1 in 100 of ``calibration_rows``
    training documents exceed.
    """
    counted = pin(gram_counts(training, order), "lang-grams")
    levels = statistics(counted, order)
    kept = pruned(levels, max_grams)
    # what a context keeps for other units, over what these have in the next shorter context: 1 in sum with the kept ones
    spare = [
        level.groupBy("lang", "context").agg(
            (F.greatest(1 - F.sum("p"), F.lit(1e-9)) / F.greatest(1 - F.sum("lower"), F.lit(1e-9))).alias("weight"),
            F.first("lower").alias("lower"),
        ) for level in kept
    ]
    grams = [level.select("lang", "gram", "p").toPandas() for level in kept]
    contexts = [rows.select("lang", "context", "weight", "lower").toPandas() for rows in spare]
    discard(counted, *levels, *kept)
    languages = sorted(grams[0]["lang"].unique())
    if not languages:
        return None

    def arrays(frame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        keys = frame[key].to_numpy(np.int64).view(np.uint64)
        place = np.argsort(keys)
        return keys[place], frame[value].to_numpy(float)[place]

    nothing = (np.zeros(0, np.uint64), np.zeros(0))
    probabilities, weights, bases = [], [], []
    for lang in languages:
        own = [frame[frame["lang"] == lang] for frame in grams]
        before = [frame[frame["lang"] == lang] for frame in contexts]
        probabilities.append([nothing, *[arrays(frame, "gram", "p") for frame in own]])
        weights.append([arrays(frame, "context", "weight") for frame in before])
        bases.append(float(before[0]["weight"].iloc[0] * before[0]["lower"].iloc[0]))
    models = assemble(languages, probabilities, weights, bases, order)
    if len(models.languages) > 1:
        ids = hash_sample(training.select("doc_id"), calibration_rows, "doc_id")

        def margins(batches):
            for langs, texts in blocks(batches):
                entropy, has = models.entropies(texts)
                ordered = np.sort(entropy, axis=1)
                best = [models.languages[k] for k in entropy.argmin(axis=1)]
                right = [bool(h) and lang == name for lang, name, h in zip(langs, best, has)]
                yield {"margin": ordered[:, 1] - ordered[:, 0], "right": right}

        sample = training.join(F.broadcast(ids), "doc_id").select("lang", "text")
        seen = map_batches(sample, [("margin", "double"), ("right", "boolean")], margins).where("right").toPandas()
        if len(seen):
            models.slope = float(np.log(99) / max(seen["margin"].quantile(0.05), 1e-3))
            models.reject = float(seen["margin"].quantile(0.01))
    return models


def identify(docs: DataFrame, divisor: int = 4, held: int = 2, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, entropy, accepted`` for every row of ``docs``.

    Learned from whole texts of rows with a language whose remainder is not ``held``. ``entropy`` is the lowest
    length-normalised cross-entropy, ``score`` the share of the best language under calibrated weights, ``accepted`` false
    where the margin to the next language is below the calibrated rejection level. Null texts and texts
    without a letter give ``und``, score 0. Without any learned language all rows are ``und``.
    """
    training = docs.where(F.col("lang").isNotNull() & (remainder("doc_id", divisor) != held)).select(
        "doc_id", "lang", "text"
    )
    models = fit(training, order)
    fields = [
        ("doc_id", "long"), ("lang_pred", "string"), ("score", "double"), ("entropy", "double"), ("accepted", "boolean"),
    ]

    def run(batches):
        for ids, texts in blocks(batches):
            names, scores = ["und"] * len(ids), [0.0] * len(ids)
            entropies, accepted = [None] * len(ids), [False] * len(ids)
            if models is not None:
                entropy, has = models.entropies(texts)
                best = entropy.argmin(axis=1)
                ordered = np.sort(entropy, axis=1)
                margin = ordered[:, 1] - ordered[:, 0] if entropy.shape[1] > 1 else np.full(len(ids), np.inf)
                share = 1 / np.exp(-np.minimum(models.slope * (entropy - ordered[:, :1]), 700)).sum(axis=1)
                for i in np.flatnonzero(has).tolist():
                    names[i], scores[i] = models.languages[best[i]], float(share[i])
                    entropies[i], accepted[i] = float(ordered[i, 0]), bool(margin[i] >= models.reject)
            yield {"doc_id": ids, "lang_pred": names, "score": scores, "entropy": entropies, "accepted": accepted}

    found = map_batches(docs.select("doc_id", "text"), fields, run)
    return found.withColumn("held_out", remainder("doc_id", divisor) == held)
