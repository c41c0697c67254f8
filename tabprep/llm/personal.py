"""Personal data by candidate gradient boosting, in DataFrame operations only.

Wide patterns propose overlapping spans of e-mail addresses, IP addresses, card and phone numbers. Two views of a candidate are kept
apart: its format and context are small categories, and its content passes or fails a check that does not look at them (known
endings, octets and assigned ranges, check digits with issuers, trunk digits). Boosted trees learn from all candidates how
often the check passes for a format and context; the rates, calibrated per kind and corrected for what passes by chance, select spans
beside the ones of the exact base patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.workspace import pin

KINDS = ("email", "ip", "card", "phone")

#: Base patterns (fixed forms). Groups are possessive, so that long runs neither recurse nor backtrack; what looks behind keeps
#: the search of a long run linear and allows a match right behind another (\G). A card begins where no longer run of digits does.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Wide forms of the generators: written-out addresses, other separators, numbers without a leading plus.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)|(?<= )at(?= )) ?[a-z0-9-]++"
    r"(?: ?(?:\.|\[dot\]|\(dot\)|(?<= )dot(?= )) ?[a-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?![0-9.])"
    r"|(?i)(?<![0-9a-z:])(?:(?:[0-9a-f]{1,4}+:){7}+[0-9a-f]{1,4}+"
    r"|[0-9a-f]{1,4}+(?::[0-9a-f]{1,4}+){0,5}+::(?:[0-9a-f]{1,4}+(?::[0-9a-f]{1,4}+){0,5}+)?+)(?![0-9a-z:])",
    "card": r"(?<![0-9])(?<![0-9][\x20./-])[0-9](?:[\x20./-]{0,2}[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}+[\x20.-]?)?+\(?[0-9]{2,4}+\)?[\x20./-]{1,2}[0-9]{3,4}+[\x20.-]?[0-9]{3,4}+(?![0-9])",
}
CONTEXT = 24
PERSONAL = r"(?i)(?:e-?mail|contact|write|tel|phone|call|fax|mobile|card|visa|credit|pay|\bip\b|host|server|address)[^\n]{0,12}$"
OTHER = r"(?i)(?:\bids?\b|token|key|order|\bno\b|number|version|isbn|hash|[=#\"$/])[^\n]{0,3}$"

#: Endings of host names (fixed values). Country codes that are also common words are left out.
ENDINGS = (
    "com org net edu gov mil int info biz name io dev app ai co uk de fr nl ch pl cz dk se fi es pt ie eu ru ua jp cn kr tw hk au nz "
    "ca mx br ar cl za il tr gr hu ro bg hr sk si ee lv lt test example"
).split()

#: How many candidates that are no personal data pass the check of their kind by chance, and the calibrated probability that selects.
CHANCE = {"email": 0.05, "ip": 0.3, "card": 0.07, "phone": 0.6}
PROBABILITY = 0.9

#: Categories of each feature; their product bounds the rows that reach the driver.
FEATURES = {"kind": 4, "digits": 5, "separators": 4, "before": 3, "left": 3, "right": 3, "even": 2}
SPAN = "struct<start:int,kind:int,stop:int>"
BLOCK = 256


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, state: Column, step, kind: str) -> Column:
    """What ``step(state, item)``, a struct of the next ``state`` and an ``out`` of the type ``kind``, gives along an array.

    Outputs are appended within blocks and blocks to the whole, so n items cost about n * BLOCK / 2 copied places, not n * n / 2.
    """

    def grown(so_far: Column, made: Column) -> Column:
        return _let(made, lambda r: F.struct(r["state"].alias("state"), F.concat(so_far["out"], F.array(r["out"])).alias("out")))

    def along(part: Column, first: Column, made, inner: str) -> Column:
        start = F.struct(first.alias("state"), F.array().cast(f"array<{inner}>").alias("out"))
        return F.aggregate(part, start, lambda so_far, item: grown(so_far, made(so_far["state"], item)))

    def whole(bound: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(bound), F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: F.slice(bound, at, F.lit(BLOCK)))
        return F.flatten(along(blocks, state, lambda now, block: along(block, now, step, kind), f"array<{kind}>")["out"])

    return _let(items, lambda bound: F.when(F.size(bound) > 0, whole(bound)).otherwise(F.array().cast(f"array<{kind}>")))


def _parts(text: Column, pattern: str, which: int) -> Column:
    """All matches in order, with the length of the text before each, and what stands around them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "struct<which:int,first:boolean,gap:int,size:int,match:string,left:string,right:string>"

    def beside(between: Column) -> Column:
        rows = F.zip_with(
            F.zip_with(found, between, lambda m, gap: F.struct(m.alias("match"), gap.alias("gap"))),
            F.slice(between, 2, F.size(between)),
            lambda part, after: F.struct(part["match"].alias("match"), part["gap"].alias("gap"), after.alias("after")),
        )
        return F.transform(F.filter(rows, lambda part: part["match"].isNotNull()), lambda part, i: F.struct(
            F.lit(which).alias("which"), (i == 0).alias("first"), F.char_length(part["gap"]).alias("gap"),
            F.char_length(part["match"]).alias("size"), part["match"].alias("match"),
            F.right(part["gap"], F.lit(CONTEXT)).alias("left"), F.left(part["after"], F.lit(1)).alias("right"),
        ))

    return F.when(text.rlike(pattern), _let(F.split(text, pattern, -1), beside)).otherwise(F.array().cast(f"array<{kind}>"))


def _matches(text: Column, patterns: list[str]) -> Column:
    """The matches of all patterns with their code-point places; ``which`` numbers the patterns."""

    def step(at: Column, part: Column) -> Column:
        start = F.when(part["first"], 0).otherwise(at) + part["gap"]
        placed = F.struct(
            part["which"].alias("which"), start.alias("start"), (start + part["size"]).alias("stop"), part["match"].alias("match"),
            part["left"].alias("left"), part["right"].alias("right"),
        )
        return F.struct((start + part["size"]).alias("state"), placed.alias("out"))

    parts = F.concat(*[_parts(text, pattern, which) for which, pattern in enumerate(patterns)])
    return running(parts, F.lit(0), step, "struct<which:int,start:int,stop:int,match:string,left:string,right:string>")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits: from the right, every second digit counts twice, less 9 above 9."""
    from_right = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(F.filter(doubled, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", "").rlike(
            "^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _confirmed(kind: str, match: Column) -> Column:
    """Whether the content of a candidate passes the check of its kind; format and context have no part in it."""
    digits = _digits(match)
    if kind == "email":
        return F.lower(F.regexp_extract(match, "([A-Za-z0-9-]+)$", 1)).isin(ENDINGS)
    if kind == "ip":
        four = ~match.contains(":") & _valid("ip", match) & ~match.rlike(r"^0|\.0[0-9]")
        return four | match.rlike("^(?i)(?:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]|ff[0-9a-f]{2}):")
    if kind == "card":
        return _valid("card", match) & digits.rlike("^(?:4|5|6|3[0-9]|2[2-7])")
    national = digits.rlike("^1?[2-9][0-8][0-9][2-9][0-9]{6}$") | digits.rlike("^00?[1-9][0-9]{7,12}$")
    return _valid("phone", match) & (match.rlike(r"^\+[1-9]") | (~match.startswith("+") & national))


def _edge(char: Column) -> Column:
    return F.when((char == "") | char.rlike(r"^\s$"), 0).when(char.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(1)


def _features(kind: str, span: Column) -> list[Column]:
    """The categories of one candidate, in the order of ``FEATURES``."""
    n = F.length(_digits(span["match"]))
    match, left = span["match"], span["left"]
    grouped = {
        "email": r"^[^@]+@[^@]+\.[A-Za-z]{2,6}$", "ip": r"^[1-9]", "phone": r"[0-9]{3}[^0-9]+[0-9]{3}[^0-9]?[0-9]{4}$",
        "card": r"^(?:[0-9]{4}[\x20-]?){3}[0-9]{4}$",
    }[kind]
    return [
        F.lit(KINDS.index(kind)),
        F.when(n < 8, 0).when(n < 12, 1).when(n < 16, 2).when(n == 16, 3).otherwise(4),
        F.when(match.rlike(r"^[0-9A-Za-z]+$"), 0).when(match.rlike(r"[\[(]|\b(?:at|dot)\b"), 3)
        .when(match.rlike(r"[./]"), 2).otherwise(1),
        F.when(left.rlike(PERSONAL), 1).when(left.rlike(OTHER), 2).otherwise(0),
        _edge(F.right(left, F.lit(1))), _edge(span["right"]), match.rlike(grouped).cast("int"),
    ]


@dataclass
class Boosted:
    """Depth-two trees over categories, as (feature, value, feature, value, four leaves); a threshold per kind."""

    trees: list[tuple]
    start: float
    thresholds: list[float]

    def raw(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        for f, v, g, w, leaves in self.trees:
            out += np.asarray(leaves)[2 * (rows[:, f] == v) + (rows[:, g] == w)]
        return out

    def column(self, values: list[Column]) -> Column:
        total = F.lit(self.start)
        for f, v, g, w, leaves in self.trees:
            first, second = values[f] == v, values[g] == w
            total = total + F.when(first & second, leaves[3]).when(first, leaves[2]).when(second, leaves[1]).otherwise(leaves[0])
        return total


def boost(rows: np.ndarray, good: np.ndarray, bad: np.ndarray, rounds: int = 30, rate: float = 0.3, probability: float = PROBABILITY) -> Boosted:
    """Logistic boosting on category rows with counts of confirmed and failed candidates; a threshold by calibrated probability per kind.

    Every round takes the pair of category tests with the best second-order gain.
    """
    weight = good + bad
    start = float(np.log((good.sum() + 1) / (bad.sum() + 1)))
    model = Boosted([], start, [float("inf")] * len(KINDS))
    if not len(rows):
        return model
    tests = [(f, v) for f, size in enumerate(FEATURES.values()) for v in range(size) if (rows[:, f] == v).any()]
    score = np.full(len(rows), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = good - weight * p, weight * p * (1 - p)
        best = (1e-6, None)
        for i, (f, v) in enumerate(tests):
            for g, w in tests[i:]:
                cell = 2 * (rows[:, f] == v) + (rows[:, g] == w)
                sums = np.bincount(cell, gradient, 4), np.bincount(cell, hessian, 4)
                gain = float((sums[0] ** 2 / (sums[1] + 1.0)).sum())
                if gain > best[0]:
                    best = (gain, (f, v, g, w, [float(x) for x in rate * sums[0] / (sums[1] + 1.0)]))
        if best[1] is None:
            break
        model.trees.append(best[1])
        f, v, g, w, leaves = best[1]
        score = score + np.asarray(leaves)[2 * (rows[:, f] == v) + (rows[:, g] == w)]
    for k, kind in enumerate(KINDS):
        own = rows[:, 0] == k
        model.thresholds[k] = _threshold(score[own], good[own], weight[own], CHANCE[kind], probability)
    return model


def _threshold(score: np.ndarray, good: np.ndarray, weight: np.ndarray, chance: float, probability: float) -> float:
    """The least score whose calibrated probability is high enough, or infinity.

    Rates are made to rise with the score by pooling neighbours that do not (isotonic regression), so a candidate is judged by those
    that score alike, however many others there are. One failure is added to each pool.
    """
    pools: list[list[float]] = []  # least score, confirmed, all
    for at in np.unique(score):
        same = score == at
        pools.append([float(at), float(good[same].sum()), float(weight[same].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, more, count = pools.pop()
            pools[-1][1] += more
            pools[-1][2] += count
    enough = [at for at, sure, count in pools if (sure / (count + 1) - chance) / (1 - chance) >= probability]
    return enough[0] - 1e-9 if enough else float("inf")


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    ordered = F.array_sort(spans)
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base``: the spans of the base patterns, and ``wide``: all candidates with check and categories."""
    patterns = [*BASE.values(), *WIDE.values()]
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", _matches(F.col("text"), patterns).alias("spans"))

    def placed(kind: str, s: Column, *more: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["stop"].alias("stop"), *more)

    def base(k: int, kind: str) -> Column:
        return F.transform(F.filter("spans", lambda s: (s["which"] == k) & _valid(kind, s["match"])), lambda s: placed(kind, s))

    def wide(k: int, kind: str) -> Column:
        return F.transform(F.filter("spans", lambda s: s["which"] == len(KINDS) + k), lambda s: placed(
            kind, s, _confirmed(kind, s["match"]).alias("confirmed"), F.array(*_features(kind, s)).alias("x")
        ))

    return found.select(
        "doc_id", F.concat(*[base(k, kind) for k, kind in enumerate(KINDS)]).alias("base"),
        F.concat(*[wide(k, kind) for k, kind in enumerate(KINDS)]).alias("wide"),
    )


def fit(found: DataFrame) -> Boosted:
    """Boosted trees from the counts of all candidates by category and outcome of the check."""
    counts = found.select(F.explode("wide").alias("s")).groupBy("s.x", "s.confirmed").agg(F.count("*").alias("n"))
    table: dict[tuple, list[int]] = {}
    for row in counts.collect():  # at most twice the product of the category counts
        table.setdefault(tuple(row["x"]), [0, 0])[int(row["confirmed"])] += row["n"]
    keys = sorted(table)
    rows = np.array(keys, int).reshape(-1, len(FEATURES))
    return boost(rows, np.array([table[k][1] for k in keys], float), np.array([table[k][0] for k in keys], float))


def _free(base: Column, chosen: Column) -> Column:
    """Chosen spans that overlap neither a base span nor an earlier one kept, by walks along the spans in order of their start."""
    def tagged(spans: Column, wide: int) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(wide).alias("wide"), s["kind"].alias("kind"), s["stop"].alias("stop")
        ))

    def reach(most: Column, s: Column) -> Column:
        return F.struct(F.when(s["wide"] == 0, F.greatest(most, s["stop"])).otherwise(most).alias("state"), most.alias("out"))

    def next_start(least: Column, s: Column) -> Column:
        return F.struct(F.when(s["wide"] == 0, s["start"]).otherwise(least).alias("state"), least.alias("out"))

    def outside(spans: Column) -> Column:
        before = running(spans, F.lit(0), reach, "int")
        after = F.reverse(running(F.reverse(spans), F.lit(2**31 - 1), next_start, "int"))
        limits = F.zip_with(before, after, lambda b, a: F.struct(b.alias("before"), a.alias("after")))
        both = F.zip_with(spans, limits, lambda s, limit: F.struct(s.alias("s"), limit.alias("limit")))
        kept = F.filter(both, lambda r: (
            (r["s"]["wide"] == 1) & (r["limit"]["before"] <= r["s"]["start"]) & (r["limit"]["after"] >= r["s"]["stop"])
        ))
        return F.transform(kept, lambda r: F.struct(
            r["s"]["start"].alias("start"), r["s"]["kind"].alias("kind"), r["s"]["stop"].alias("stop")
        ))

    def keep(stop: Column, s: Column) -> Column:
        return F.struct(
            F.when(s["start"] >= stop, s["stop"]).otherwise(stop).alias("state"), F.when(s["start"] >= stop, s).alias("out")
        )

    ordered = F.array_sort(F.concat(tagged(base, 0), tagged(chosen, 1)))
    walked = running(_let(ordered, outside), F.lit(0), keep, SPAN)
    return F.when(F.size(chosen) > 0, F.filter(walked, lambda s: s.isNotNull())).otherwise(F.array().cast(f"array<{SPAN}>"))


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row of ``docs``.

    Base spans always stay. A candidate is added if its content passes the check of its kind, its boosted score reaches the
    threshold of that kind, and it overlaps neither a base span nor an earlier added one. Null and empty texts have no spans; repeated
    rows each give a row; other columns are ignored; a corpus without candidates adds none. Texts are read once: candidates go
    to the shared folder, and the model is fitted to their counts.
    """
    found = pin(candidates(docs), "personal-candidates")
    model = fit(found)
    limit = F.array(*[F.lit(t) for t in model.thresholds])
    chosen = F.filter("wide", lambda s: s["confirmed"] & (
        model.column([F.get(s["x"], F.lit(i)) for i in range(len(FEATURES))]) >= F.get(limit, s["kind"])
    ))
    small = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    added = _let(small, lambda spans: _free(F.col("base"), spans))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", "base", added.alias("added")).select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
