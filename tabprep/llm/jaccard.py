"""N-gram Jaccard join with a token-group matrix.

Documents are reduced to distinct sets of shingle hashes. Similar sets are put into groups of bounded size; a group is known
by the union of its members' tokens. The matrix holds a row for each (token, group); from it follows how many
tokens two groups can share at most. Only pairs of groups whose bound reaches the threshold are opened and their
members compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import STEP, blocks, components, map_batches, mix
from tabprep.workspace import discard, pin

#: Cells of the frequency sketch that orders tokens from rare to frequent. Any order gives the same links.
SKETCH_BITS = 21
#: A group holds at most about this many sets, and this many tokens.
GROUP = 200
GROUP_TOKENS = 500_000
#: A token in more groups than this is not paired out; its groups form a cluster instead.
PAIRED = 32


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    size = min(width, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * STEP + hashes[k : k + len(out)]
    return np.unique(mix(out + np.uint64(size)))


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Order of magnitude of the document frequency by cell, in eighths of powers of two, over all documents.

    Every task sends one array of fixed size in slices. Spark adds up each slice in two steps, first of as many tasks as there are
    such sums to add in the second, so that neither step holds more than the square root of the tasks' arrays.
    """
    step = 1 << 14
    parts = max(math.isqrt(docs.rdd.getNumPartitions()), 1)

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for (texts,) in blocks(batches):
            np.add.at(total, cell(np.concatenate([shingles(text, width) for text in texts])), 1)
        if total.any():
            rows = np.minimum(total, 65535).astype(np.uint16).reshape(-1, step)
            yield {"slice": list(range(len(rows))), "counts": [row.tobytes() for row in rows]}

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, np.int64)
        for row in frame["counts"]:
            total += np.frombuffer(row, np.uint16 if len(row) == 2 * step else np.int64)  # of a task, or a sum already
        return pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})

    sent = map_batches(docs.select("text"), [("slice", "int"), ("counts", "binary")], run)
    sent = sent.withColumn("part", F.spark_partition_id() % parts)
    summed = sent.groupBy("slice", "part").applyInPandas(add, "slice int, counts binary")
    summed = summed.groupBy("slice").applyInPandas(add, "slice int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint16)
    for row in summed.toLocalIterator():  # a fixed 16 MB in all
        counts = np.frombuffer(row["counts"], np.int64)
        out[row["slice"] * step : (row["slice"] + 1) * step] = 8 * np.log2(counts + 1)
    return out


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` must share with any partner."""
    return -(-percent * n // 100)


def shared_in_prefix(n: int, percent: int) -> int:
    """Tokens that two linked sets of at least ``n`` share at least within their prefixes."""
    return max(1, min(n // 10, least_overlap(n, percent)))


def rare_prefix(tokens: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The rarest tokens: so many that linked sets share ``shared_in_prefix`` of the smaller one."""
    n = len(tokens)
    size = min(n, n - least_overlap(n, percent) + shared_in_prefix(n, percent))
    return tokens[np.lexsort((tokens, sketch[cell(tokens)]))[:size]]


def set_hash(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on sorted distinct tokens."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (n + m - shared)


def _marks(docs: DataFrame, sketch, width: int, percent: int) -> DataFrame:
    """``doc_id, n, set_id, need, prefix`` of every row; ``need``: prefix tokens it shares with any partner."""
    fields = [("doc_id", "long"), ("n", "long"), ("set_id", "long"), ("need", "long"), ("prefix", "array<long>")]

    def run(batches):
        for ids, texts in blocks(batches):
            rows = []
            for key, text in zip(ids, texts):
                tokens = shingles(text, width)
                n = len(tokens)
                prefix = rare_prefix(tokens, sketch.value, percent) if n else tokens
                need = shared_in_prefix(least_overlap(n, percent), percent)
                rows.append((key, n, set_hash(tokens) if n else None, need, prefix.view(np.int64)))
            columns = {name: list(column) for (name, _), column in zip(fields, zip(*rows))}
            yield columns

    return map_batches(docs.select("doc_id", "text"), fields, run)


def _suspects(marks: DataFrame) -> DataFrame:
    """``doc_key`` of one document of every set that shares as many prefix tokens with others as a link takes."""
    postings = marks.select("set_id", F.explode("prefix").alias("token"))
    own = postings.groupBy("token").agg(F.min("set_id").alias("set_id"), F.max("set_id").alias("other"))
    alone = own.where("set_id = other").groupBy("set_id").agg(F.count("*").alias("alone"))
    sets = marks.where("n > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.first("need").alias("need"), F.first(F.size("prefix")).alias("size")
    )
    return sets.join(alone, "set_id", "left").where(
        F.col("size") - F.coalesce("alone", F.lit(0)) >= F.col("need")
    ).select(F.col("doc_id").alias("doc_key"))


def _sets(docs: DataFrame, suspects: DataFrame, sketch, width: int, percent: int) -> DataFrame:
    """``set_id, n, need, key_a, key_b, prefix, tokens`` of every suspect set, once, and of sets without an id.

    Documents are chosen by a join with the ids of suspects, which Spark broadcasts where they are few. The keys are minima under
    other hash orders, by which similar sets meet in a group.
    """
    fields = [
        ("set_id", "long"), ("n", "long"), ("need", "long"), ("key_a", "long"), ("key_b", "long"),
        ("prefix", "array<long>"), ("tokens", "array<long>"),
    ]

    def run(batches):
        for (texts,) in blocks(batches):
            rows = []
            for text in texts:
                tokens = shingles(text, width)
                if not len(tokens):
                    continue
                second, third = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), mix(tokens ^ np.uint64(0x14057B7EF767814F))
                key_a = int((second.min() ^ mix(third.min()[None])[0]).astype(np.int64))
                key_b = int(mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)).min().astype(np.int64))
                prefix = rare_prefix(tokens, sketch.value, percent)
                rows.append((set_hash(tokens), len(tokens), shared_in_prefix(len(tokens), percent), key_a, key_b,
                             prefix.view(np.int64), tokens.view(np.int64)))
            if rows:
                yield {name: list(column) for (name, _), column in zip(fields, zip(*rows))}

    known = suspects.where("doc_key is not null").distinct()
    chosen = docs.join(known, F.col("doc_id") == F.col("doc_key"), "left_semi").select("text")
    chosen = chosen.unionByName(docs.where("doc_id is null").select("text"))
    return map_batches(chosen, fields, run).dropDuplicates(["set_id"])


def _tokens(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(row, np.int64).view(np.uint64) for row in column]


def _parts(members: str, size: str):
    """In how many parts so many sets with so many tokens are dealt."""
    return F.ceil(F.greatest(F.col(members) / GROUP, F.col(size) / GROUP_TOKENS)).cast("long")


def _groups(sets: DataFrame, key: str, percent: int) -> DataFrame:
    """``set_id, root``: sets of equal key, in groups of about ``GROUP``, merged where links connect them.

    A key with more sets is dealt over several groups by hash; what links these is found later.
    """
    counts = sets.groupBy(key).agg(F.count("*").alias("members"), F.sum("n").alias("size")).where("members > 1")
    part = F.pmod(F.xxhash64("set_id"), _parts("members", "size"))
    # grouped by one number made of key and part: partitioning by the key alone would bring all parts of it to one task
    dealt = sets.join(pin(counts, "jaccard-keys"), key).withColumn("cell", F.xxhash64(key, part))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "set_id"])
        tokens, ids = _tokens(frame["tokens"]), frame["set_id"].tolist()
        root = list(range(len(ids)))
        for i in range(len(ids)):
            for j in range(i):
                if root[i] != root[j] and linked(tokens[i], tokens[j], percent):
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        return pd.DataFrame({"set_id": ids, "root": [ids[r] for r in root]})

    return dealt.select("cell", "set_id", "n", "tokens").groupBy("cell").applyInPandas(run, "set_id long, root long")


def _clusters(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """``group, cluster``: groups that may hold linked members and are not connected yet, with all they may link to.

    The matrix holds a row for each prefix token and group. Groups with enough common tokens share a cluster, and so
    do all groups of a token of many groups, by one row each.
    """
    member = sets.select("set_id", "need", "prefix").join(groups, "set_id")
    need = member.groupBy("group").agg(F.min("need").alias("need"))
    matrix = pin(member.select(F.explode("prefix").alias("token"), "group", "component").distinct(), "jaccard-matrix")
    tokens = matrix.groupBy("token").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("k"), F.min("group").alias("low")
    ).where("x <> y")
    light = matrix.join(tokens.where(F.col("k") <= PAIRED).select("token"), "token")
    left = light.select("token", F.col("group").alias("a"), F.col("component").alias("ca"))
    right = light.select("token", F.col("group").alias("b"), F.col("component").alias("cb"))
    shared = left.join(right, "token").where("a < b and ca <> cb").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = (
        shared.join(need.select(F.col("group").alias("a"), F.col("need").alias("na")), "a")
        .join(need.select(F.col("group").alias("b"), F.col("need").alias("nb")), "b")
        .where(F.col("shared") >= F.least("na", "nb")).select("a", "b")
    )
    heavy = tokens.where(F.col("k") > PAIRED).select("token", "low")
    stars = matrix.join(heavy, "token").select(F.col("group").alias("a"), F.col("low").alias("b")).distinct()
    found = components(pairs.unionByName(stars), "jaccard-clusters")
    return found.select(F.col("node").alias("group"), F.col("component").alias("cluster"))


def _open(clusters: DataFrame, sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between groups of a cluster. Large clusters are dealt over blocks, and every pair of blocks is a task's group."""
    member = sets.select("set_id", "n").join(groups, "set_id").join(clusters, "group")
    sizes = member.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("size"))
    dealt = member.join(sizes, "cluster").withColumn("parts", _parts("members", "size")).select(
        "set_id", "group", "component", "cluster", "parts", F.pmod(F.xxhash64("group"), F.col("parts")).alias("part")
    )
    rows = sets.select("set_id", "need", "prefix", "tokens").join(dealt, "set_id").withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    ).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("set_id")
        names, place = np.unique(frame["group"].to_numpy(), return_inverse=True)
        tokens, prefixes = _tokens(frame["tokens"]), _tokens(frame["prefix"])
        members: list[list[np.ndarray]] = [[] for _ in names]
        need, part = np.full(len(names), 1 << 60), np.zeros(len(names), np.int64)
        root: dict[int, int] = {}
        component = np.zeros(len(names), np.int64)
        for i, g in enumerate(place):
            members[g].append(tokens[i])
            need[g] = min(need[g], frame["need"].iat[i])
            part[g], component[g] = frame["part"].iat[i], frame["component"].iat[i]

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        # the token-group matrix of this block: common prefix tokens bound what two groups share
        _, column = np.unique(np.concatenate(prefixes), return_inverse=True)
        owner = np.repeat(place, [len(p) for p in prefixes])
        cells = np.unique(np.column_stack([column, owner]), axis=0)
        counts = np.bincount(cells[:, 0])
        cells = cells[counts[cells[:, 0]] > 1]
        used, column = np.unique(cells[:, 0], return_inverse=True)
        bound = np.zeros((len(names), len(names)), np.float32)
        for at in range(0, len(used), 4096):
            chosen = (column >= at) & (column < at + 4096)
            matrix = np.zeros((len(names), min(4096, len(used) - at)), np.float32)
            matrix[cells[chosen, 1], column[chosen] - at] = 1
            bound += matrix @ matrix.T
        maybe = np.triu(bound >= np.minimum(need[:, None], need[None, :]), 1)
        maybe &= component[:, None] != component[None, :]
        if key[1] != key[2]:
            maybe &= part[:, None] != part[None, :]
        a, b = np.nonzero(maybe)
        order = np.argsort(-bound[a, b], kind="stable")
        unions: dict[int, np.ndarray] = {}
        links = []
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            cx, cy = find(int(component[x])), find(int(component[y]))
            if cx != cy and _group_link(members, unions, x, y, percent):
                root[cx] = cy
                links.append((names[x], names[y]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    wanted = rows.select("cluster", "low", "high", "set_id", "group", "component", "part", "need", "prefix", "tokens")
    cell = F.xxhash64("cluster", "low", "high").alias("cell")  # one number, as in ``_groups``
    return wanted.groupBy(cell, "cluster", "low", "high").applyInPandas(lambda key, rows: run(key[1:], rows), "a long, b long")


def _group_link(members: list[list[np.ndarray]], unions: dict[int, np.ndarray], x: int, y: int, percent: int) -> bool:
    """Whether a member of one group links to one of another: opened only for members whose overlap with the union reaches it."""
    if len(members[y]) == 1:
        x, y = y, x
    if y not in unions:
        unions[y] = np.unique(np.concatenate(members[y]))
    union = unions[y]
    for query in members[x]:
        place = np.minimum(np.searchsorted(union, query), len(union) - 1)
        if int((union[place] == query).sum()) >= least_overlap(len(query), percent):
            if any(linked(query, other, percent) for other in members[y]):
                return True
    return False


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    A row's set is its distinct word n-grams of ``width`` lower-cased words (of all words, if fewer). Rows link when
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id reachable. Null and empty texts
    have no shingles and only themselves. Rows of equal sets are one; a row without an id takes part and gets the smallest id of its
    component, null if there is none. Rows that share an id are told apart by their sets. Other columns are ignored.

    Sets are compared by 64-bit hashes of shingles. Copies meet by the hash of their set; no pairs are made of
    them, nor of near copies that a group has already connected.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs, width))
    prefixes = pin(_marks(docs, sketch, width, percent), "jaccard-prefixes")
    suspects = pin(_suspects(prefixes), "jaccard-suspects")
    marks = pin(prefixes.select("doc_id", "n", "set_id"), "jaccard-marks")
    discard(prefixes)
    sets = pin(_sets(docs, suspects, sketch, width, percent), "jaccard-sets")
    sketch.unpersist()
    first = pin(_groups(sets, "key_a", percent), "jaccard-groups")
    members = pin(
        sets.select("set_id").join(first, "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("group")),
        "jaccard-members",
    )
    leaders = sets.join(members.where("set_id = group").select("set_id"), "set_id", "left_semi")
    second = _groups(leaders, "key_b", percent)
    edges = pin(
        members.select(F.col("set_id").alias("a"), F.col("group").alias("b")).unionByName(
            second.select(F.col("set_id").alias("a"), F.col("root").alias("b"))
        ).where("a <> b"), "jaccard-edges",
    )
    known = components(edges, "jaccard-known")
    groups = pin(
        members.join(known.withColumnRenamed("node", "set_id"), "set_id", "left").select(
            "set_id", "group", F.coalesce("component", "set_id").alias("component")
        ), "jaccard-connected",
    )
    discard(suspects, first, members)
    clusters = pin(_clusters(sets, groups), "jaccard-cluster-rows")
    more = _open(clusters, sets, groups, percent)
    linked_sets = pin(components(edges.unionByName(more), "jaccard-linked"), "jaccard-components")
    discard(sets, groups, clusters, edges)
    smallest = pin(marks.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("smallest")), "jaccard-smallest")
    reached = linked_sets.withColumnRenamed("node", "set_id").join(smallest, "set_id")
    lowest = pin(reached.groupBy("component").agg(F.min("smallest").alias("lowest")), "jaccard-lowest")
    lowest = linked_sets.withColumnRenamed("node", "set_id").join(lowest, "component").select("set_id", "lowest")
    final = pin(
        smallest.join(lowest, "set_id", "left").select("set_id", F.coalesce("lowest", "smallest").alias("component_id")),
        "jaccard-final",
    )
    with_words = marks.where("n > 0").join(final, "set_id").select("doc_id", "n", "component_id")
    without = marks.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return with_words.unionByName(without).withColumnRenamed("n", "n_shingles")
