"""Splits that keep related records together: components by hooking and shortcutting, totals by subset sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.lineage import drop, materialise
from .same_question import class_pairs, classes_of, word_rows


def components(edges: DataFrame) -> DataFrame:
    """node, root for the undirected edges (u, v): two nodes have one root if they are connected.

    Each round hooks every node below its least neighbour, in an order given by a bijective hash, and shortcuts parents
    twice, all in joined tables; then the edges are drawn between parents, so finished components and inner edges are
    gone and a hub has one edge for each component left beside it. Each round is written out: a lost executor repeats
    one at most. The number of rounds follows the logarithm of the longest path. Self loops stand for lone nodes.
    """
    # xxhash64 of one bigint maps no two to one, so an order of hashes ties nothing and follows no order of the data
    mix = lambda c: F.xxhash64(F.col(c))
    nodes = materialise(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    left = materialise(edges.where("u <> v").select(mix("u").alias("u"), mix("v").alias("v")), "edges")
    levels: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        for _ in range(2):
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("u", F.col("pp").alias("p"))
        parent = materialise(parent, "parent")
        levels.append(parent)
        on = lambda c: parent.select(F.col("u").alias(c), F.col("p").alias("p" + c))
        drawn = left.join(on("u"), "u").join(on("v"), "v").where("pu <> pv")
        redrawn = materialise(drawn.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        drop(left)
        left = redrawn
    # from the last level, the smallest, down: the root of a node is that of its parent
    root: DataFrame | None = None
    for parent in reversed(levels):
        if root is None:
            root = parent.select("u", F.col("p").alias("root"))
            continue
        above = root.select(F.col("u").alias("p"), "root")
        whole = materialise(parent.join(above, "p", "left").select("u", F.coalesce("root", "p").alias("root")), "roots")
        drop(root, parent)
        root = whole
    if root is None:
        return nodes.select("node", mix("node").alias("root"))
    return nodes.join(root, mix("node") == F.col("u"), "left").select("node", F.coalesce("root", mix("node")).alias("root"))


def related_records(rows: DataFrame, contests: DataFrame) -> DataFrame:
    """pair_id, component, members, lead_data_id: records tied by question, data_id or credited contest problem.

    Relations chain. members counts the records of the component; lead_data_id is its smallest data_id, null if none
    has one. A record without question, data_id and credit is a component of its own, with a null component.
    """
    words = materialise(word_rows(rows, contests), "words")
    # a record stands for its wording; without one for its data_id, then for its credit
    by_id, by_credit = F.xxhash64(F.lit("data_id"), "data_id"), F.xxhash64(F.lit("credit"), "credit")
    node = F.when(F.col("klass").isNotNull(), F.col("klass")).when(F.col("data_id").isNotNull(), by_id).when(F.col("credit").isNotNull(), by_credit)
    ties = words.select(node.alias("node"), "data_id", "credit").where("node is not null").groupBy("node", "data_id", "credit").agg(F.count("*").alias("n"))
    ties = materialise(ties, "ties")
    yes = F.lit(True)
    found = class_pairs(classes_of(words, yes, yes), symmetric=True).select(F.col("klass_a").alias("u"), F.col("klass_b").alias("v"))
    edges = (
        ties.where("data_id is not null").select(F.col("node").alias("u"), by_id.alias("v"))
        .unionByName(ties.where("credit is not null").select(F.col("node").alias("u"), by_credit.alias("v")))
        .unionByName(found)
        .unionByName(ties.select(F.col("node").alias("u"), F.col("node").alias("v")))
    )
    roots = components(edges)
    tied = ties.join(roots, "node")
    whole = tied.groupBy("root").agg(F.sum("n").alias("members"), F.min("data_id").alias("lead_data_id"))
    by_node = tied.select("node", "root").distinct().join(whole, "root")
    out = words.select("pair_id", "data_id", node.alias("node")).join(by_node, "node", "left")
    return out.select("pair_id", F.col("root").alias("component"), F.coalesce("members", F.lit(1)).cast("bigint").alias("members"), "lead_data_id")


#: Records that a subset sum at the least sizes may reach before larger ones are left alone; some four bytes each.
CORE = 1 << 22


def _subset_sum(sizes: dict[int, int], goal: int) -> dict[int, int]:
    """The number of items of each size whose total is closest to goal, of equals the smaller total.

    Each multiplicity is cut into powers of two, a bitset holds the sums that can be reached, and each sum keeps the
    part that first reached it, from which the choice is read back.
    """
    parts, filled = [], 0
    for size, n in sorted(sizes.items(), reverse=True):
        filled += size * min(n, (goal - filled) // size)
        k = 1
        while n > 0:
            parts.append((size, min(k, n)))
            n -= min(k, n)
            k *= 2
    # a sum of filled is within reach, so the closest is no farther on the other side
    most = 2 * goal - filled
    bits, first = 1, np.full(most + 1, -1, np.int32)
    for i, (size, n) in enumerate(parts):
        if size * n <= most and (new := bits << size * n & (1 << most + 1) - 1 & ~bits):
            raw = np.frombuffer(new.to_bytes(most // 8 + 1, "little"), np.uint8)
            at = np.flatnonzero(raw)
            byte, bit = np.nonzero(np.unpackbits(raw[at, None], axis=1, bitorder="little"))
            first[at[byte] * 8 + bit] = i
            bits |= new
    near = next(x for d in range(goal + 1) for x in (goal - d, goal + d) if x == 0 or x <= most and first[x] >= 0)
    took: dict[int, int] = {}
    while near:
        size, n = parts[first[near]]
        near -= size * n
        took[size] = took.get(size, 0) + n
    return took


def _closest(sizes: dict[int, int], goal: int, core: int = CORE) -> dict[int, int]:
    """As _subset_sum, but large components are laid down first and a subset sum over the small ones hits the goal.

    A total that is hit needs no further search, and that needs no more memory than the core. Only where the core can't
    hit it the sums of all components are searched.
    """
    small: dict[int, int] = {}
    held = 0
    for size, n in sorted(sizes.items()):
        if (k := min(n, (core - held) // size)) <= 0:
            break
        small[size] = k
        held += size * k
    if small == sizes:
        return _subset_sum(sizes, goal)
    took: dict[int, int] = {}
    rest = goal
    for size, n in sorted(sizes.items(), reverse=True):
        # what the small components hold is left to them
        if k := min(n - small.get(size, 0), max(0, rest - held // 2) // size):
            took[size] = k
            rest -= size * k
    if rest <= held:
        for size, n in _subset_sum(small, rest).items():
            took[size] = took.get(size, 0) + n
        if sum(s * n for s, n in took.items()) == goal:
            return took
    return _subset_sum(sizes, goal)


def closest_totals(sizes: dict[int, int], shares: list[float]) -> list[dict[int, int]]:
    """How many components of each size go to each share but the first, so that its total is as close as can be.

    Exact at every size. A tie goes to the smaller total.
    """
    left, total, out = dict(sizes), sum(s * n for s, n in sizes.items()), []
    for share in shares[1:]:
        took = _closest({s: n for s, n in left.items() if n}, round(share * total))
        for size, n in took.items():
            left[size] -= n
        out.append(took)
    return out


def assign_splits(related: DataFrame, shares: dict[str, float] | None = None, rank_rows: int = 100_000) -> DataFrame:
    """pair_id, component, split: whole components, totals as close to the shares as subset sums allow.

    related: as related_records returns it. The first share takes what the others leave. The histogram of component
    sizes reaches the driver (at most the root of twice the rows), then the counts of hash buckets: components of one
    size are ranked in buckets of some rank_rows, however many there are.
    """
    shares = shares or {"train": 0.9, "validation": 0.05, "test": 0.05}
    lone = F.xxhash64(F.lit("lone"), "pair_id")
    keyed = related.select("pair_id", F.coalesce("component", lone).alias("component"), F.when(F.col("component").isNull(), 1).otherwise(F.col("members")).alias("members"))
    whole = materialise(keyed.groupBy("component").agg(F.max("members").alias("members")), "components")
    sizes = {r[0]: r[1] for r in whole.groupBy("members").count().collect()}
    names, took = list(shares), closest_totals(sizes, list(shares.values()))
    spark = related.sparkSession
    # a row a size: at most the root of twice the rows
    of_size = spark.createDataFrame([(s, -(-n // rank_rows)) for s, n in sizes.items()], "members bigint, buckets bigint")
    whole = whole.join(of_size, "members").withColumn("bucket", F.pmod(F.xxhash64("component"), "buckets")).drop("buckets")
    cuts, left = [], [dict(t) for t in took]
    for size, bucket, n in sorted(tuple(r) for r in whole.groupBy("members", "bucket").count().collect()):
        at = 0
        for name, quota in zip(names[1:], left):
            if k := min(n - at, quota.get(size, 0)):
                quota[size] -= k
                cuts.append((size, bucket, name, at, at + k))
                at += k
    plan = spark.createDataFrame(cuts, "members bigint, bucket bigint, split string, from_ bigint, to_ bigint")
    rank = F.row_number().over(Window.partitionBy("members", "bucket").orderBy("component")) - 1
    ranked = whole.withColumn("rank", rank)
    chosen = ranked.join(plan, (ranked.members == plan.members) & (ranked.bucket == plan.bucket) & (F.col("rank") >= F.col("from_")) & (F.col("rank") < F.col("to_")), "left").select("component", F.coalesce("split", F.lit(names[0])).alias("split"))
    return keyed.join(chosen, "component").select("pair_id", "component", "split")
