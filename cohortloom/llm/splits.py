"""Train, validation and test splits that keep tied records together.

Rows are tied by equal known ``subject_id`` or ``hadm_id``, also through other rows. The ties are a bipartite
graph of key values; its connected components come from alternating star contraction on distinct edges. The
allocation bundles components of identical size and label profile, routes the bundles through a min-cost flow
to the split quotas, rounds it to whole components, and assigns members of a bundle by hash order.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortloom.session import materialise

SPLITS = ("train", "val", "test")
#: Rounds after which star contraction must have converged; each halves the longest remaining path.
MAX_ROUNDS = 60
#: Groups in one hash range bucket of a bundle, on average, if all were in one bundle.
BUCKET_GROUPS = 20_000


def recorded_split(column: str = "split") -> Column:
    """The recorded split without letter case, outer blanks and the long spelling; blank and null are none."""
    word = F.lower(F.regexp_replace(F.col(column), r"^[\s ]+|[\s ]+$", ""))
    return F.when(word == "", None).when(word == "validation", "val").otherwise(word)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` of undirected ``edges(u, v)``: the smallest node of each component.

    Alternates large-star (each node's larger neighbours link to its smallest) and small-star (each node's
    smaller-or-equal neighbours link to its smallest) until no edge changes. Each step is one combined
    ``min`` per node and one join whose build side has a row per node, so a hub is never gathered; the state
    is written to the shared folder after each round. Self-loops keep single nodes. An empty input is empty.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both if large else both.where("v <= u")
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        linked = around.join(least, "u").where("v > u" if large else "true")
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out if large else out.unionByName(least.select("u", F.col("m").alias("v")))

    state = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = state.select("u").unionByName(state.select(F.col("v").alias("u"))).distinct()
    for _ in range(MAX_ROUNDS):
        # done when every node has one parent and no parent has a parent itself
        ends = state.where("u <> v").select("u", F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(state.where("u <> v").select(F.col("v").alias("u"), F.lit(0).alias("c"), F.lit(1).alias("p")))
        if ends.groupBy("u").agg(F.sum("c").alias("c"), F.max("p").alias("p")).where("c > 1 OR (c > 0 AND p > 0)").isEmpty():
            break
        after_large = star(state, True).unionByName(state.where("u = v")).distinct()
        state = materialise(star(after_large, False).where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("star contraction did not converge")
    state = state.where("u <> v")
    return nodes.join(state, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))


def tied_groups(rows: DataFrame, keys: tuple[str, str] = ("subject_id", "hadm_id"), row_id: str = "row_id") -> DataFrame:
    """``row_id, group_id`` of every row; ``group_id`` is the smallest row id of the tied group.

    Null keys and keys below 1 tie nothing; a row without known keys is a group of its own. Repeated rows
    with different ids stay separate members. Each value of the second key is first contracted to the smallest
    first-key value seen with it, so the graph that star contraction works on has only the second-key values
    that join several first-key values. Rows of a hot key are joined to one root row each.
    """
    one, two = (F.when(F.col(k) >= 1, F.col(k).cast("long")) for k in keys)
    known = rows.select(row_id, one.alias("a"), two.alias("b"))
    pairs = known.where("b IS NOT NULL").groupBy("a", "b").agg(F.lit(1).alias("x")).drop("x")
    hub = pairs.groupBy("b").agg(F.min("a").alias("m"))
    kind = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))
    chained = pairs.where("a IS NOT NULL").join(hub, "b").where("a <> m").select(kind(0, "a").alias("u"), kind(0, "m").alias("v")).distinct()
    roots = connected_components(chained)
    # a row's node: its first key, else the first key its second key was contracted to, else the second key itself
    only_b = known.where("a IS NULL AND b IS NOT NULL").join(hub, "b", "left").select(row_id, F.when(F.col("m").isNotNull(), kind(0, "m")).otherwise(kind(1, "b")).alias("node"))
    noded = known.where("a IS NOT NULL").select(row_id, kind(0, "a").alias("node")).unionByName(only_b)
    grouped = noded.join(roots, "node", "left").select(row_id, F.coalesce("root", "node").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min(row_id).alias("group_id"))
    alone = known.where("a IS NULL AND b IS NULL").select(row_id, F.col(row_id).alias("group_id"))
    return grouped.join(smallest, "root").select(row_id, "group_id").unionByName(alone)


def conflicting_groups(rows: DataFrame, keys: Sequence[str] = ("subject_id", "hadm_id"), row_id: str = "row_id", split: str = "split") -> DataFrame:
    """``row_id, group_id``: all rows of the groups whose recorded splits already disagree."""
    groups = materialise(tied_groups(rows, keys, row_id).join(rows.select(row_id, recorded_split(split).alias("_s")), row_id), "groups")
    bad = groups.groupBy("group_id").agg(F.min("_s").alias("lo"), F.max("_s").alias("hi")).where("lo <> hi").select("group_id")
    return groups.join(bad, "group_id", "left_semi").select(row_id, "group_id")


def _flow(bundles: Sequence[tuple[int, int, tuple[int, ...]]], quota: Sequence[int]) -> list[list[float]]:
    """Rows of each bundle sent to each split: successive shortest paths over source, bundles, splits, sink.

    ``bundles``: (size, count, recorded rows of one component by split). The cost of a row is the share of its
    component recorded elsewhere, so agreeing with records is free. Quotas add up to all rows. Heaps keep the cheapest choices, so
    the work is about bundles times their logarithm.
    """
    n, m = len(bundles), len(quota)
    left = [float(s * c) for s, c, _ in bundles]
    room = [float(q) for q in quota]
    sent = [[0.0] * m for _ in range(n)]
    cost = [[(sum(p) - p[j]) / s for j in range(m)] for s, _, p in bundles]
    # cheapest bundle for each split, and cheapest bundle to move from one split to another; entries that no longer hold are dropped at the top
    fresh = [[(cost[i][j], i) for i in range(n) if left[i] > 0] for j in range(m)]
    moves: list[list[list[tuple[float, int]]]] = [[[] for _ in range(m)] for _ in range(m)]
    for heap in fresh:
        heapq.heapify(heap)

    def top(heap: list[tuple[float, int]], holds: Callable[[int], bool]) -> tuple[float, int] | None:
        while heap and not holds(heap[0][1]):
            heapq.heappop(heap)
        return heap[0] if heap else None

    def send(i: int, j: int, amount: float) -> None:
        if sent[i][j] <= 0 < amount:
            for b in range(m):
                if b != j:
                    heapq.heappush(moves[j][b], (cost[i][b] - cost[i][j], i))
        sent[i][j] += amount

    remaining = sum(left)
    while remaining > 0.5:
        dist = [top(heap, lambda i: left[i] > 0) for heap in fresh]
        best, came = [d for d, _ in dist], [("from", i) for _, i in dist]
        for _ in range(m):  # a split may be reached by moving rows of a bundle there from another split
            for a in range(m):
                for b in range(m):
                    move = top(moves[a][b], lambda i, a=a: sent[i][a] > 0) if a != b else None
                    if move and best[a] + move[0] < best[b] - 1e-12:
                        best[b], came[b] = best[a] + move[0], ("move", move[1], a)
        goal = min((best[j], j) for j in range(m) if room[j] > 0)[1]
        path, at = [], goal
        while came[at][0] == "move":
            path.append((came[at][1], came[at][2], at))
            at = came[at][2]
        start = came[at][1]
        amount = min([left[start], room[goal], *(sent[i][a] for i, a, _ in path)])
        left[start] -= amount
        remaining -= amount
        room[goal] -= amount
        send(start, at, amount)
        for i, a, b in path:
            sent[i][a] -= amount
            send(i, b, amount)
    return sent


def allocate(bundles: Sequence[tuple[int, int, tuple[int, ...]]], shares: Sequence[float]) -> list[list[int]]:
    """Components of each bundle for each split: the flow, rounded down to whole components, and the rest by need.

    The remaining components, largest first, go to the split with the most rows still missing. The deviation
    from a quota is then at most the size of one component, unless one component exceeds its quota.
    """
    total = sum(s * c for s, c, _ in bundles)
    quota = [int(total * f) for f in shares]
    quota[0] += total - sum(quota)
    sent = _flow(bundles, quota) if total else []
    whole = [[int((x + 1e-6) // s) for x in row] for row, (s, _, _) in zip(sent, bundles, strict=True)]
    need = [(-(q - sum(w[j] * s for w, (s, _, _) in zip(whole, bundles, strict=True))), j) for j, q in enumerate(quota)]
    heapq.heapify(need)
    for i in sorted(range(len(bundles)), key=lambda i: -bundles[i][0]):
        size, count, _ = bundles[i]
        for _ in range(count - sum(whole[i])):
            missing, j = heapq.heappop(need)
            whole[i][j] += 1
            heapq.heappush(need, (missing + size, j))
    return whole


def assign_splits(
    rows: DataFrame,
    shares: Sequence[float] = (0.8, 0.1, 0.1),
    names: Sequence[str] = SPLITS,
    keys: Sequence[str] = ("subject_id", "hadm_id"),
    row_id: str = "row_id",
    split: str = "split",
) -> DataFrame:
    """``row_id, group_id, assigned_split`` for every row, whole groups in one split.

    Only the bundle table reaches the driver: one row per distinct (size, label profile). Profiles are the
    recorded rows by split rounded to quarters of the size, and distinct sizes number at most the square root
    of twice the rows, so it is far below the number of components, none of which is collected. Members of a
    bundle get their split by position in hash order, from a window within the bundle's hash range buckets.
    """
    groups = materialise(tied_groups(rows, keys, row_id).join(rows.select(row_id, recorded_split(split).alias("_s")), row_id), "groups")
    per = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), *(F.count_if(F.col("_s") == n).alias(f"r_{n}") for n in names))
    quarters = [F.round(4 * F.col(f"r_{n}") / F.col("size")).cast("int").alias(f"q_{n}") for n in names]
    profiled = materialise(per.select("group_id", "size", *quarters), "profiles")
    bundle = ["size", *(f"q_{n}" for n in names)]
    buckets = max(16, profiled.count() // BUCKET_GROUPS)
    placed = profiled.withColumn("_h", F.xxhash64("group_id")).withColumn("_b", F.floor(F.shiftrightunsigned("_h", 33) * F.lit(buckets) / F.lit(1 << 31)))
    counts = materialise(placed.groupBy(*bundle, "_b").agg(F.count(F.lit(1)).alias("n")), "bundles")
    table = counts.groupBy(*bundle).agg(F.sum("n").alias("n")).orderBy(*bundle).collect()
    plan = allocate([(r["size"], r["n"], tuple(r[f"q_{x}"] * r["size"] / 4 for x in names)) for r in table], shares)
    ranges, type_ = [], T.StructType([T.StructField(b, T.LongType() if b == "size" else T.IntegerType()) for b in bundle] + [T.StructField(f"to_{n}", T.LongType()) for n in names])
    for r, split_counts in zip(table, plan, strict=True):
        done, ends = 0, []
        for c in split_counts:
            done += c
            ends.append(done)
        ranges.append((r["size"], *(r[f"q_{n}"] for n in names), *ends))
    limits = rows.sparkSession.createDataFrame(ranges, type_)
    before = Window.partitionBy(*bundle).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(*bundle, "_b").orderBy(F.shiftrightunsigned("_h", 33), "_h", "group_id")
    ranked = placed.withColumn("_i", F.row_number().over(inside)).join(offsets, [*bundle, "_b"]).join(limits, bundle)
    place = F.col("_before") + F.col("_i")
    chosen = F.lit(names[-1])
    for n in reversed(names[:-1]):
        chosen = F.when(place <= F.col(f"to_{n}"), n).otherwise(chosen)
    return groups.join(ranked.select("group_id", chosen.alias("assigned_split")), "group_id").select(row_id, "group_id", "assigned_split")
