"""Mixing sources to target weights by a min-cost flow over membership patterns.

A text may stand in several sources; texts are aggregated by the set of target sources they stand
in. Tokens flow from patterns to the quotas of sources, the first use of a text for nothing, each
further use at a rising cost, so repetition is spread as evenly as quotas allow. Texts
are then picked by seeded hashes, found through histograms of bounded size.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.scale import lookup, scratch

#: Hash buckets of a level of the histograms; two levels place a cut to within a 65,536th of a pattern.
BUCKETS = 256
#: Most targets and most patterns (sets of target sources that occur) the driver solves for; more are refused. At both
#: limits at once a solution takes seconds (tested), and the histograms on the driver stay under two million rows.
MAX_TARGETS, MAX_PATTERNS = 60, 2_000
#: Part of the tokens held by the target sources that a mixture aims at, even if sources then fall short.
LEAST_PART = 0.5


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc ``(from, to, capacity, cost)`` of a maximum flow of least cost, primal-dual.

    Shortest distances come once for each length a path can have, of which there are few (the steps of the repetition costs);
    all flow along shortest paths then goes at once, by blocking flows.
    """
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        out[a].append(len(to)), to.append(b), cap.append(c), cost.append(w)
        out[b].append(len(to)), to.append(a), cap.append(0), cost.append(-w)
    height = [0] * n
    while True:
        far: list[int | None] = [None] * n
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                if cap[e] > 0:
                    b, x = to[e], d + cost[e] + height[a] - height[to[e]]
                    if far[b] is None or x < far[b]:
                        far[b] = x
                        heapq.heappush(heap, (x, b))
        if far[sink] is None:
            return [cap[2 * k + 1] for k in range(len(arcs))]
        height = [h + (far[k] if far[k] is not None and far[k] < far[sink] else far[sink]) for k, h in enumerate(height)]
        tight = lambda a, e: cap[e] > 0 and cost[e] + height[a] - height[to[e]] == 0
        while True:
            level = [-1] * n
            level[source] = 0
            row = [source]
            while row and level[sink] < 0:
                fresh = []
                for a in row:
                    for e in out[a]:
                        if level[to[e]] < 0 and tight(a, e):
                            level[to[e]] = level[a] + 1
                            fresh.append(to[e])
                row = fresh
            if level[sink] < 0:
                break
            turn, way, a = [0] * n, [], source
            while True:
                if a == sink:
                    push = min(cap[e] for e in way)
                    for e in way:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    k = next(k for k, e in enumerate(way) if not cap[e])
                    a = to[way[k] ^ 1]
                    del way[k:]
                    continue
                while turn[a] < len(out[a]):
                    e = out[a][turn[a]]
                    if level[to[e]] == level[a] + 1 and tight(a, e):
                        break
                    turn[a] += 1
                if turn[a] < len(out[a]):
                    way.append(e)
                    a = to[e]
                elif way:
                    a = to[way.pop() ^ 1]
                    turn[a] += 1
                else:
                    break


def route(patterns: list[tuple[int, int]], targets: list[tuple[float, int]], total: int) -> dict[tuple[int, int], int]:
    """Tokens from each pattern (``mask, tokens``) to each source (``share, max_repeats``), for a mixture of ``total`` tokens."""
    p, s = len(patterns), len(targets)
    source, sink = p + s, p + s + 1
    arcs, at = [], {}
    for i, (mask, tokens) in enumerate(patterns):
        mine = [j for j in range(s) if mask >> j & 1]
        for level in range(max(targets[j][1] for j in mine)):
            arcs.append((source, i, tokens, level * level))
        for j in mine:
            at[i, j] = len(arcs)
            arcs.append((i, p + j, tokens * targets[j][1], 0))
    for j, (share, _) in enumerate(targets):
        arcs.append((p + j, sink, int(round(share * total)), 0))
    flow = min_cost_flow(p + s + 2, arcs, source, sink)
    return {(patterns[i][0], j): flow[k] for (i, j), k in at.items() if flow[k]}


def mixture(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text_key: str = "text_hash", source: str = "source", tokens: str = "n_tokens", total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture and its shares.

    ``documents`` has ``key, text_key, source, tokens``; ``targets`` has ``source, target_share,
    max_repeats`` with a share above 0 and at least one use (other rows are ignored, of repeated
    sources the first counts). Copies of one text in one source are one document, the one of the
    smallest key. Texts without tokens or outside the target sources take no part. ``total`` is the size
    aimed at, by default the largest at which every source that has any text can reach its share within its repeats, or
    ``LEAST_PART`` of the tokens of all texts if that is more, so that neither an empty nor a small source sizes the mixture;
    where a total asks more of a source than it has, the source falls short.
    Result: ``key, source, n_tokens, uses`` and ``source, target_share, available_tokens, n_docs, mix_tokens, actual_share``.
    """
    spark = documents.sparkSession
    goals = [r for r in targets.groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").filter("target_share > 0 and max_repeats > 0 and source is not null").orderBy("source").limit(MAX_TARGETS + 1).collect()]
    if len(goals) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    mix_type = f"`{key}` {documents.schema[key].dataType.simpleString()}, source string, n_tokens bigint, uses int"
    share_type = "source string, target_share double, available_tokens bigint, n_docs bigint, mix_tokens bigint, actual_share double"
    if not goals:
        return spark.createDataFrame([], mix_type), spark.createDataFrame([], share_type)
    whole = sum(g.target_share for g in goals)
    number = spark.createDataFrame([(g.source, j) for j, g in enumerate(goals)], "_name string, j int")
    rows = documents.select(F.col(key).alias("id"), F.col(text_key).alias("text_key"), F.col(source).alias("_name"), F.col(tokens).alias("n")).filter("n > 0").join(F.broadcast(number), "_name")
    texts = scratch(
        rows.groupBy("text_key", "j").agg(F.min("id").alias("id"), F.min("n").alias("n")).groupBy("text_key").agg(
            F.sum(F.expr("shiftleft(1L, j)")).alias("mask"), F.map_from_entries(F.collect_list(F.struct("j", "id"))).alias("ids"), F.min("n").alias("n")
        )  # a text is in at most MAX_TARGETS sources
        .withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "text_key"), F.lit(BUCKETS * BUCKETS))).select("mask", "ids", "n", F.expr(f"cast(h div {BUCKETS} as int)").alias("h1"), F.expr(f"cast(h % {BUCKETS} as int)").alias("h2"))
    )
    patterns = [(r.mask, r.n, r.docs) for r in texts.groupBy("mask").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).limit(MAX_PATTERNS + 1).collect()]
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources")
    patterns.sort()
    aims = [(g.target_share / whole, g.max_repeats) for g in goals]
    sizes = [(m, n) for m, n, _ in patterns]
    if total is None:
        # The largest mixture that keeps all shares that can be kept: halve the range of totals until it is under a thousandth.
        held = sum(n for _, n in sizes)
        filled = [s for j, (s, _) in enumerate(aims) if any(m >> j & 1 for m, _ in sizes)]
        low, high = 0, int(held * max(r for _, r in aims) / sum(filled)) if filled else 0
        while sizes and high - low > max(1, high // 1000):
            mid = (low + high + 1) // 2
            need = sum(int(round(s * mid)) for s in filled)
            low, high = (mid, high) if sum(route(sizes, aims, mid).values()) >= need else (low, mid - 1)
        total = max(low, int(LEAST_PART * held))
    flows = route(sizes, aims, total) if sizes and total else {}
    tokens_of = dict(sizes)
    # Each pattern's uses lie on a line that winds round its texts; sources take stretches of it in turn.
    stretches: dict[int, list[tuple[int, int, int]]] = {}
    for (mask, j), f in sorted(flows.items()):
        mine = stretches.setdefault(mask, [])
        start = mine[-1][2] if mine else 0
        mine.append((j, start, start + f))
    ends = {m: sorted({x % tokens_of[m] for _, a, b in v for x in (a, b)}) for m, v in stretches.items()}
    # Where each bucket of texts begins on the round; only buckets that hold an end are opened further.
    first = texts.groupBy("mask", "h1").agg(F.sum("n").alias("n")).filter(F.col("mask").isin(list(stretches) or [-1]))
    begin: dict[tuple[int, int], tuple[int, int]] = {}
    at: dict[int, int] = {}
    for r in first.orderBy("mask", "h1").toLocalIterator():  # at most BUCKETS rows for each pattern
        begin[r.mask, r.h1] = (at.get(r.mask, 0), r.n)
        at[r.mask] = at.get(r.mask, 0) + r.n
    open_at = [(m, h) for (m, h), (b, n) in begin.items() if any(b < e < b + n for e in ends[m])]
    opened = spark.createDataFrame(open_at or [(-1, -1)], "mask bigint, h1 int")
    second = texts.join(lookup(opened), ["mask", "h1"]).groupBy("mask", "h1", "h2").agg(F.sum("n").alias("n")).orderBy("mask", "h1", "h2")
    places, into = [(m, h, -1, b) for (m, h), (b, _) in begin.items() if (m, h) not in set(open_at)], {}
    for r in second.toLocalIterator():
        b = into.get((r.mask, r.h1), begin[r.mask, r.h1][0])
        places.append((r.mask, r.h1, r.h2, b))
        into[r.mask, r.h1] = b + r.n
    # Of a place on the round, how often each source uses it.
    uses = []
    for m, h1, h2, b in places:
        for j, lo, hi in stretches[m]:
            t = tokens_of[m]
            k = max(0, -((b - hi) // t)) - max(0, -((b - lo) // t))
            if k > 0:
                uses.append((m, h1, h2, j, int(k)))
    plan = spark.createDataFrame(uses or [(-1, -1, -1, -1, 0)], "mask bigint, h1 int, p2 int, j int, uses int")
    opened = opened.withColumn("_open", F.lit(True))
    placed = texts.join(lookup(opened), ["mask", "h1"], "left").withColumn("p2", F.when(F.col("_open"), F.col("h2")).otherwise(-1))
    mixed = placed.join(plan, ["mask", "h1", "p2"]).join(F.broadcast(number), "j").select(F.element_at("ids", F.col("j")).alias(key), F.col("_name").alias("source"), F.col("n").alias("n_tokens"), "uses")
    mixed = scratch(mixed)
    had = {g.source: sum(n for m, n in sizes if m >> j & 1) for j, g in enumerate(goals)}
    got = {r.source: (r.docs, r.t) for r in mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("n_tokens") * F.col("uses")).alias("t")).collect()}
    all_of = sum(t for _, t in got.values()) or 1
    shares = [(g.source, float(g.target_share), had[g.source], *got.get(g.source, (0, 0)), got.get(g.source, (0, 0))[1] / all_of) for g in goals]
    return mixed, spark.createDataFrame(shares, share_type)
