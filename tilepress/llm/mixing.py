"""Mixing overlapping sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to); pattern capacity flows to the sources'
quotas over arcs whose cost grows with each repetition of a document (convex costs), solved on the driver over the
aggregated patterns only; seeded whole documents then realise every pattern's flow.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilepress.llm._common import WORD, table, text_of, written

#: Sources by code point weigh 3, 1, 2, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Buckets of the seeded order in each pattern and size class; prefix sums run inside buckets and over their sums.
BUCKETS = 1024
#: Patterns that the flow on the driver takes; one number each, and more than that is an error, never a cut.
MAX_PATTERNS = 100_000


def targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """Shares of share * sum(sizes) by weight; none above most times its size, the excess reshared by weight until none is above."""
    total, out, free = share * sum(sizes.values()), {}, set(sizes)
    while free:
        weight = math.fsum(weights[s] for s in free)
        over = {s for s in free if total * weights[s] / weight > most * sizes[s]}
        if not over:
            out |= {s: total * weights[s] / weight for s in free}
            break
        out |= {s: most * sizes[s] for s in over}
        total = max(0.0, total - math.fsum(most * sizes[s] for s in over))
        free -= over
    return out


def _fill(graph: list[list[list]], start: int, end: int, least: float) -> None:
    """Sends as much more flow as the arcs [to, room, number of the reverse arc] take, along shortest paths, all of one length at a time."""
    while True:
        level, queue = [-1] * len(graph), deque([start])
        level[start] = 0
        while queue:
            a = queue.popleft()
            for b, room, _ in graph[a]:
                if room > least and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[end] < 0:
            return
        at, path, x = [0] * len(graph), [], start
        while True:
            if x == end:
                room = min(arc[1] for _, arc in path)
                for _, arc in path:
                    arc[1] -= room
                    graph[arc[0]][arc[2]][1] += room
                first = next(k for k, (_, arc) in enumerate(path) if arc[1] <= least)
                x, path = path[first][0], path[:first]
            while at[x] < len(graph[x]) and not (graph[x][at[x]][1] > least and level[graph[x][at[x]][0]] == level[x] + 1):
                at[x] += 1
            if at[x] < len(graph[x]):
                path.append((x, graph[x][at[x]]))
                x = graph[x][at[x]][0]
            elif not path:
                break
            else:
                x, _ = path.pop()
                at[x] += 1


def min_cost_flow(capacity: dict, members: dict, quota: dict, most: int = 2) -> dict:
    """(pattern, source) -> tokens: of the largest flows one that costs least.

    Arcs: into pattern p, one for each repetition k < most, of capacity[p] tokens at cost k (convex in the flow, so a pattern
    repeats only when no fresh tokens reach the quota); from p to each of its sources without limit; from s out, quota[s].
    Only arcs out of the start cost anything, and a path never takes flow back from those. So the arcs are opened in the order of
    their cost, and after each the flow is made as large as it gets: what it holds of the cheaper arcs is the most they can hold.
    """
    patterns, sources = list(capacity), list(quota)
    number = {s: len(patterns) + 1 + i for i, s in enumerate(sources)}
    end = len(patterns) + len(sources) + 1
    graph: list[list[list]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: float) -> list:
        graph[a].append([b, room, len(graph[b])])
        graph[b].append([a, 0.0, len(graph[a]) - 1])
        return graph[a][-1]

    into = [arc(0, i + 1, 0.0) for i in range(len(patterns))]
    used = {(p, s): arc(i + 1, number[s], math.inf) for i, p in enumerate(patterns) for s in members[p]}
    for s in sources:
        arc(number[s], end, float(quota[s]))
    least = 1e-9 * max([1.0, *quota.values()])
    for _ in range(most):
        for p, a in zip(patterns, into, strict=True):
            a[1] += float(capacity[p])
        _fill(graph, 0, end, least)
    return {key: graph[a[0]][a[2]][1] for key, a in used.items()}


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources: str | None = "source", weights=WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 17, row_col: str | None = None, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken, copies; size counts white-space words.

    sources: a string column (a document belongs to that source; null is a source of its own, last in order) or an array
    column of several. weights: repeating by code-point order of the sources. Whole documents are taken 0 to `most` times,
    chosen by a seeded hash of id and text: reruns agree, also where ids are null or repeat (rows that agree in id, text and
    sources can stand for each other). Within each pattern and size class (powers of two) a prefix of the seeded order fills the
    class's part of the flow, never above it; the shortfalls are then filled greedily from the first unchosen document of each
    class, largest first, so the rest left is below the smallest of those.
    Null and empty texts have size 0 and are never taken. Sources without words have target 0. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    row_col: a column with another value in each row, which comes along; rows that repeat an id are told apart by it.
    For overlapping documents source_size and target are those of the first source; null array elements are the null source.
    max_patterns: the flow is solved on the driver over one number for each pattern; more patterns raise ValueError.
    """
    spark = docs.sparkSession
    kind = docs.schema[sources].dataType
    pattern = F.array_sort(F.array_distinct(F.coalesce(F.col(sources), F.array(F.lit(None).cast("string"))))) if isinstance(kind, T.ArrayType) else F.array(F.col(sources).cast("string"))
    row = [] if row_col is None else [row_col]
    slim = docs.select(
        *row,
        F.col(id_col).alias("doc_id"),
        pattern.alias("pattern"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), text_of(text_col), F.lit(seed)).alias("order"),
    )
    slim = written(slim.withColumn("level", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int")), "mixing")
    classes = written(slim.groupBy("pattern", "level").agg(F.sum("size").alias("tokens")), "mixing-classes")
    found = classes.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    capacity = {tuple(r.pattern): r.tokens for r in found}
    size: dict = {}
    for p, tokens in capacity.items():
        for s in p:
            size[s] = size.get(s, 0) + tokens
    ranked = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    # shares are of all words: an overlapping document's words count once, as its flow is bounded by its pattern
    scale = sum(capacity.values()) / max(1, sum(size.values()))
    quota = targets(size, weight, share * scale, most)
    flow = min_cost_flow(capacity, {p: p for p in capacity}, quota, most)

    plan = []
    for p, tokens in capacity.items():
        want = min(float(most), math.fsum(flow[p, s] for s in p) / tokens) if tokens else 0.0
        base = min(most, int(want + 1e-9)) if want < most - 1e-9 else most
        first = p[0] if p else None
        plan.append((list(p), base, max(0.0, want - base) if base < most else 0.0, size.get(first, 0), float(quota.get(first, 0.0))))
    plan_rows = F.broadcast(spark.createDataFrame(plan, "p array<string>, base int, again double, source_size long, target double"))  # at most max_patterns rows
    parts = classes.join(plan_rows, F.col("pattern").eqNullSafe(F.col("p")))
    parts = F.broadcast(parts.select("p", F.col("level").alias("l"), "base", (F.col("again") * F.col("tokens")).alias("part"), "source_size", "target"))  # a row for each size class of a pattern
    joined = slim.join(parts, (F.col("level") == F.col("l")) & F.col("pattern").eqNullSafe(F.col("p"))).drop("p", "l")
    joined = joined.withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 54), F.lit(BUCKETS)).cast("int")).withColumn("key", F.xxhash64("pattern", "level"))

    # distributed prefix sums of the seeded order: over bucket sums, then inside each bucket
    per_bucket = joined.groupBy("key", "bucket").agg(F.sum("size").alias("sum"))
    before = per_bucket.select("key", "bucket", (F.sum("sum").over(Window.partitionBy("key").orderBy("bucket")) - F.col("sum")).alias("before"))
    inside = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = joined.withColumn("upto", F.sum("size").over(inside)).join(before, ["key", "bucket"]).withColumn("upto", F.col("upto") + F.col("before"))
    placed = written(placed.withColumn("extra", ((F.col("upto") <= F.col("part")) & (F.col("size") > 0)).cast("int")), "mixing-placed")

    # the first unchosen document of each class fills what the pattern still lacks, larger classes first
    edge = placed.where("size > 0 and part > 0").groupBy("key", "pattern", "level", "part")
    edge = edge.agg(F.sum(F.col("size") * F.col("extra")).alias("got"), F.min(F.when(F.col("extra") == 0, F.struct("upto", "doc_id", "size"))).alias("next"))
    by_pattern = edge.groupBy("pattern").agg(F.sum(F.col("part") - F.col("got")).alias("lack"), F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("l"), "key", "next.upto", "next.size"))).alias("classes"))
    none = F.array().cast("array<struct<key:bigint,upto:bigint>>")

    def take(done, c):
        more = F.struct((done["lack"] - c["size"]).alias("lack"), F.concat(done["more"], F.array(F.struct(c["key"].alias("key"), c["upto"].alias("upto")))).alias("more"))
        return F.when(c["size"].isNotNull() & (c["size"] <= done["lack"] + 0.5), more).otherwise(done)

    more = by_pattern.select(F.explode(F.aggregate("classes", F.struct(F.col("lack").cast("double").alias("lack"), none.alias("more")), take)["more"]).alias("m"))
    chosen = F.broadcast(more.select("m.key", "m.upto", F.lit(1).alias("more")))  # at most one row for each size class of a pattern
    # a zero-size row can share `upto`, a document that is chosen cannot; repeated rows differ in `upto`
    out = placed.join(chosen, ["key", "upto"], "left").withColumn("copies", F.when(F.col("size") > 0, F.col("base") + F.col("extra") + F.coalesce(F.col("more"), F.lit(0))).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *row)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
