"""Operator 1: minimum-cost-flow resharding.

Law ``bytes``: every new shard gets nearly total / count bytes.  Old shard sizes are the
supplies, new capacities the demands, and moving a byte to another shard costs one;
a minimum-cost flow says how many bytes go from where to where, so that the fewest bytes
move.  The flow is then cut into whole rows: each old
shard is a line of blocks (by hash) with known byte totals, the flow's amounts
are cut points on that line, and a row goes where its middle byte lies.  Rows above
1/64 of a shard are placed one by one first (largest first, at home where it fits); by
that bound there are at most 64 * count of them.

Only per-block totals and those large rows' sizes reach the driver; both are bounded by
parameters.  A block's rows are numbered inside one task, and blocks are many enough
(``rows_per_block``) that a shard holding a third of all rows is spread over many tasks.

``rewrite`` then replaces the files of the shards that gain or lose rows, and of no others.

Defined results: null text has size 16; null ids are rows like others; repeated rows
each get their own slot and rows of one id with different texts are different rows; rows
that agree in all that the flow sees go either way; an empty table gives no rows; columns
other than the id, text and old shard are ignored by ``reshard`` and kept by ``rewrite``.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialise, maybe_broadcast, release, unused

OVERHEAD = 16
#: A row above 1 / LARGE of a shard's capacity is placed by itself.
LARGE = 64


class Network:
    """A flow network with costs; ``solve`` sends as much as can be, as cheaply as can be.

    Primal-dual: shortest distances by Dijkstra under potentials, then a blocking flow (levels and
    current edges) over all edges of no reduced cost.  There are as many rounds as there are
    different costs of a path, which here are two.
    """

    def __init__(self, nodes: int) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(self, u: int, v: int, capacity: int, cost: int) -> int:
        for a, b, x, y in ((u, v, capacity, cost), (v, u, 0, -cost)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.cap.append(x)
            self.cost.append(y)
        return len(self.to) - 2

    def flow(self, edge: int) -> int:
        return self.cap[edge ^ 1]

    def solve(self, source: int, sink: int) -> None:
        far, potential = float("inf"), [0] * len(self.out)
        while True:
            dist: list[float] = [far] * len(self.out)
            dist[source], queue = 0, [(0, source)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > dist[u]:
                    continue
                for e in self.out[u]:
                    v = self.to[e]
                    if self.cap[e] and (x := d + self.cost[e] + potential[u] - potential[v]) < dist[v]:
                        dist[v] = x
                        heapq.heappush(queue, (x, v))
            if dist[sink] == far:
                return
            potential = [p + (d if d < far else dist[sink]) for p, d in zip(potential, dist, strict=True)]
            while self._blocking(source, sink, potential):
                pass

    def _blocking(self, source: int, sink: int, potential: list[int]) -> bool:
        """Saturate the shortest paths of edges without reduced cost; whether there was one."""

        def free(u: int, e: int) -> bool:
            return bool(self.cap[e]) and self.cost[e] + potential[u] - potential[self.to[e]] == 0

        level, queue = {source: 0}, [source]
        for u in queue:
            for e in self.out[u]:
                if self.to[e] not in level and free(u, e):
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        if sink not in level:
            return False
        at, path, u = [0] * len(self.out), [], source
        while True:
            if u == sink:
                amount = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= amount
                    self.cap[e ^ 1] += amount
                path, u = [], source
            while at[u] < len(self.out[u]):
                e = self.out[u][at[u]]
                if free(u, e) and level.get(self.to[e]) == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(self.out[u]):
                path.append(self.out[u][at[u]])
                u = self.to[path[-1]]
            elif path:
                u = self.to[path.pop() ^ 1]
                at[u] += 1
            else:
                return True


def fewest_moves(supply: list[int], demand: list[int]) -> list[tuple[int, int, int]]:
    """Transport of all supply within demand that moves the least between unlike shards: (from, to, amount).

    What stays costs nothing and all other transport costs one, so the graph needs an edge from each
    old shard to itself and edges to and from one hub, not old x new edges.
    """
    n, m = len(supply), len(demand)
    source, sink, hub = n + m, n + m + 1, n + m + 2
    net = Network(n + m + 3)
    for i, s in enumerate(supply):
        net.edge(source, i, s, 0)
    for j, d in enumerate(demand):
        net.edge(n + j, sink, d, 0)
    own = [net.edge(i, n + i, supply[i], 0) for i in range(min(n, m))]
    leave = [net.edge(i, hub, s, 1) for i, s in enumerate(supply)]
    enter = [net.edge(hub, n + j, d, 0) for j, d in enumerate(demand)]
    net.solve(source, sink)
    moves = [(i, i, net.flow(e)) for i, e in enumerate(own) if net.flow(e)]
    # What went through the hub is paired in order; in an optimum no shard both leaves and enters.
    gets = [[j, net.flow(e)] for j, e in enumerate(enter) if net.flow(e)]
    for i, e in enumerate(leave):
        left = net.flow(e)
        while left:
            amount = min(left, gets[0][1])
            moves.append((i, gets[0][0], amount))
            left -= amount
            gets[0][1] -= amount
            if not gets[0][1]:
                gets.pop(0)
    return sorted(moves)


def level_demands(taken: list[int], amount: int) -> list[int]:
    """Bytes for each shard, so that taken + bytes is as level as can be and the bytes sum to amount."""
    order = sorted(range(len(taken)), key=lambda j: taken[j])
    level, filled = 0, 0
    for k in range(1, len(order) + 1):
        filled += taken[order[k - 1]]
        level = (amount + filled) // k
        if k == len(order) or level <= taken[order[k]]:
            break
    demand = [max(0, level - x) for x in taken]
    spare = amount - sum(demand)
    for j in order[:k]:
        demand[j] += spare // k + (1 if j in order[: spare % k] else 0)
    return demand


@dataclass
class Plan:
    """What the flow decided: moves (old, new, bytes) of cut rows, and single large rows."""

    moves: list[tuple[int, int, int]] = field(default_factory=list)
    large: dict[tuple[int, int, int], int] = field(default_factory=dict)

    def affected(self) -> list[int]:
        """Shards whose files change; the others are left as they are."""
        return sorted({x for i, j, _ in self.moves if i != j for x in (i, j)} | {x for (i, _, _), j in self.large.items() if i != j for x in (i, j)})


def reshard(docs: DataFrame, old_shard: str, old_count: int, new_count: int, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 250_000) -> tuple[DataFrame, Plan]:
    """Rows (doc_id, size, text_crc32, old_shard, shard, slot), and the plan behind them.

    old_shard: SQL expression of each row's shard now, from 0 to old_count - 1.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.expr(old_shard).cast("int").alias("old_shard"), F.spark_partition_id().alias("part"))
    narrow = materialise(narrow, "shard-sizes")
    counted = narrow.agg(F.count("*"), F.sum("size")).first()
    rows, total = counted[0], counted[1] or 0
    blocks = max(128, -(-rows // (old_count * rows_per_block)))
    large_size = max(OVERHEAD, total // (new_count * LARGE))
    large = F.col("size") > large_size
    here = Window.partitionBy("old_shard", "block").orderBy("doc_id", "size", "text_crc32")
    numbered = (
        narrow.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "part"), F.lit(blocks)).cast("int"))
        .withColumn("n", F.row_number().over(here))
        .withColumn("before", F.sum(F.when(large, 0).otherwise(F.col("size"))).over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.when(large, 0).otherwise(F.col("size")))
    )
    numbered = materialise(numbered, "shard-lines")
    # old_count x blocks rows, and at most new_count * LARGE large ones.
    lines = sorted((r.old_shard, r.block, r.b) for r in numbered.groupBy("old_shard", "block").agg(F.sum(F.when(large, 0).otherwise(F.col("size"))).alias("b")).collect())
    singles = sorted(((r.size, r.old_shard, r.block, r.n) for r in numbered.where(large).select("size", "old_shard", "block", "n").collect()), reverse=True)

    plan, taken = Plan(), [0] * new_count
    capacity = -(-total // new_count)
    for size, i, b, n in singles:
        j = i if i < new_count and taken[i] + size <= capacity else min(range(new_count), key=lambda j: (taken[j], j))
        taken[j] += size
        plan.large[i, b, n] = j
    supply = [0] * old_count
    for i, _, b in lines:
        supply[i] += b
    demand = level_demands(taken, sum(supply))
    plan.moves = fewest_moves(supply, demand)

    cuts: dict[int, list[tuple[int, int]]] = {}
    for i, j, amount in sorted(plan.moves, key=lambda x: (x[0], x[0] != x[1], x[1])):
        own = cuts.setdefault(i, [])
        own.append(((own[-1][0] if own else 0) + amount, j))
    table, at = [], dict.fromkeys(range(old_count), 0)
    for i, b, amount in lines:
        own = cuts.get(i, [(0, i % new_count)])
        ends = [e for e, _ in own[:-1]]
        table.append((i, b, at[i], ends, [j for _, j in own]))
        at[i] += amount
    planned = spark.createDataFrame(table, "old_shard int, block int, base long, ends array<long>, targets array<int>")
    alone = spark.createDataFrame([(*k, j) for k, j in plan.large.items()], "old_shard int, block int, n int, single int")
    middle = 2 * (F.col("base") + F.col("before")) + F.col("size")
    target = F.get("targets", F.size(F.filter("ends", lambda e: 2 * e <= middle)))
    placed = (
        numbered.join(maybe_broadcast(planned, len(table), 24 + 12 * new_count), ["old_shard", "block"])
        .join(maybe_broadcast(alone, len(plan.large), 20), ["old_shard", "block", "n"], "left")
        .select("doc_id", "size", "text_crc32", "old_shard", "block", "n", F.coalesce("single", target).alias("shard"))
    )
    placed = materialise(placed, "shard-places")
    # Bounded by blocks and the cuts that fall in them.
    counts = sorted((r.shard, r.old_shard, r.block, r["count"]) for r in placed.groupBy("shard", "old_shard", "block").count().collect())
    bases, shard, next_slot = [], None, 0
    for j, i, b, n in counts:
        if j != shard:
            shard, next_slot = j, 0
        bases.append((j, i, b, next_slot))
        next_slot += n
    first = spark.createDataFrame(bases, "shard int, old_shard int, block int, first_slot long")
    within = Window.partitionBy("old_shard", "block", "shard").orderBy("n")
    out = placed.withColumn("k", F.row_number().over(within) - 1).join(maybe_broadcast(first, len(bases), 20), ["shard", "old_shard", "block"])
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first_slot") + F.col("k")).alias("slot")), plan


def _numbered(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """rows with their number among those of equal keys, from 0.

    Rows are numbered within the partition they are in, on top of what the partitions before it hold;
    so however many rows share a key, they stay spread.
    """
    part, local, base, *others = unused([*rows.columns, number], "part", "local", "base", *[f"other{k}" for k in range(len(keys) + 1)])
    placed = materialise(rows.withColumn(part, F.spark_partition_id()), "shard-parts")
    within = Window.partitionBy(*keys, part).orderBy(F.lit(0))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, part).agg(F.count("*").alias(local))
    bases = counts.select(*[F.col(c).alias(x) for c, x in zip((*keys, part), others, strict=True)], F.coalesce(F.sum(local).over(before), F.lit(0)).alias(base))
    same = F.lit(True)
    for c, x in zip((*keys, part), others, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(x))
    out = placed.withColumn(local, F.row_number().over(within) - 1).join(bases, same)
    return out.select(*rows.columns, (F.col(local) + F.col(base)).alias(number))


def rewrite(docs: DataFrame, assignment: DataFrame, plan: Plan, path: str, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", files_per_shard: int = 1) -> None:
    """Write the rows of affected shards below path/shard=N, replacing those folders and emptying those that lose all rows.

    docs: the rows that ``assignment`` was made from, with all their columns but ``shard_col``; they may be read from
    path itself, as their new files are written elsewhere first.  Rows are matched by id, size and
    checksum, and by number among those that agree in all three, so repeated ids keep all their rows.
    Shards that the plan leaves alone are not rewritten.
    """
    spark, touched = docs.sparkSession, plan.affected()
    kept = [c for c in docs.columns if c.lower() != shard_col.lower()]
    key_id, key_size, key_crc, number, a_id, a_size, a_crc, a_number, slot = unused([*kept, shard_col], "id", "size", "crc", "number", "a_id", "a_size", "a_crc", "a_number", "slot")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(*kept, F.col(id_col).alias(key_id), (F.octet_length(text).cast("long") + OVERHEAD).alias(key_size), F.crc32(text).alias(key_crc))
    places = assignment.select(F.col("doc_id").alias(a_id), F.col("size").alias(a_size), F.col("text_crc32").alias(a_crc), F.col("shard").alias(shard_col), F.col("slot").alias(slot))
    rows, places = _numbered(rows, [key_id, key_size, key_crc], number), _numbered(places, [a_id, a_size, a_crc], a_number).where(F.col(shard_col).isin(touched))
    same = F.col(key_id).eqNullSafe(F.col(a_id)) & (F.col(key_size) == F.col(a_size)) & (F.col(key_crc) == F.col(a_crc)) & (F.col(number) == F.col(a_number))
    moved = materialise(rows.join(places, same).select(*kept, shard_col, slot), "shard-rows")
    dealt = moved.repartition(max(1, len(touched) * files_per_shard), shard_col, F.pmod(F.col(slot), F.lit(files_per_shard)))
    dealt.sortWithinPartitions(shard_col, slot).drop(slot).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard_col).parquet(path)
    # At most as many as there are shards.
    filled = {r[0] for r in moved.select(shard_col).distinct().collect()}
    release(moved)
    for shard in touched:
        if shard not in filled:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{shard_col}={shard}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
