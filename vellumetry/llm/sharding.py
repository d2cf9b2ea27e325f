"""Resharding by minimum-cost flow.

Documents lie in old shards and shall lie in ``n_new`` shards of given
capacities (by default nearly equal bytes). Old shard i and new shard i are the
same place, so what stays costs nothing and a moved byte costs one.

1. The documents of an old shard are dealt into blocks by a hash. A block is
   the unit of a transfer. Only block sizes reach the driver; their number is
   bounded by ``MAX_BLOCKS`` and by 64 bytes of a hash for each old shard.
2. ``min_cost_flow`` solves old shards -> new shards with successive shortest
   paths over the residual shard graph. It moves the fewest bytes.
3. ``assign_blocks`` makes the flow of whole blocks: each arc takes the blocks,
   largest first, that still fit; what fits nowhere goes where most room is. So
   no shard is above its capacity by more than the largest block, and what moves
   is at most the flow's optimum and a largest block for each arc of the flow.
4. ``reshard`` gives each document its shard and a gapless slot in it.
   ``rewrite_shards`` writes the affected shards' files; a shard that loses and
   gains nothing keeps its old file.

Sizes are UTF-8 bytes of the text plus 8; a null text has none. Rows may repeat
and ids may be null: equal rows lie in one block, in any order. An empty table
gives no rows. Columns other than id and text are carried through by
``rewrite_shards``; ``shard`` and ``slot`` replace columns of these names.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vellumetry.llm.common import fresh, read_table, work_dir

#: No more blocks than this reach the driver (unless there are more old shards).
MAX_BLOCKS = 1 << 19
#: Bytes of a block where the bounds allow it, and blocks of a new shard at least.
BLOCK_BYTES = 64 << 20
LEAST_BLOCKS = 64


def doc_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def even_capacities(total: int, n: int) -> list[int]:
    return [total * (i + 1) // n - total * i // n for i in range(n)]


def min_cost_flow(old: list[int], new: list[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, at least cost; their sums are ``old`` and ``new``.

    Successive shortest paths over the residual graph of source, old shards, new
    shards and sink, whose arcs may have any costs of 0 or more (by default
    staying is free and moving costs 1 a byte). Each round finds all nodes'
    distances by reduced costs and then fills shortest paths until none is left,
    so there are no more rounds than different path costs.
    """
    if sum(old) != sum(new):
        raise ValueError("old sizes and new capacities must have the same sum")
    n, m = len(old), len(new)
    source, sink = n + m, n + m + 1
    head, room, price = [], [], []  # arc k and its way back k ^ 1
    leaving: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(u: int, v: int, capacity: int, c: int) -> None:
        for x, y, r, p in ((u, v, capacity, c), (v, u, 0, -c)):
            leaving[x].append(len(head))
            head.append(y)
            room.append(r)
            price.append(p)

    for i, b in enumerate(old):
        arc(source, i, b, 0)
        for j in range(m if b else 0):
            if new[j]:
                arc(i, n + j, b, cost(i, j))
    first = {}
    for i in range(n):
        for k in leaving[i]:
            if k % 2 == 0:
                first[i, head[k] - n] = k
    for j, b in enumerate(new):
        arc(n + j, sink, b, 0)

    potential, left = [0] * (n + m + 2), sum(old)
    while left:
        far = [None] * (n + m + 2)
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if far[u] is not None:
                continue
            far[u] = d
            for k in leaving[u]:
                if room[k] and far[head[k]] is None:
                    heapq.heappush(heap, (d + price[k] + potential[u] - potential[head[k]], head[k]))
        most = far[sink]
        potential = [p + (most if d is None else min(d, most)) for p, d in zip(potential, far)]
        at, dead = [0] * (n + m + 2), [False] * (n + m + 2)
        path, on = [], {source}
        u = source
        while True:
            if u == sink:
                b = min(room[k] for k in path)
                left -= b
                for k in path:
                    room[k] -= b
                    room[k ^ 1] += b
                path, on, u = [], {source}, source
                continue
            while at[u] < len(leaving[u]):
                k = leaving[u][at[u]]
                v = head[k]
                if room[k] and not dead[v] and v not in on and price[k] + potential[u] == potential[v]:
                    break
                at[u] += 1
            else:
                dead[u] = True
                if not path:
                    break
                on.discard(u)
                k = path.pop()
                u = head[k ^ 1]
                continue
            path.append(k)
            on.add(v)
            u = v
    return {key: room[k ^ 1] for key, k in first.items() if room[k ^ 1]}


@dataclass
class Plan:
    """Blocks' new shards, in the order of their slots, and what the flow asked for."""

    n_new: int
    n_blocks: int
    flow: dict[tuple[int, int], int]
    #: (old shard, block) -> (new shard, first slot)
    blocks: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    #: bytes that change place, and new shards whose files are not as before
    moved: int = 0
    affected: set[int] = field(default_factory=set)


def assign_blocks(sizes: dict[tuple[int, int], tuple[int, int]], n_old: int, n_new: int, n_blocks: int, capacities: list[int] | None = None) -> Plan:
    """sizes: (old shard, block) -> (bytes, rows)."""
    old = [0] * n_old
    for (i, _), (b, _) in sizes.items():
        old[i] += b
    new = capacities or even_capacities(sum(old), n_new)
    plan = Plan(n_new, n_blocks, min_cost_flow(old, new))
    room: list[dict[int, int]] = [{} for _ in range(n_old)]  # what each arc still takes
    for (i, j), b in plan.flow.items():
        room[i][j] = b
    left = list(new)
    to: dict[tuple[int, int], int] = {}
    late: list[tuple[int, tuple[int, int]]] = []
    for key in sorted(sizes, key=lambda k: (-sizes[k][0], k)):
        i, b = key[0], sizes[key][0]
        arcs = [(r, i == j, -j) for j, r in room[i].items() if r >= b]
        if not arcs:
            late.append((b, key))
            continue
        # the shard that stays comes first, then the arc with most room
        j = i if any(a[1] for a in arcs) else -max(arcs)[2]
        room[i][j] -= b
        left[j] -= b
        to[key] = j
    heap = [(-r, j) for j, r in enumerate(left)]
    heapq.heapify(heap)
    for b, key in late:  # largest first, to where most room is
        r, j = heapq.heappop(heap)
        to[key] = j
        heapq.heappush(heap, (r + b, j))
    slots = [0] * n_new
    gains, losses = [0] * n_new, [0] * max(n_old, n_new)
    for key in sorted(to):
        j, i = to[key], key[0]
        plan.blocks[key] = (j, slots[j])
        slots[j] += sizes[key][1]
        if i != j:
            plan.moved += sizes[key][0]
            gains[j] += 1
            losses[i] += 1
    plan.affected = {j for j in range(n_new) if gains[j] or losses[j]}
    return plan


def plan_reshard(df: DataFrame, old: Column, n_new: int, capacities: list[int] | None = None, *, doc_id: str = "doc_id", text: str = "text") -> tuple[Plan, dict]:
    """``old`` names each document's old shard by any value; the values' order numbers the shards."""
    rows = df.select(old.cast("string").alias("old"), F.xxhash64(doc_id, text).alias("h"), doc_bytes(F.col(text)).alias("size"))
    by_old = {r.old: r.b for r in rows.groupBy("old").agg(F.sum("size").alias("b")).collect()}
    numbers = {name: i for i, name in enumerate(sorted(by_old, key=lambda x: (x is not None, x)))}
    total, n_old = sum(by_old.values()), max(1, len(by_old))
    n_blocks = min(MAX_BLOCKS, max(LEAST_BLOCKS * n_new, total // BLOCK_BYTES))
    n_blocks = max(1, -(-n_blocks // n_old))
    sizes = {}
    for r in rows.groupBy("old", F.pmod("h", F.lit(n_blocks)).alias("k")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        sizes[numbers[r.old], r.k] = (r.b, r.n)
    return assign_blocks(sizes, n_old, n_new, n_blocks, capacities), numbers


def reshard(df: DataFrame, old: Column, plan: Plan, numbers: dict, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``shard`` and ``slot``, range-partitioned by them.

    The plan's table is broadcast: its rows are blocks, bounded as above.
    """
    spark = df.sparkSession
    names = {i: name for name, i in numbers.items()}
    schema = T.StructType([T.StructField("__old", T.StringType()), T.StructField("__k", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("__first", T.LongType())])
    table = spark.createDataFrame([(names[i], k, j, first) for (i, k), (j, first) in sorted(plan.blocks.items())], schema)
    own, k, of, block, first = fresh([*df.columns, "shard", "slot"], "own", "k", "of", "block", "first")
    # ``old`` may name a column that is replaced
    keyed = df.withColumns({own: old.cast("string"), k: F.pmod(F.xxhash64(doc_id, text), F.lit(plan.n_blocks))}).drop("shard", "slot")
    table = F.broadcast(table.withColumnsRenamed({"__old": of, "__k": block, "__first": first}))
    placed = keyed.join(table, F.col(own).eqNullSafe(F.col(of)) & (F.col(k) == F.col(block)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), plan.n_new)
    # equal (shard, first slot) means the same block, or an empty one before it
    placed = placed.repartitionByRange(n, "shard", first)
    order = Window.partitionBy("shard", first).orderBy(F.col(doc_id).asc_nulls_first(), F.xxhash64(text))
    placed = placed.withColumn("slot", F.col(first) + F.row_number().over(order) - 1)
    return placed.drop(own, k, of, block, first)


def rewrite_shards(df: DataFrame, old: Column, n_new: int, folder: str, capacities: list[int] | None = None, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Plan]:
    """Writes the affected shards as ``folder/shard=N`` and returns all shards' rows, read back, with the plan."""
    spark = df.sparkSession
    plan, numbers = plan_reshard(df, old, n_new, capacities, doc_id=doc_id, text=text)
    placed = reshard(df, old, plan, numbers, doc_id=doc_id, text=text)
    schema = placed.schema
    still = sorted(set(range(n_new)) - plan.affected)
    changed = placed.where(F.col("shard").isin(sorted(plan.affected))) if still else placed
    changed.write.partitionBy("shard").parquet(folder)
    back = spark.read.schema(schema).parquet(folder).select(*placed.columns)
    return (back.unionByName(placed.where(F.col("shard").isin(still))) if still else back), plan


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that hold the documents are the old shards; 24 new ones of nearly equal bytes."""
    docs = read_table(spark, sf_dir, "documents")
    at = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("__file"))
    back, _ = rewrite_shards(at, F.col("__file"), 24, work_dir(spark, "shards"))
    return back.select(
        "doc_id",
        doc_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
