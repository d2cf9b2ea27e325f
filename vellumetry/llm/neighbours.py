"""Approximate nearest neighbours by learned partitions.

1. A bounded sample is joined to its nearest neighbours; that graph is cut
   into parts of equal size with few edges between them (balanced label
   propagation from balanced centroids).
2. A small network learns to tell a vector's part; its targets are the parts
   of the vector's neighbours.
3. Every vector is indexed under its most probable part.
4. A bounded number of the queries is ranked against all vectors in blocks.
   From where their true neighbours lie follows the probability mass of parts
   that gives the wanted recall.
5. A query goes to its most probable parts until they have that mass, and to
   more where those hold too few vectors. All their vectors are ranked exactly.

There are about sqrt(rows) / 4 parts, as far as the sample can tell so many
apart. Vectors without structure have neighbours in most parts; then most parts
are needed, which step 4 measures and the README states.

Nearness is the inner product in double precision. Vectors that are null,
empty, zero, or hold null or non-finite components take no part, nor do those
of another than the most frequent length or with a null id; a query that takes
no part gives no rows. Repeated rows are candidates, and queries, of their own:
a query leaves out one row of its id and vector, itself. Equal ids with
different vectors are different rows. Of equal vectors, only the ``k + 1``
least ids can be among any query's nearest, since ties go to them; the others
are left out before partitions are filled, which bounds a hot vector without
changing a result. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumetry.llm.common import materialise, read_table


@dataclass(frozen=True)
class Params:
    k: int = 20
    #: vectors that the partitions are learnt from: so many a part, within bounds
    sample_per_part: int = 32
    min_sample: int = 4096
    max_sample: int = 16384
    #: vectors of the sample that a part needs
    part_sample: int = 16
    graph_neighbours: int = 16
    hidden: int = 64
    epochs: int = 30
    #: wanted recall, and the queries by which it is measured
    recall: float = 0.94
    calibration: int = 256
    seed: int = 3
    #: vectors and queries of a block
    block: int = 2048
    query_block: int = 1024
    #: vectors of a part, and queries, that meet in one task, about
    spread: int = 32768


def usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def balanced(scores: np.ndarray, capacity: int) -> np.ndarray:
    """Each row's best column that is not full, rows of largest margin first."""
    n, parts = scores.shape
    if parts == 1:
        return np.zeros(n, "i8")
    top = np.partition(scores, -2, axis=1)
    out, room = np.empty(n, "i8"), np.full(parts, capacity)
    for i in np.argsort(top[:, -2] - top[:, -1], kind="stable"):
        s = np.where(room > 0, scores[i], -np.inf)
        out[i] = j = int(np.argmax(s))
        room[j] -= 1
    return out


def partition_graph(x: np.ndarray, parts: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Part of each vector and the neighbours of each."""
    rng = np.random.default_rng(p.seed)
    n = len(x)
    k = min(p.graph_neighbours, n - 1)
    graph = np.empty((n, k), "i8")
    for lo in range(0, n, 1024):
        near = x[lo : lo + 1024] @ x.T
        near[np.arange(len(near)), lo + np.arange(len(near))] = -np.inf
        graph[lo : lo + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    capacity = -(-n // parts)
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, "i8")
    for _ in range(8):
        part = balanced(x @ centres.T, capacity)
        centres = np.stack([x[part == j].sum(0) for j in range(parts)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    own = np.arange(n)
    best, cut = part, (part[graph] != part[:, None]).sum()
    for _ in range(15):  # balanced label propagation; edges count in both directions
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(own, k), part[graph].reshape(-1)), 1)
        np.add.at(votes, (graph.reshape(-1), np.repeat(part, k)), 1)
        votes[own, part] += 0.5
        part = balanced(votes + 1e-3 * (x @ centres.T), capacity)
        if (now := (part[graph] != part[:, None]).sum()) < cut:
            best, cut = part, now
    return best, graph


class Router:
    """The classifier: one hidden layer, trained in numpy."""

    def __init__(self, x: np.ndarray, parts: int, p: Params):
        rng = np.random.default_rng(p.seed)
        self.parts = parts
        self.scale = float(np.linalg.norm(x, axis=1).mean()) or 1.0
        d = x.shape[1]
        self.w1, self.b1 = rng.standard_normal((d, p.hidden)) * (2 / d) ** 0.5, np.zeros(p.hidden)
        self.w2, self.b2 = rng.standard_normal((p.hidden, parts)) * p.hidden**-0.5, np.zeros(parts)
        if parts == 1:
            return
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        part, graph = partition_graph(unit, parts, p)
        target = np.zeros((len(x), parts))
        rows = np.repeat(np.arange(len(x)), graph.shape[1])
        np.add.at(target, (rows, part[graph].reshape(-1)), 0.5 / graph.shape[1])
        target[np.arange(len(x)), part] += 0.5
        weights = [self.w1, self.b1, self.w2, self.b2]
        state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        step = 0
        for _ in range(p.epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 256):
                i = order[lo : lo + 256]
                a = unit[i]
                h = np.maximum(a @ self.w1 + self.b1, 0)
                g = (self._softmax(h @ self.w2 + self.b2) - target[i]) / len(i)
                gh = (g @ self.w2.T) * (h > 0)
                step += 1
                for w, (m1, m2), gw in zip(weights, state, (a.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    gw = gw + 1e-4 * w
                    m1 += 0.1 * (gw - m1)
                    m2 += 0.001 * (gw**2 - m2)
                    w -= 0.01 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.ones((len(x), 1))
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return self._softmax(np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.probabilities(x), axis=1, kind="stable")

    def mass(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts, most probable first, and the probability of those before each."""
        found = self.probabilities(x)
        order = np.argsort(-found, axis=1, kind="stable")
        found = np.take_along_axis(found, order, 1)
        return order, np.cumsum(found, axis=1) - found


def fit(sample: np.ndarray, n_rows: int, p: Params) -> Router:
    """The router of a sample of distinct vectors, for a table of so many rows."""
    return Router(sample, int(max(1, min(wanted_parts(n_rows), len(sample) // p.part_sample))), p)


def wanted_parts(n_rows: int) -> int:
    return max(2, round(n_rows**0.5 / 4))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, d)


def _blocks(df: DataFrame, size: int, d: int, real: str) -> DataFrame:
    """(part, deal, x, y, z, v) -> blocks (part, deal, xyz, vs) of at most ``size`` vectors."""

    def run(batches):
        held: dict[tuple, list] = {}

        def emit(key):
            longs, vs = (np.concatenate(x) for x in zip(*held.pop(key)))
            for lo in range(0, len(longs), size):
                row = [key[0]], [key[1]], [longs[lo : lo + size].tobytes()], [vs[lo : lo + size].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "deal", "xyz", "vs"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy().astype("i8") for i in (0, 1)], 1)
            longs, vs = np.stack([b.column(i).to_numpy().astype("<i8") for i in (2, 3, 4)], 1), _matrix(b.column(5), d).astype(real)
            for key in map(tuple, np.unique(keys, axis=0).tolist()):
                mine = (keys == key).all(1)
                held.setdefault(key, []).append((longs[mine], vs[mine]))
                if sum(len(i) for i, _ in held[key]) >= size:
                    yield from emit(key)
            last = tuple(keys[-1].tolist())
            for key in [x for x in held if x < last]:  # rows come sorted by part and deal
                yield from emit(key)
        for key in list(held):
            yield from emit(key)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "part", "deal").sortWithinPartitions("part", "deal").select("part", "deal", "x", "y", "z", "v").mapInArrow(run, "part long, deal long, xyz binary, vs binary")


def top_of_block(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, copies: np.ndarray, k: int):
    """(query's index, candidate ids, copies, scores) of each query's nearest distinct rows, one copy of itself left out."""
    near, less = q @ c.T, {}
    for i, j in np.argwhere(q_ids[:, None] == c_ids[None]).tolist():
        if np.array_equal(q[i], c[j]):
            if copies[j] > 1:
                less[i] = j
            else:
                near[i, j] = -np.inf
    k = min(k, near.shape[1])
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
    slack = 1e-9 * (1 + np.abs(least[np.isfinite(least)]).max(initial=0))
    for i in range(len(q)):
        at = np.flatnonzero((near[i] >= least[i] - slack) & (near[i] > -np.inf))
        score = (q[i] * c[at]).sum(1)  # the same sum wherever a vector stands
        order = np.lexsort((c_ids[at], -score))[:k]
        at = at[order]
        yield i, c_ids[at], copies[at] - (at == less.get(i, -1)), score[order]


def needed_mass(indexed: DataFrame, asked: DataFrame, router: Router, d: int, p: Params) -> float:
    """The mass of parts within which the wanted share of true neighbours lies, by ``calibration`` queries against all rows."""
    drawn = asked.orderBy(F.xxhash64("id"), "n").limit(p.calibration).select("id", "v").collect()
    ids, q = np.array([r.id for r in drawn]), np.array([r.v for r in drawn], "f8")

    def run(batches):
        score, other, part = np.full((len(q), p.k), -np.inf), np.zeros((len(q), p.k), "i8"), np.zeros((len(q), p.k), "i8")
        for whole in batches:
            for b in (whole.slice(i, p.block) for i in range(0, whole.num_rows, p.block)):
                own = b.column(1).to_numpy()
                near = q @ _matrix(b.column(2), d).T
                near[ids[:, None] == own[None]] = -np.inf
                score, other = np.concatenate([score, near], 1), np.concatenate([other, np.broadcast_to(own, near.shape)], 1)
                part = np.concatenate([part, np.broadcast_to(b.column(0).to_numpy(), near.shape)], 1)
                best = np.argpartition(-score, p.k - 1, axis=1)[:, : p.k]
                score, other, part = (np.take_along_axis(x, best, 1) for x in (score, other, part))
        who, at = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(score[who, at]), pa.array(other[who, at]), pa.array(part[who, at])], ["q", "score", "id", "part"])

    found = indexed.select("part", "id", "v").mapInArrow(run, "q long, score double, id long, part long")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    true = found.withColumn("nth", nth).where(F.col("nth") <= p.k).select("q", "part").collect()  # calibration * k rows at most
    if not true:
        return 1.0
    order, before = router.mass(q)
    place = np.argsort(order, axis=1)
    mass = np.sort([before[r.q, place[r.q, r.part]] for r in true])
    return float(mass[int(np.ceil(p.recall * len(mass))) - 1]) + 1e-9


def nearest(df: DataFrame, queries: Column, p: Params = Params(), *, vec_id: str = "vec_id", vector: str = "embedding", facts: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest; ``facts`` takes the number of parts and the mass."""
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kind = df.select(F.col(vector)).schema[0].dataType.elementType.simpleString()
    kind, real = ("float", "<f4") if kind == "float" else ("double", "<f8")
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths.d
    rows = rows.where(F.size("v") == d).groupBy("id", "v").agg(F.count("*").alias("copies"), F.sum(F.col("q").cast("long")).alias("asked"))
    rows = materialise(rows, "vectors")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    base = materialise(rows.withColumn("nth", nth).where(F.col("nth") <= p.k + 1).select("id", "v", "copies"), "candidates")
    most = int(min(p.max_sample, max(p.min_sample, p.sample_per_part * wanted_parts(lengths["count"]))))
    drawn = base.orderBy(F.xxhash64("id"), "id").limit(most).select("v").collect()
    sample = np.unique(np.array([r.v for r in drawn], "f8"), axis=0)
    sample = sample[np.random.default_rng(p.seed).permutation(len(sample))]
    router = fit(sample, lengths["count"], p)
    del drawn, sample

    def route(batches):
        for b in batches:
            part = router.ranked(_matrix(b.column(1), d))[:, 0] if b.num_rows else np.zeros(0, "i8")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *b.columns], ["part", "id", "v", "copies"])

    indexed = materialise(base.mapInArrow(route, f"part long, id long, v array<{kind}>, copies long"), "index")
    asked = materialise(rows.where("asked > 0").select("id", "v", "asked", F.monotonically_increasing_id().alias("n")), "queries")
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)
    mass = needed_mass(indexed, asked, router, d, p)
    if facts is not None:
        facts |= {"parts": router.parts, "mass": mass, "router": router}
    held = {r.part: r["count"] for r in indexed.groupBy("part").count().collect()}
    sizes = np.array([held.get(j, 0) for j in range(router.parts)])
    deals = F.element_at(F.array(*(F.lit(int(max(1, -(-n // p.spread)))) for n in sizes)), F.col("part").cast("int") + 1)
    query_deals = int(-(-n_asked // p.spread))

    def send(batches):
        for b in batches:
            if not b.num_rows:
                continue
            order, before = router.mass(_matrix(b.column(1), d))
            # parts before which fewer than k + 1 vectors were found are needed too
            seen = np.cumsum(sizes[order], axis=1) - sizes[order]
            who, col = np.nonzero(((before <= mass) | (seen <= p.k)) & (sizes[order] > 0))
            yield pa.RecordBatch.from_arrays([pa.array(order[who, col]), *(c.take(pa.array(who)) for c in b.columns)], ["part", "id", "v", "asked", "n"])

    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    share = lambda c, n: F.pmod(F.xxhash64(c), n).cast("long")
    candidates = indexed.select("part", share("id", deals).alias("deal"), F.col("id").alias("x"), F.col("copies").alias("y"), F.lit(0).alias("z"), "v")
    candidates = _blocks(candidates, p.block, d, real).select("part", "deal", upto(F.lit(query_deals)).alias("qdeal"), "xyz", "vs")
    sent = asked.mapInArrow(send, f"part long, id long, v array<{kind}>, asked long, n long")
    sent = sent.select("part", share("n", F.lit(query_deals)).alias("deal"), F.col("n").alias("x"), F.col("id").alias("y"), F.col("asked").alias("z"), "v")
    sent = _blocks(sent, p.query_block, d, real).select("part", F.col("deal").alias("qdeal"), upto(deals).alias("deal"), F.col("xyz").alias("q_xyz"), F.col("vs").alias("q_vs"))

    def rank(batches):
        for b in batches:
            for q_longs, qs, c_longs, cs in zip(*(c.to_pylist() for c in b.columns)):
                n, q_ids, times = np.frombuffer(q_longs, "<i8").reshape(-1, 3).T
                c_ids, copies, _ = np.frombuffer(c_longs, "<i8").reshape(-1, 3).T
                q, c = (np.frombuffer(x, real).astype("f8").reshape(-1, d) for x in (qs, cs))
                out = [(n[i], q_ids[i], times[i], ids.astype("<i8").tobytes(), own.astype("<i8").tobytes(), score.astype("<f8").tobytes()) for i, ids, own, score in top_of_block(q, q_ids, c, c_ids, copies, p.k)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(),) * 3 + (pa.binary(),) * 3)], ["n", "id", "times", "ids", "copies", "scores"])

    def merge(batches):
        """Rows come sorted by query: the lists of one are put together and cut."""

        def emit(q, times, lists):
            ids, copies, scores = (np.concatenate([np.frombuffer(x[i], t) for x in lists]) for i, t in ((0, "<i8"), (1, "<i8"), (2, "<f8")))
            order = np.lexsort((ids, -scores))
            order = np.repeat(order, np.minimum(copies[order], p.k))[: p.k]
            rows = len(order)
            for lo in range(0, times, 512):
                m = min(512, times - lo)
                cols = np.full(rows * m, q), np.tile(np.arange(1, rows + 1, dtype="i4"), m), np.tile(ids[order], m), np.tile(scores[order], m)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["query_id", "rank", "vec_id", "score"])

        at, lists = None, []
        for b in batches:
            for n, q, times, *own in zip(*(c.to_pylist() for c in b.columns)):
                if at and n != at[0]:
                    yield from emit(*at[1:], lists)
                    lists = []
                at = n, q, times
                lists.append(own)
        if at:
            yield from emit(*at[1:], lists)

    pairs = sent.join(candidates, ["part", "deal", "qdeal"])
    found = pairs.select("q_xyz", "q_vs", "xyz", "vs").mapInArrow(rank, "n long, id long, times long, ids binary, copies binary, scores binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "n").sortWithinPartitions("n").mapInArrow(merge, schema)


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
