import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from vellumetry.llm import mixing as M
from vellumetry.llm import sharding as S
from vellumetry.llm.common import work_dir


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(200):
        old = [rng.randint(0, 6) for _ in range(rng.randint(1, 3))]
        new = S.even_capacities(sum(old), rng.randint(1, 3))
        flow = S.min_cost_flow(old, new)
        assert [sum(b for (i, _), b in flow.items() if i == k) for k in range(len(old))] == old
        assert [sum(b for (_, j), b in flow.items() if j == k) for k in range(len(new))] == new
        moved = sum(b for (i, j), b in flow.items() if i != j)
        # no flow can leave more in place than a shard has and may hold
        assert moved == sum(old) - sum(min(a, b) for a, b in zip(old, new))


def test_flow_needs_equal_sums():
    with pytest.raises(ValueError):
        S.min_cost_flow([1], [2])


def test_blocks_fill_shards_evenly():
    rng = random.Random(3)
    sizes = {(i, k): (rng.randint(1, 1000), rng.randint(1, 9)) for i, k in product(range(5), range(200))}
    plan = S.assign_blocks(sizes, 5, 7, 200)
    load, rows = Counter(), defaultdict(list)
    for key, (j, first) in plan.blocks.items():
        load[j] += sizes[key][0]
        rows[j].append((first, sizes[key][1]))
    assert max(load.values()) - min(load.values()) <= 1000
    for own in rows.values():  # slots follow each other without gaps
        at = 0
        for first, n in sorted(own):
            assert first == at
            at += n


def check_shards(back, docs, n):
    rows = back.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(n)) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_flow_has_least_cost_at_any_costs():
    rng = random.Random(21)
    for _ in range(60):
        old = [rng.randint(0, 4) for _ in range(rng.randint(1, 3))]
        new = S.even_capacities(sum(old), rng.randint(1, 3))
        costs = [[rng.randint(0, 5) for _ in new] for _ in old]
        flow = S.min_cost_flow(old, new, lambda i, j: costs[i][j])  # noqa: B023
        assert [sum(b for (i, _), b in flow.items() if i == k) for k in range(len(old))] == old
        assert [sum(b for (_, j), b in flow.items() if j == k) for k in range(len(new))] == new
        least = {tuple(new): 0}  # room left -> cost, byte by byte
        for i, b in enumerate(old):
            for _ in range(b):
                after = {}
                for room, c in least.items():
                    for j, r in enumerate(room):
                        if r:
                            key = room[:j] + (r - 1,) + room[j + 1 :]
                            after[key] = min(after.get(key, 1 << 30), c + costs[i][j])
                least = after
        assert sum(b * costs[i][j] for (i, j), b in flow.items()) == least[(0,) * len(new)]


def test_whole_blocks_keep_to_their_bound():
    rng = random.Random(22)
    for n_old, n_new in ((1, 24), (5, 24), (30, 8), (7, 7)):
        sizes = {(i, k): (rng.randint(1, 900), 1) for i in range(n_old) for k in range(400 // n_old)}
        plan, largest = S.assign_blocks(sizes, n_old, n_new, 400), max(b for b, _ in sizes.values())
        old = [sum(b for (i, _), (b, _) in sizes.items() if i == k) for k in range(n_old)]
        new = S.even_capacities(sum(old), n_new)
        best = sum(old) - sum(map(min, old, new))
        held = Counter()
        for key, (j, _) in plan.blocks.items():
            held[j] += sizes[key][0]
        assert max(held[j] - new[j] for j in range(n_new)) <= largest
        assert best <= plan.moved + largest * len(plan.flow) and plan.moved <= best + largest * len(plan.flow)


def test_the_query_on_several_files(spark, words, tmp_path):
    import zlib

    rows = [(i if i % 9 else None, None if i % 50 == 0 else words(1 + i % 40, f"q{i % 300}")) for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op1_reshard(spark, str(tmp_path)).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, crc(t)) for i, t in rows)
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(held) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(held.values()) < 1.2 * sum(held.values()) / 24 and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_rewrites_all_rows(spark, odd_docs):
    back, plan = S.rewrite_shards(odd_docs, F.col("source"), 3, work_dir(spark, "s"))
    assert set(odd_docs.columns) == set(back.columns)
    check_shards(back, odd_docs, 3)


def test_untouched_shards_keep_their_files(spark):
    docs = spark.createDataFrame([(i, "x" * 92, str(i % 2)) for i in range(200)], "doc_id long, text string, old string")
    back, plan = S.rewrite_shards(docs, F.col("old"), 2, work_dir(spark, "s"), [10000, 10000])
    assert not plan.affected and not plan.moved
    check_shards(back, docs, 2)
    assert {(r.old, r["shard"]) for r in back.collect()} == {("0", 0), ("1", 1)}


def test_empty_table_has_no_shards(spark, no_docs):
    back, _ = S.rewrite_shards(no_docs, F.col("source"), 4, work_dir(spark, "s"))
    assert back.count() == 0


def plain_targets(sizes, weights=M.WEIGHTS, most=M.MOST_EPOCHS):
    """Round after round: sources whose share is above their cap get the cap, the others share what is left."""
    rows = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    target = [None] * len(rows)
    while open_ := [i for i, t in enumerate(target) if t is None]:
        share = (sum(r[1] for r in rows) - sum(t for t in target if t is not None)) / sum(weight[i] for i in open_)
        above = [i for i in open_ if share * weight[i] > most * rows[i][1]]
        for i in above or open_:
            target[i] = float(most * rows[i][1]) if above else share * weight[i]
    return [(s, n, t) for (s, n), t in zip(rows, target)]


def test_targets_equal_rounds(spark):
    rng = random.Random(8)
    for n in (1, 2, 5, 9):
        sizes = [(f"s{i}" if i else None, rng.choice([0, 3, 40, 1000, 20000])) for i in range(n)]
        got = M.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()
        want = {s: t for s, _, t in plain_targets(sizes)}
        assert {r.source for r in got} == set(want) and all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def test_targets_share_and_stop(spark):
    rows = spark.createDataFrame([(None, 100), ("b", 10), ("a", 1000)], "source string, source_size long")
    got = sorted(((r.source, r.source_size, r.target) for r in M.targets(rows).collect()), key=lambda r: (r[0] is None, r[0]))
    assert [g[0] for g in got] == ["a", "b", None]
    assert abs(sum(g[2] for g in got) - 1110) < 1e-6
    assert got[1][2] == 30 and all(g[2] <= 3 * g[1] + 1e-9 for g in got)
    assert abs(got[0][2] / got[2][2] - 5) < 1e-9 or got[2][2] == 300


def test_mix_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "c", "d", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in M.mix(df).collect()}
    key = {r[0]: r[1] for r in df.select("doc_id", M.random_key(F.col("doc_id"), F.col("text"))).collect()}
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((key[i], i, len(t.split())))
    for s, n, target in plain_targets([(s, sum(x[2] for x in own)) for s, own in by.items()]):
        epochs, before = int(target // n), 0
        for _, i, size in sorted(by[s]):
            taken = epochs * size + (size if before + size / 2 < target - epochs * n else 0)
            assert (got[i].size, got[i].source_size, got[i].taken) == (size, n, taken)
            before += size
        assert abs(sum(got[x[1]].taken for x in by[s]) - target) <= 15


def test_buckets_make_no_difference(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 5 == 0]) for i in range(500)], "doc_id long, text string, source string")
    one = sorted(map(tuple, M.mix(df).collect()))
    monkeypatch.setattr(M, "BUCKET_ROWS", 20)
    assert sorted(map(tuple, M.mix(df).collect())) == one


def test_mix_of_odd_rows(odd_docs, no_docs):
    rows = M.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken == 0 for r in rows if r.size == 0) and all(r.taken <= 3 * r.size for r in rows)
    mixed = M.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert sum(len((r.text or "").replace("\x85", "").encode().split()) for r in mixed.collect()) > 0
    assert mixed.count() == sum(r.taken // r.size for r in rows if r.size)
    assert M.mix(no_docs).count() == 0 and M.mixed_documents(no_docs).count() == 0


@pytest.mark.parametrize("extra", ["s", "b", "at", "key", "times", "nth", "epochs", "target"])
def test_mix_keeps_columns_of_any_name(spark, extra):
    df = spark.createDataFrame([(i, "w " * (i % 7 + 1), "ab"[i % 5 == 0], i) for i in range(60)], f"doc_id long, text string, source string, {extra} int")
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns and all(r[3] == r.doc_id for r in mixed.collect())


@pytest.mark.parametrize("copies", [1, 2, 37])
def test_a_cut_among_equal_rows_takes_as_many_as_fit(spark, copies):
    rows = [(None, "one two three", "a")] * copies + [(i, "x " * (i % 4 + 1), "b") for i in range(30)] + [(1, "y z", None)] * 11
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, by = M.mix(df).collect(), {}
    assert len(got) == len(rows)
    for r in got:
        size, taken, target = by.get(r.source_size, (0, 0, 0))
        by[r.source_size] = (size + r.size, taken + r.taken, r.target)
    assert all(size == n and abs(taken - target) <= 1.5 + 1e-9 for n, (size, taken, target) in by.items())
    assert M.mixed_documents(df).count() == sum(r.taken // r.size for r in got)
