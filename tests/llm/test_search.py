import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellumetry.llm import near_duplicates as N
from vellumetry.llm import neighbours as B
from vellumetry.llm import warc as W
from vellumetry.llm.common import work_dir
from vellumetry.llm.graph import connected_components


def brute_classes(rows, limit=0.8):
    bags = []
    for _, t in rows:
        w = (t or "").encode().split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            total = sum(bags[i].values()) + sum(bags[j].values()) - both
            if (rows[i][1] or "") == (rows[j][1] or "") or (total and both / total >= limit):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    known = lambda g: [d for d in g if d is not None]
    return Counter((d, min(known(least[find(i)]), default=None)) for i, (d, _) in enumerate(rows))


def near_copies(words):
    rng = random.Random(11)
    rows = []
    for g in range(25):
        base = words(rng.randint(20, 200), f"g{g}").split()
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = f"q{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    chain = words(100, "chain").split()  # each like the one before, the ends unlike
    for i in range(8):
        chain[i * 11 + 3] = f"c{i}"
        rows.append((len(rows), " ".join(chain)))
    shared = words(40, "shared")  # a passage in many texts
    rows += [(len(rows) + i, words(60, f"p{i}") + " " + shared) for i in range(40)]
    rows += [(len(rows) + i, ("la " * 300) + words(n, "r")) for i, n in enumerate((10, 30, 200))]
    return rows


def test_classes_equal_brute_force(spark, words):
    rows = near_copies(words)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id) for r in N.near_duplicate_classes(df).collect())
    assert got == brute_classes(rows)
    kept = sorted(r.doc_id for r in N.deduplicate(df).collect())
    assert kept == sorted({c for _, c in got})


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter((r.doc_id, r.class_id) for r in N.near_duplicate_classes(odd_docs).collect()) == brute_classes(rows)
    kept = N.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({c if c is not None else "none" for _, c in brute_classes(rows)})
    assert N.near_duplicate_classes(no_docs).count() == 0 and N.deduplicate(no_docs).count() == 0


def test_recall_by_similarity(words):
    """Of pairs in each bin of similarity from 0.8 on, at least nine tenths share a band."""
    rng, p = random.Random(12), N.Params()
    found = defaultdict(list)
    for g in range(400):
        a = words(rng.randint(60, 400), f"bin{g}").split()
        b = list(a)
        for _ in range(rng.randint(1, max(1, len(a) // 45))):
            b[rng.randrange(len(b))] = f"z{rng.random()}"
        doc, h, count = N.shingle_counts([" ".join(t).encode() for t in (a, b)], p.words)
        at = np.searchsorted(doc, 1)
        j = N.weighted_jaccard((h[:at], count[:at]), (h[at:], count[at:]))
        keys = N.band_keys(N.bag_min_hash(doc, h, count, 2, p.bands * p.rows), p.bands, p.rows)
        if j >= 0.8:
            found[int(j * 20)].append((keys[0] == keys[1]).any())
    assert {16, 17, 18} <= set(found) and all(np.mean(v) >= 0.99 for v in found.values() if len(v) > 20)


def test_classes_without_an_id_of_their_own_all_stay(spark, words):
    """Different texts with null or equal ids are different classes; copies and near copies of them are not."""
    a, b, c, d = (words(80, f"own{i}") for i in range(4))
    rows = [(None, a), (None, b), (None, b), (None, b + " more"), (7, c), (7, d), (7, d), (8, d + " more"), (9, a + " more"), (None, None), (None, " ")]
    kept = N.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near_b = {(None, b), (None, b + " more")}
    got = [(r.doc_id, r.text) for r in kept]
    assert len(set(got) & near_b) == 1
    assert Counter(x for x in got if x not in near_b) == Counter([(9, a + " more"), (7, c), (7, d), (None, None), (None, " ")])


@pytest.mark.parametrize("a,b", [({1: 3, 2: 5, 3: 1, 4: 9}, {1: 2, 2: 7, 3: 1, 5: 4}), ({i: 1 for i in range(100)}, {i: 1 for i in range(20, 120)}), ({1: 1000, 2: 3}, {1: 700, 2: 9, 4: 100})])
def test_signatures_are_unbiased(a, b):
    rows = sorted((2 * r + s, int(N.mix(np.array([k + 1000003 * r], "u8"))[0]), c) for r in range(100) for s, x in enumerate((a, b)) for k, c in x.items())
    sig = N.bag_min_hash(*(np.array(c, t) for c, t in zip(zip(*rows), ("i8", "u8", "i8"))), 200, 80)
    every = set(a) | set(b)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in every) / sum(max(a.get(k, 0), b.get(k, 0)) for k in every)
    assert abs((sig[::2] == sig[1::2]).mean() - want) < 4 * (want * (1 - want) / 8000) ** 0.5


def test_shingles_equal_brute_force(words):
    texts = [words(n, f"s{n}") for n in (0, 1, 3, 4, 5, 6, 80)] + ["a b a b a b a b a b", " \n x\ty "]
    doc, h, count = N.shingle_counts([t.encode() for t in texts], 5)
    for i, t in enumerate(texts):
        w = t.split()
        bag = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
        assert sorted(count[doc == i]) == sorted(bag.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- nearest neighbours -----------------------------------------------------------


def brute_nearest(ids, x, queries, k=20):
    out = {}
    for q in queries:
        s = (x[ids == q][0] * x).sum(1)
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = ids[keep][order].tolist()
    return out


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")


def recall(got, want):
    return np.mean([len(set(got.get(q, [])) & set(w)) / len(w) for q, w in want.items()])


def nearest(df, p=B.Params()):
    rows = B.nearest(df, F.col("vec_id") % 20 == 0, p).orderBy("query_id", "rank").collect()
    out = defaultdict(list)
    for r in rows:
        out[r.query_id].append(r.vec_id)
        assert r["rank"] == len(out[r.query_id])
    return dict(out), rows


def brute_rows(rows, queries, k=20):
    """Every row against every other, ties to the smaller id: (query_id, rank, vec_id, score), in any order."""
    out = Counter()
    for i, (q, v) in enumerate(rows):
        if q in queries:
            every = sorted((-float((np.array(v, "f4").astype("f8") * np.array(w, "f4").astype("f8")).sum()), c) for j, (c, w) in enumerate(rows) if j != i)
            out.update((q, r, c, round(-s, 9)) for r, (s, c) in enumerate(every[:k], 1))
    return out


@pytest.mark.parametrize("n,structure", [(500, 0), (2000, 0), (4000, 40), (30, 0), (2, 0)])
def test_recall_at_the_shipped_parameters(spark, n, structure):
    """The share of vectors ranked is far below all where vectors have structure."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, 16)) * (0.3 if structure else 1)
    if structure:
        x += rng.standard_normal((structure, 16))[rng.integers(0, structure, n)]
    x = x.astype("f4")
    facts, df = {}, vectors(spark, x)
    rows = B.nearest(df, F.col("vec_id") % 20 == 0, facts=facts).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
        assert r["rank"] == len(got[r.query_id]) and abs(r.score - (x[r.query_id].astype("f8") * x[r.vec_id].astype("f8")).sum()) < 1e-12
    assert recall(got, brute_nearest(np.arange(n), x.astype("f8"), range(0, n, 20))) >= 0.9
    assert all(len(v) == min(20, n - 1) for v in got.values())
    assert facts["parts"] == max(1, min(max(2, round(n**0.5 / 4)), n // 16))
    order, before = facts["router"].mass(x[::20].astype("f8"))
    size = np.bincount(facts["router"].ranked(x.astype("f8"))[:, 0], minlength=facts["parts"])
    if structure:
        assert (size[order] * (before <= facts["mass"])).sum(1).mean() < 0.5 * n


def test_copies_tie_to_the_least_ids(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 6)).astype("f4")
    x[50:150] = x[50]
    got, _ = nearest(vectors(spark, x), B.Params(recall=1.0))
    assert got == brute_nearest(np.arange(200), x.astype("f8"), range(0, 200, 20))


def test_repeated_ids_and_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(5).astype("f4").tolist()) for i in range(60)]
    rows += rows[20:21] * 3 + rows[:1] + [(20, rng.standard_normal(5).astype("f4").tolist()), (40, rows[3][1]), (3, rows[3][1]), (40, rows[3][1])] + rows[7:8] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in B.nearest(df, F.col("vec_id") % 20 == 0, B.Params(recall=1.0)).collect())
    assert got == brute_rows(rows, {0, 20, 40})
    few = rows[:1] * 3
    got = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in B.nearest(spark.createDataFrame(few, df.schema), F.col("vec_id") % 20 == 0).collect())
    assert got == brute_rows(few, {0})


@pytest.mark.parametrize("distinct", [40, 64])
def test_few_distinct_vectors(spark, distinct):
    x = np.random.default_rng(6).standard_normal((distinct, 8)).astype("f4")[np.arange(5000) % distinct]
    got, _ = nearest(vectors(spark, x), B.Params(recall=1.0))
    assert got == brute_nearest(np.arange(5000), x.astype("f8"), range(0, 5000, 20))


def test_dealt_parts_give_the_same(spark):
    x = np.random.default_rng(9).standard_normal((700, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert nearest(df, B.Params(spread=50, block=16, query_block=3))[0] == nearest(df)[0]


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [0.0, -1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    assert nearest(df)[0] == {0: [8, 8, 20], 20: [0, 8, 8]}
    assert nearest(df.limit(0))[0] == {} and nearest(df.where("vec_id = 3"))[0] == {}


def test_parts_are_balanced():
    x = np.random.default_rng(4).standard_normal((500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part, graph = B.partition_graph(x, 5, B.Params())
    assert np.bincount(part).max() <= 100
    assert (part[graph] == part[:, None]).mean() > 0.4  # a fifth by chance


# ---- archives ---------------------------------------------------------------------


def test_versions_of_archives():
    import io

    for version in (1, 2):
        arc = W.arc_version_block("f.arc", version, "20010203040506") + W.arc_record(version, "http://a/", "2001", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\nwith\n\nlines") + b"\n" + W.arc_record(version, "http://b/", "20010203040506", b"", status=404)
        a, b = W.read_arc(io.BytesIO(arc))
        assert (a.url, a.content[-5:], b.url, b.content, b.status) == ("http://a/", b"lines", "http://b/", b"", 404 if version == 2 else None)
        (fields, block), = W.read_warc(io.BytesIO(W.to_warc(a, W.record_id("x"))))
        assert fields["WARC-Date"] == "2001-01-01T00:00:00Z" and fields["WARC-Type"] == "response" and block == a.content
        assert fields["WARC-Payload-Digest"] == W.sha1_base32(b"body\nwith\n\nlines")
    for bad in (b"filedesc://x 0 0 text/plain 30\n1 0", b"http://a/ 0 0 t 0\n", W.arc_version_block("f", 1, "2001") + b"http://a/ 0 2001 0\n"):
        with pytest.raises(W.ArcError):
            list(W.read_arc(io.BytesIO(bad)))


def test_pages_equal_sql(spark):
    big, bigger = "é" * 600, "y" * 5000
    rows = [(1, "http://a/ b", big), (2, "http://a", big), (5, None, big), (5, None, big), (None, "u", big), (None, "u", "z" * 2000), (3, "x", None), (4, "x", ""), (6, "x", "small"), (7, "x", "small"), *((i, "m", bigger) for i in range(20, 80)), (99, "w", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 40)]
    df = spark.createDataFrame([(i, u, h, "c") for i, u, h in rows], "page_id long, url string, html string, d string")
    folder = work_dir(spark, "w")
    got = W.read_warc_files(spark, folder, W.convert_pages(df, folder)).toPandas()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    want = con.sql(W.OP10_SQL).df()
    norm = lambda d: Counter(tuple(None if pd.isna(v) else v for v in r) for r in d[list(want.columns)].itertuples(index=False))
    assert norm(got) == norm(want)
    empty = work_dir(spark, "w")
    assert W.read_warc_files(spark, empty, W.convert_pages(df.limit(0), empty)).count() == 0
