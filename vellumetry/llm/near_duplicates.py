"""Near duplicates by BagMinHash.

A document is the multiset of its 5-word shingles. Each shingle's weight
(its count) is discretised at the integers and covered by dyadic blocks
[0,1), [1,2), [2,4), [4,8) ...; each block of each shingle owns a Poisson
process whose rate is the block's length. A point falls in a register and, by
the bits below it, at a place in its block: it counts if that place lies under
the weight. A register keeps its earliest point, so two registers agree with
the probability of the weighted Jaccard similarity. Processes are followed
only up to the time by which all registers are filled.

Registers are banded. Texts that share a band are candidates; candidates are
verified on the exact multiset overlap. Exact copies are one node (by MD5).

A bucket doesn't emit all its pairs. Every text is first compared with the
bucket's ``leads``, the texts that meet most others. After the components of
the verified links are known, only pairs of a bucket that lie in different
components could change a class. Of those, pairs that cannot be similar enough
are left out by two exact bounds on what they share (``cross_pairs``): a text
shares with another at most what it shares with any other text that is left,
and at most its size less one for each bit of a hash set of its shingles that
the other's hash set lacks. No pair is dropped by a cap. (The shingles rarest
in the whole table, the usual prefix filter, don't tell apart copies of one
text, whose shingles are all about equally frequent.)

Null texts count as empty; empty texts are copies of each other and like
nothing else. Texts of 1 to 4 words are one shingle. Equal ids and null ids
are ordinary rows: nodes are texts. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumetry.llm.common import fresh, materialise, read_table, release, salted_join, utf8
from vellumetry.llm.graph import connected_components

SALTS = 32


@dataclass(frozen=True)
class Params:
    words: int = 5
    similarity: float = 0.8
    #: P(no shared band) at the limit: (1 - 0.8 ** 4) ** 20 = 0.00002
    bands: int = 20
    rows: int = 4
    #: texts of a bucket that all its others are compared with
    leads: int = 3
    #: 64-bit integers of a text's hash set of shingles
    longs: int = 32
    #: texts of a bucket that are compared in one task with all its others, about
    deal: int = 512
    #: signatures that a task remembers, so that copies are signed once
    memo: int = 20_000


_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_counts(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, shingle hash, count), in that order, of all texts' distinct shingles."""
    none = np.zeros(0, "i8"), np.zeros(0, "u8"), np.zeros(0, "i8")
    buf = np.frombuffer(b"\n".join(texts) + b"\n", "u1")
    seen = ~_WS[buf]
    edge = np.diff(seen.view("i1"), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return none
    length = ends - starts
    first = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(first, length)
    weights = mix(np.arange(length.max(), dtype="u8"))
    word = np.add.reduceat((buf[seen].astype("u8") + np.uint64(1)) * weights[place], first)
    word = mix(word ^ length.astype("u8"))
    text_starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    doc = np.searchsorted(text_starts, starts, "right") - 1
    n = np.bincount(doc, minlength=len(texts))
    size = np.minimum(n, k)[doc]  # words of a shingle
    last = np.cumsum(n)[doc]
    at = np.flatnonzero(np.arange(len(word)) + size <= last)
    h = np.zeros(len(at), "u8")
    for j in range(k):
        inside = size[at] > j
        h[inside] = mix(h[inside] ^ word[at[inside] + j])
    doc = doc[at]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
    return doc[new], h[new], np.diff(np.append(new, len(doc)))


def bag_min_hash(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m signatures of weighted sets; rows of documents without elements are 0."""
    out = np.zeros((n_docs, m), "u8")
    if not len(doc):
        return out
    weight = np.bincount(doc, count, n_docs)
    own, who, rate, low = [], [], [], []
    j, at = 0, np.arange(len(doc))
    while len(at):  # blocks [0,1), then [2**(j-1), 2**j)
        start = 0 if j == 0 else 1 << (j - 1)
        own.append(at)
        who.append(mix(h[at] ^ mix(np.full(1, j + 1, "u8"))))
        rate.append(np.full(len(at), max(1, start), "f8"))
        low.append(np.full(len(at), start, "i8"))
        at = at[count[at] > max(1, 2 * start)] if j else at[count[at] > 1]
        j += 1
    own, who, rate, low = map(np.concatenate, (own, who, rate, low))
    slack = 4.0
    todo = np.unique(doc)
    live = np.ones(len(own), bool)
    while len(todo):
        until = np.zeros(n_docs)
        until[todo] = (np.log(m) + slack) * m / weight[todo]
        o, w, r, lo = own[live], who[live], rate[live], low[live]
        t = np.zeros(len(o))
        xs, slots, ids = [], [], []
        i = 0
        while len(o):
            z = mix(w + np.uint64(2 * i + 1))
            t = t - np.log1p(-((z >> np.uint64(11)) * 2.0**-53)) / r
            on = t < until[doc[o]]
            o, w, r, lo, t, z = o[on], w[on], r[on], lo[on], t[on], z[on]
            y = mix(z ^ _M2)
            place = lo + ((y >> np.uint64(32)).astype("i8") * r.astype("i8") >> 32)
            under = place < count[o]
            xs.append(t[under])
            slots.append(doc[o[under]] * m + (y[under] & np.uint64(0xFFFFFFFF)).astype("i8") * m // (1 << 32))
            ids.append(z[under])
            i += 1
        x, slot, z = map(np.concatenate, (xs, slots, ids))
        order = np.argsort(-x, kind="stable")
        flat, filled = np.zeros(n_docs * m, "u8"), np.zeros(n_docs * m, bool)
        flat[slot[order]] = z[order]  # of equal slots the last, earliest point stays
        filled[slot] = True
        whole = filled.reshape(n_docs, m).all(1)
        ready = todo[whole[todo]]
        out[ready] = flat.reshape(n_docs, m)[ready]
        todo = todo[~whole[todo]]
        live = np.isin(doc[own], todo)
        slack = 2 * slack + 8
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands 64-bit keys."""
    keys = np.repeat(mix(np.arange(1, bands + 1, dtype="u8"))[None], len(signatures), 0)
    for j in range(rows):
        keys = mix(keys ^ signatures[:, j::rows][:, :bands])
    return keys.view("i8")


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Of (sorted distinct hashes, counts)."""
    total = int(a[1].sum() + b[1].sum())
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return both / (total - both) if total > both else 1.0


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, t) -> doc_id, node (MD5 of the text), n (shingles) and keys of its bands.

    A copy of a text that its task has signed lately has no n and no keys.
    """

    def run(batches):
        signed: set = set()
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                if len(signed) > p.memo:
                    signed.clear()
                nodes, new = part.column(1).to_pylist(), []
                for i, node in enumerate(nodes):
                    if node not in signed:
                        signed.add(node)
                        new.append(i)
                texts = [utf8(t) for t in part.column(2).take(pa.array(new, pa.int64())).to_pylist()]
                doc, h, count = shingle_counts(texts, p.words) if texts else (np.zeros(0, "i8"), np.zeros(0, "u8"), np.zeros(0, "i8"))
                keys = band_keys(bag_min_hash(doc, h, count, len(texts), p.bands * p.rows), p.bands, p.rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype="i4") * p.bands), pa.array(keys.reshape(-1)))
                at = np.full(len(nodes), -1)
                at[new] = np.arange(len(new))
                at = pa.array(at, mask=at < 0)
                n = pa.array(np.bincount(doc, count, len(texts)).astype("i8"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n.take(at), lists.take(at)], ["doc_id", "node", "n", "keys"])
        signed.clear()
        release()

    rows = docs.select("doc_id", F.unhex(F.md5(F.col("t").cast("binary"))).alias("node"), "t")
    return rows.mapInArrow(run, "doc_id long, node binary, n long, keys array<long>")


def verify(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Those of distinct pairs (a, b) of nodes whose texts are similar enough."""
    of = lambda side: texts.select(F.col("node").alias(f"{side}_node"), F.col("t").alias(f"{side}_text"))
    both = pairs.join(of("a"), F.col("a") == F.col("a_node")).drop("a_node").join(of("b"), F.col("b") == F.col("b_node")).drop("b_node")

    def run(batches):
        kept: dict = {}
        for b in batches:
            for part in (b.slice(i, 128) for i in range(0, b.num_rows, 128)):
                ids = part.column(0).to_pylist() + part.column(1).to_pylist()
                texts = part.column(2).to_pylist() + part.column(3).to_pylist()
                new = {i: t for i, t in zip(ids, texts) if i not in kept}
                if len(kept) > 256:
                    kept = {i: kept[i] for i in set(ids) & kept.keys()}
                doc, h, count = shingle_counts([utf8(t) for t in new.values()], p.words)
                ends = np.searchsorted(doc, np.arange(len(new) + 1))
                for i, lo, hi in zip(new, ends, ends[1:]):
                    kept[i] = (h[lo:hi], count[lo:hi])
                a, z = ids[: part.num_rows], ids[part.num_rows :]
                good = [weighted_jaccard(kept[i], kept[j]) >= p.similarity for i, j in zip(a, z)]
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a binary, b binary")


def shingle_rows(texts: DataFrame, p: Params) -> DataFrame:
    """node, h and c: the distinct shingles of each text and their counts."""

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                doc, h, count = shingle_counts([utf8(t) for t in part.column(1).to_pylist()], p.words)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(h.view("i8")), pa.array(count)], ["node", "h", "c"])

    return texts.select("node", "t").mapInArrow(run, "node binary, h long, c long")


def hash_sets(texts: DataFrame, p: Params) -> DataFrame:
    """node and bits: a hash set of the text's shingles."""

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                doc, h, _ = shingle_counts([utf8(t) for t in part.column(1).to_pylist()], p.words)
                sets = np.zeros((part.num_rows, p.longs * 64), bool)
                sets[doc, (mix(h) % np.uint64(p.longs * 64)).astype("i8")] = True
                longs = np.packbits(sets, axis=1, bitorder="little").view("<i8").reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype="i4") * p.longs), pa.array(longs))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "bits"])

    return texts.select("node", "t").mapInArrow(run, "node binary, bits array<long>")


def cross_pairs(rest: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of a bucket in different components that may be similar enough.

    rest: band, key, node, n, component. A pair is made in the first bucket that
    both are in, and only if both bounds on what the two share allow the
    similarity. One side of a large bucket is dealt out, the other repeated.
    """
    t, slack = p.similarity, 1e-6
    own = rest.select("node", "n").distinct()
    own = materialise(texts.join(own.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).drop("m"), "own")
    rows = materialise(shingle_rows(own, p), "shingles")
    common = rows.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select(F.col("h").alias("__h"))
    shared = rows.join(common, F.col("h") == F.col("__h")).groupBy("node").agg(F.sum("c").alias("shared"))
    sets = own.join(shared.withColumnRenamed("node", "m"), F.col("node") == F.col("m")).where(F.col("shared") >= t * F.col("n") - slack)
    bits = hash_sets(sets, p).withColumnRenamed("node", "k")
    facts = sets.select("m", "shared").join(bits, F.col("m") == F.col("k")).drop("k")
    at = rest.groupBy(F.col("node").alias("k")).agg(F.map_from_entries(F.collect_list(F.struct("band", "key"))).alias("keys"))
    at = at.select("k", F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: F.try_element_at("keys", i)).alias("keys"))
    left = materialise(rest.join(facts, F.col("node") == F.col("m")).join(at, F.col("node") == F.col("k")).drop("m", "k"), "rest")
    sizes = left.groupBy(F.col("band").alias("__b"), F.col("key").alias("__k")).agg(F.ceil(F.count("*") / p.deal).cast("int").alias("deals")).where("deals > 0")
    left = materialise(left.join(sizes, (F.col("band") == F.col("__b")) & (F.col("key") == F.col("__k"))).drop("__b", "__k"), "dealt")

    right = left.select(*(F.col(c).alias(f"r_{c}") for c in left.columns if c != "deals"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("r_deal"))
    left = left.withColumn("deal", F.pmod(F.xxhash64("node"), F.col("deals")).cast("int")).drop("deals")
    bucket = (F.col("band") == F.col("r_band")) & (F.col("key") == F.col("r_key")) & (F.col("deal") == F.col("r_deal"))
    others = (F.col("node") < F.col("r_node")) & (F.col("component") != F.col("r_component"))
    alike = F.least("n", "r_n") >= t * F.greatest("n", "r_n") - slack
    needed = t / (1 + t) * (F.col("n") + F.col("r_n")) - slack
    earlier = F.expr("exists(sequence(0, band), i -> i < band AND coalesce(keys[i] = r_keys[i], false))")
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseAND(F.bitwise_not(j)))), F.lit(0), lambda s, v: s + v)
    overlap = F.least(F.col("n") - lacks("bits", "r_bits"), F.col("r_n") - lacks("r_bits", "bits"))
    may = others & alike & (F.least("shared", "r_shared") >= needed) & ~earlier & (overlap >= needed)
    return left.join(right, bucket & may).select(F.col("node").alias("a"), F.col("r_node").alias("b"))


def near_duplicate_classes(df: DataFrame, p: Params = Params(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node, class_id (the least id of the class), component and links of each document.

    Classes are told apart by ``component``, their least node: several may have
    the same least id, or none. ``links`` counts the other texts that a text was
    verified against and found similar; links are looked for until classes are
    known, so pairs within a class aren't all counted.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    signed = materialise(signatures(docs, p), "signatures")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.first("keys", ignorenulls=True).alias("keys"))
    nodes = materialise(nodes, "nodes")
    banded = nodes.where("n > 0").select("node", "n", F.posexplode("keys").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1").withColumnsRenamed({"band": "__b", "key": "__k"})
    bucket = (F.col("band") == F.col("__b")) & (F.col("key") == F.col("__k"))
    members = materialise(banded.join(buckets, bucket).select("band", "key", "node", "n", "size"), "members")
    alike = lambda x, y: F.least(x, y) >= p.similarity * F.greatest(x, y) - 1e-6
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    inside = members.groupBy(F.col("node").alias("m")).agg(F.sum("size").alias("popular"))
    rows = docs.withColumn("node", F.unhex(F.md5(F.col("t").cast("binary"))))
    firsts = nodes.join(inside, F.col("node") == F.col("m")).select("m", "first")
    texts = rows.join(firsts, (F.col("node") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "t")
    texts = materialise(texts.dropDuplicates(["node"]), "candidates")

    # all of a bucket against the texts that most others meet
    nth = F.row_number().over(Window.partitionBy("band", "key").orderBy(F.desc("popular"), "node"))
    leads = members.join(inside, F.col("node") == F.col("m")).withColumn("nth", nth).where(F.col("nth") <= p.leads)
    leads = materialise(leads.select(F.col("band").alias("__b"), F.col("key").alias("__k"), F.col("node").alias("lead"), F.col("n").alias("lead_n")), "leads")
    stars = members.join(leads, bucket).where((F.col("node") != F.col("lead")) & alike(F.col("n"), F.col("lead_n")))
    links = materialise(verify(stars.select(*pair("node", "lead")).distinct(), texts, p), "links")
    groups = connected_components(links)

    # what is left: texts of a bucket that lie in different components
    placed = members.join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left")
    placed = placed.select("band", "key", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select(F.col("band").alias("__b"), F.col("key").alias("__k"))
    led = leads.select(F.col("__b").alias("lb"), F.col("__k").alias("lk"), "lead")
    rest = placed.join(mixed, bucket).join(led, (F.col("band") == F.col("lb")) & (F.col("key") == F.col("lk")) & (F.col("node") == F.col("lead")), "left_anti")
    rest = materialise(rest.select("band", "key", "node", "n", "component"), "rest")
    more = materialise(verify(cross_pairs(rest, texts, p), texts, p), "links")
    # the first components are joined by the new links
    of = lambda side: groups.select(F.col("node").alias(f"{side}_n"), F.col("component").alias(f"{side}_c"))
    between = more.join(of("a"), F.col("a") == F.col("a_n"), "left").join(of("b"), F.col("b") == F.col("b_n"), "left")
    merged = connected_components(between.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")))
    merged = merged.select(F.col("node").alias("x"), F.col("component").alias("into"))
    ends = links.union(more)
    degree = ends.select(F.explode(F.array("a", "b")).alias("d")).groupBy("d").agg(F.count("*").alias("links"))

    placed = nodes.select("node", "first").join(groups.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left")
    placed = placed.select("node", "first", F.coalesce("component", "node").alias("own"))
    classed = placed.join(merged, F.col("own") == F.col("x"), "left").select("node", "first", F.coalesce("into", "own").alias("component"))
    classed = classed.join(degree, F.col("node") == F.col("d"), "left").select("node", "first", "component", F.coalesce("links", F.lit(0)).alias("links"))
    least = classed.groupBy("component").agg(F.min("first").alias("class_id")).withColumnRenamed("component", "c")
    by_node = classed.join(least, F.col("component") == F.col("c")).select("node", "class_id", "component", "links")
    return salted_join(signed.select("doc_id", "node"), by_node, ["node"], SALTS, F.col("doc_id"))


def deduplicate(df: DataFrame, p: Params = Params(), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class: that with the least id, with all its columns; of several with that id, one of the least node."""
    classes = near_duplicate_classes(df, p, doc_id=doc_id, text=text)
    own, nth, of_class, of_node = fresh(df.columns, "own", "nth", "of_class", "of_node")
    least = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = least.groupBy("component", F.col("class_id").alias(of_class)).agg(F.min("node").alias(of_node)).drop("component")
    node = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = df.withColumn(own, node)
    rows = rows.join(kept, rows[doc_id].cast("long").eqNullSafe(kept[of_class]) & (rows[own] == kept[of_node]))
    again = Window.partitionBy(own).orderBy(of_class)
    return rows.withColumn(nth, F.row_number().over(again)).where(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in df.columns))


def op4_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.lower(F.hex("component")).alias("component"), "links")
