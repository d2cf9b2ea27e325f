"""Toxicity: a bidirectional gated recurrent network over words and their characters.

A word's input is the sum of a hashed word embedding and the mean of hashed
embeddings of its character trigrams. Forward and backward gated recurrent
units read a window of words; attention pools their states; a logistic layer
scores the window. Windows overlap by half and cover the whole text; a
document has its highest window's score. Training is plain numpy on the
driver; scoring is numpy on the executors.

Labels are of documents, so training learns from windows in two turns: first
from the window of a toxic document that holds the words most peculiar to
toxic documents, then from the window that the network itself scores highest;
of clean documents, from random and from highest windows.

The classifier is fitted on a bounded sample of distinct texts: of each class
at most ``max_documents``, those of least MD5, as far as they have ``max_bytes``
together (a longer text than is left is passed over). Rows whose
crc32(doc_id as text) mod 4 is 2 are never learnt from. Only the text is an input of a score.

Null and empty texts are scored as one empty window. Null labels and labels of
null ids are left out; repeated labels count as toxic if one is. Equal texts
get equal scores. Without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumetry.llm.common import materialise, read_table, release, utf8

STRIP = b".,;:!?\"'()[]{}*-_#$%&|<>"


@dataclass(frozen=True)
class Params:
    window: int = 32
    stride: int = 16
    hidden: int = 8
    size: int = 16
    attention: int = 8
    word_slots: int = 1 << 14
    char_slots: int = 1 << 14
    #: the classifier's sample: documents of each class
    max_documents: int = 2500
    #: and their UTF-8 bytes, of each class: what reaches the driver
    max_bytes: int = 8 << 20
    batch: int = 512
    rate: float = 0.02
    turns: tuple = (3, 3)
    threshold: float = 0.3
    seed: int = 7


def slots_of(word: bytes, p: Params) -> tuple[int, list[int]]:
    """The word's slot and its trigrams'."""
    w = b"^" + word.lower().strip(STRIP) + b"$"
    n = p.char_slots - 1
    crc = zlib.crc32
    return crc(w) & (p.word_slots - 1), [crc(w[i : i + 3]) & n for i in range(max(1, len(w) - 2))]


def window_starts(n: int, p: Params) -> range:
    """Starts of overlapping windows that cover n words; one even if there are none."""
    return range(0, max(1, n - p.window + p.stride), p.stride)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gru(xw: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool):
    """xw (steps, 3H, batch), mask (steps, batch) -> states (steps, H, batch) and what the way back needs."""
    steps, three, batch = xw.shape
    n = three // 3
    h = np.zeros((n, batch), xw.dtype)
    out = np.empty((steps, n, batch), xw.dtype)
    saved = []
    for t in range(steps):
        a = u @ h
        g = 1 / (1 + np.exp(-(xw[t, : 2 * n] + a[: 2 * n])))
        r, z = g[:n], g[n:]
        new = np.tanh(xw[t, 2 * n :] + r * a[2 * n :])
        after = new + z * (h - new)
        after = h + mask[t] * (after - h)
        if keep:
            saved.append((h, r, z, new, a[2 * n :]))
        out[t] = h = after
    return out, saved


def gru_back(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, saved: list):
    """Gradients of xw and u."""
    steps, n, batch = d_out.shape
    d_xw = np.empty((steps, 3 * n, batch), d_out.dtype)
    d_u, d_h = np.zeros_like(u), np.zeros((n, batch), d_out.dtype)
    for t in reversed(range(steps)):
        h, r, z, new, a = saved[t]
        d = d_h + d_out[t]
        own = d * mask[t]
        d_new = own * (1 - z) * (1 - new * new)
        d_z = own * (h - new) * z * (1 - z)
        d_r = d_new * a * r * (1 - r)
        d_xw[t] = np.concatenate([d_r, d_z, d_new])
        d_a = np.concatenate([d_r, d_z, d_new * r])
        d_u += d_a @ h.T
        d_h = d - own + own * z + u.T @ d_a
    return d_xw, d_u


def initial(p: Params) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    e, h, a = p.size, p.hidden, p.attention
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype("f4")
    return {
        "words": draw(p.word_slots, e, scale=0.1),
        "chars": draw(p.char_slots, e, scale=0.3),
        "w": draw(e, 6 * h, scale=e**-0.5),
        "b": np.zeros(6 * h, "f4"),
        "uf": draw(3 * h, h, scale=h**-0.5),
        "ub": draw(3 * h, h, scale=h**-0.5),
        "wa": draw(a, 2 * h, scale=(2 * h) ** -0.5),
        "va": draw(a, scale=a**-0.5),
        "wo": draw(2 * h, scale=(2 * h) ** -0.5),
        "bo": np.zeros(1, "f4"),
        "scale": np.array([1.0, 0.0], "f4"),
    }


def embed(m: dict, slots: np.ndarray, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Inputs of words given their slots and, one after the other, their trigrams' up to each end."""
    out = np.empty((len(slots), m["chars"].shape[1]), "f4")
    first = np.append(0, ends[:-1])
    for lo in range(0, len(slots), 1 << 14):  # bounds the memory that the trigrams take
        a, z = first[lo : lo + (1 << 14)], ends[lo : lo + (1 << 14)]
        mean = np.add.reduceat(m["chars"][grams[a[0] : z[-1]]], a - a[0], axis=0) / (z - a)[:, None]
        out[lo : lo + len(a)] = m["words"][slots[lo : lo + len(a)]] + mean
    return out


def forward(m: dict, xw: np.ndarray, mask: np.ndarray, keep: bool = False):
    """xw (steps, batch, 6H), mask (steps, batch) -> logits."""
    h3 = xw.shape[2] // 2
    xt = np.ascontiguousarray(xw.transpose(0, 2, 1))
    ahead, saved_f = gru(xt[:, :h3], mask, m["uf"], keep)
    back, saved_b = gru(xt[::-1, h3:], mask[::-1], m["ub"], keep)
    states = np.concatenate([ahead, back[::-1]], 1)
    act = np.tanh(m["wa"] @ states)
    e = np.where(mask > 0, np.einsum("a,tab->tb", m["va"], act), -1e9)
    w = np.exp(e - e.max(0)) * mask
    w = w / np.maximum(w.sum(0), 1e-9)
    pooled = np.einsum("tb,thb->hb", w, states)
    logit = m["wo"] @ pooled + m["bo"][0]
    return (logit, (saved_f, saved_b, states, act, w, pooled)) if keep else logit


def backward(m: dict, xw: np.ndarray, mask: np.ndarray, cache: tuple, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    saved_f, saved_b, states, act, w, pooled = cache
    n = states.shape[1] // 2
    g = {"wo": pooled @ d_logit, "bo": np.array([d_logit.sum()], "f4")}
    d_pooled = m["wo"][:, None] * d_logit
    d_w = np.einsum("hb,thb->tb", d_pooled, states)
    d_e = w * (d_w - (w * d_w).sum(0))
    d_act = m["va"][None, :, None] * d_e[:, None] * (1 - act * act)
    g["va"] = np.einsum("tb,tab->a", d_e, act)
    g["wa"] = np.einsum("tab,thb->ah", d_act, states)
    d_states = w[:, None] * d_pooled[None] + m["wa"].T @ d_act
    d_f, g["uf"] = gru_back(d_states[:, :n], mask, m["uf"], saved_f)
    d_b, g["ub"] = gru_back(d_states[::-1, n:], mask[::-1], m["ub"], saved_b)
    d_xw = np.concatenate([d_f, d_b[::-1]], 1).transpose(0, 2, 1)
    return g, d_xw


class Windows:
    """Windows of documents as indices of their vocabulary."""

    def __init__(self, texts: list[bytes], p: Params):
        self.p, self.vocabulary = p, {}
        slots, grams, ends = array("i"), array("i"), array("i")
        self.words: list[np.ndarray] = []
        for t in texts:
            own = []
            for w in t.split():
                i = self.vocabulary.get(w)
                if i is None:
                    i = self.vocabulary[w] = len(slots)
                    s, g = slots_of(w, p)
                    slots.append(s)
                    grams.extend(g)
                    ends.append(len(grams))
                own.append(i)
            self.words.append(np.array(own, "i4"))
        self.slots, self.grams, self.ends = (np.array(x, "i4") for x in (slots, grams, ends))
        starts = [(d, s) for d, w in enumerate(self.words) for s in window_starts(len(w), p)]
        self.doc = np.array([d for d, _ in starts], "i8")
        self.start = np.array([s for _, s in starts], "i8")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps, batch) of word indices, and the mask."""
        idx = np.zeros((self.p.window, len(which)), "i8")
        mask = np.zeros((self.p.window, len(which)), "f4")
        for j, k in enumerate(which):
            w = self.words[self.doc[k]][self.start[k] : self.start[k] + self.p.window]
            idx[: len(w), j] = w
            mask[: len(w), j] = 1
        return idx, mask

    def logits(self, m: dict) -> np.ndarray:
        """Of all windows."""
        table = np.zeros((len(self.slots) + 1, m["w"].shape[1]), "f4")
        np.matmul(embed(m, self.slots, self.grams, self.ends), m["w"], out=table[:-1])
        table[:-1] += m["b"]
        out = []
        for lo in range(0, len(self.doc), 2048):
            idx, mask = self.take(np.arange(lo, min(lo + 2048, len(self.doc))))
            out.append(forward(m, table[idx], mask))
        return np.concatenate(out) if out else np.zeros(0, "f4")


def peculiar_words(win: Windows, toxic: np.ndarray) -> np.ndarray:
    """Log odds of each word's being in a toxic document; 0 for the rare."""
    count = [Counter(), Counter()]
    for w, t in zip(win.words, toxic):
        count[int(t)].update(set(w.tolist()))
    n = np.array([max(1, (toxic == 0).sum()), max(1, (toxic == 1).sum())])
    score = np.zeros(len(win.vocabulary) + 1)
    for i, c in count[1].items():
        if c >= 3:
            score[i] = np.log((c + 0.5) / n[1]) - np.log((count[0][i] + 0.5) / n[0])
    return score


def train(texts: list[bytes], toxic: list[int], p: Params = Params()) -> dict[str, np.ndarray]:
    """A model of the labelled texts; equal texts are learnt from once."""
    seen: dict[bytes, int] = {}
    for t, y in zip(texts, toxic):
        seen[t] = max(y, seen.get(t, 0))
    m = initial(p)
    if len(set(seen.values())) < 2:
        m["scale"][:] = 0.0, -30.0
        return m
    texts, y = list(seen), np.array(list(seen.values()))
    rng = np.random.default_rng(p.seed)
    order = rng.permutation(len(texts))
    texts, y = [texts[i] for i in order], y[order]
    win = Windows(texts, p)
    odds = peculiar_words(win, y)
    best = np.array([max(range(a, z), key=lambda k: odds[win.words[win.doc[k]][win.start[k] : win.start[k] + p.window]].max(initial=0.0)) for a, z in zip(win.first, win.first[1:])])
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items() if k != "scale"}
    step = 0
    clean_windows = np.flatnonzero(y[win.doc] == 0)
    for turn, epochs in enumerate(p.turns):
        if turn:
            logit = win.logits(m)
            best = np.array([a + int(np.argmax(logit[a:z])) for a, z in zip(win.first, win.first[1:])])
        for _ in range(epochs):
            positive = best[y == 1]
            negative = np.concatenate([best[y == 0], rng.choice(clean_windows, min(len(clean_windows), 2 * int((y == 0).sum())), replace=False)])
            which = rng.permutation(np.concatenate([positive, negative]))
            for lo in range(0, len(which), p.batch):
                part = which[lo : lo + p.batch]
                idx, mask = win.take(part)
                used, at = np.unique(idx, return_inverse=True)
                at = at.reshape(idx.shape)
                lengths = win.ends[used] - np.where(used > 0, win.ends[used - 1], 0)
                ends = np.cumsum(lengths)
                grams = win.grams[np.arange(ends[-1]) + np.repeat(win.ends[used] - ends, lengths)]
                x = embed(m, win.slots[used], grams, ends)
                xw = (x @ m["w"] + m["b"])[at]
                logit, cache = forward(m, xw, mask, True)
                target = y[win.doc[part]]
                d = ((sigmoid(logit) - target) / len(part)).astype("f4")
                g, d_xw = backward(m, xw, mask, cache, d)
                d_used = np.zeros((len(used), d_xw.shape[2]), "f4")
                np.add.at(d_used, at.reshape(-1), d_xw.reshape(-1, d_xw.shape[2]))
                g["w"], g["b"] = x.T @ d_used, d_used.sum(0)
                d_x = d_used @ m["w"].T
                g["words"], g["chars"] = np.zeros_like(m["words"]), np.zeros_like(m["chars"])
                np.add.at(g["words"], win.slots[used], d_x)
                np.add.at(g["chars"], grams, np.repeat(d_x / lengths[:, None], lengths, 0))
                step += 1
                for k, (m1, m2) in state.items():
                    m1 += 0.1 * (g[k] - m1)
                    m2 += 0.01 * (g[k] ** 2 - m2)
                    m[k] -= (p.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)).astype("f4")
    logit = win.logits(m)
    top = np.array([logit[a:z].max() for a, z in zip(win.first, win.first[1:])])
    # the threshold lies midway between the classes at the best cut of the training documents' highest windows
    cuts = np.unique(np.quantile(top, np.linspace(0, 1, 401)))
    right = [((top >= c) == (y == 1)).mean() for c in cuts]
    good = cuts[np.asarray(right) >= max(right) - 1e-9]
    below, above = top[top < good[0]], top[top >= good[-1]]
    cut = (below.max(initial=good[0] - 1) + above.min(initial=good[-1] + 1)) / 2
    m["scale"][:] = 1.0, np.log(p.threshold / (1 - p.threshold)) - cut
    return m


class Scorer:
    """Scores documents; remembers the projected inputs of at most ``limit`` words."""

    def __init__(self, m: dict, p: Params, limit: int = 1 << 17):
        self.m, self.p, self.limit = m, p, limit
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1 << 14, m["w"].shape[1]), "f4")

    def _indices(self, words: list[list[bytes]]) -> np.ndarray:
        if len(self.rows) > self.limit:
            self.rows.clear()
        rows = self.rows
        new = set().union(*words) - rows.keys()
        if new:
            new = sorted(new)
            slots, grams, ends = [], [], []
            for w in new:
                s, g = slots_of(w, self.p)
                slots.append(s)
                grams += g
                ends.append(len(grams))
            x = embed(self.m, np.array(slots, "i8"), np.array(grams, "i8"), np.array(ends, "i8"))
            n = len(rows)
            while n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(new)] = x @ self.m["w"] + self.m["b"]
            rows.update(zip(new, range(n, n + len(new))))
        return np.fromiter((rows[w] for own in words for w in own), "i8", sum(map(len, words)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        p, words = self.p, [t.split() for t in texts]
        n = np.array([len(w) for w in words], "i8")
        flat = np.append(self._indices(words), 0)
        base = np.cumsum(n) - n
        windows = np.array([len(window_starts(k, p)) for k in n.tolist()], "i8")
        doc = np.repeat(np.arange(len(texts)), windows)
        first = np.cumsum(windows) - windows
        start = (np.arange(len(doc)) - first[doc]) * p.stride
        logits = np.empty(len(doc), "f4")
        steps = np.arange(p.window)[:, None]
        for lo in range(0, len(doc), 2048):
            d, s = doc[lo : lo + 2048], start[lo : lo + 2048]
            at = s + steps
            mask = (at < n[d]).astype("f4")
            idx = flat[np.minimum(base[d] + at, len(flat) - 1)]
            logits[lo : lo + 2048] = forward(self.m, self.table[idx], mask)
        top = np.maximum.reduceat(logits, first) if len(first) else logits
        a, b = self.m["scale"].astype("f8")
        return sigmoid(a * top.astype("f8") + b)


def chunks(texts: list, most: int = 1 << 19):
    """Slices of about ``most`` bytes together."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), *, doc_id: str = "doc_id", text: str = "text") -> dict:
    """Model of the labelled documents that aren't held out; labels have doc_id and toxic."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    texts = texts.withColumn("m", F.md5(F.col("t").cast("binary")))
    light = texts.select("d", "m", F.octet_length("t").alias("size")).join(known, F.col("d") == F.col("k"))
    light = materialise(light.groupBy("m").agg(F.max("toxic").alias("toxic"), F.max("size").alias("size")), "labelled")
    sample = {}
    for c in (0, 1):
        left = p.max_bytes
        for r in light.where(F.col("toxic") == c).orderBy("m").limit(p.max_documents).collect():
            if r["size"] <= left:
                left -= r["size"]
                sample[r.m] = c
    if not sample:
        return train([], [], p)
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(m,) for m in sorted(sample)], "c string"))  # 2 * max_documents rows at most
    rows = texts.join(chosen, F.col("m") == F.col("c")).groupBy("m").agg(F.first("t").alias("t")).collect()
    rows.sort(key=lambda r: r.m)
    texts, toxic = [utf8(r.t) for r in rows], [sample[r.m] for r in rows]
    del rows
    model = train(texts, toxic, p)
    del texts
    release()
    return model


def score_documents(df: DataFrame, m: dict, p: Params = Params(), *, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with its scores in a new column ``name``; a column of that name is replaced."""
    df = df.drop(name)
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        scorer = Scorer(m, p)
        for b in batches:
            texts = b.column(at).to_pylist()
            out = np.empty(len(texts))
            for lo, hi in chunks(texts):
                out[lo:hi] = scorer.score([utf8(t) for t in texts[lo:hi]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, name])
        del scorer
        release()

    return df.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Params()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels"), p), p)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
