"""Byte-level BPE by ranked merges, and decoding.

``fold_merges`` joins, in the bytes of one match of the pre-tokenizer's
pattern, the neighbouring pair of least rank again and again (the leftmost of
equal ones), until no pair is in the rank map. ``Folder`` does the same for
many matches at once, one merge of each in a round. ``encode_documents`` does so
for the distinct pieces of the documents of a task and puts the texts together
from the results; ``decode`` concatenates the binary pieces of ids.

``encode_words_native`` expresses the same fold in Spark's higher-order
functions over a literal rank map. The README says why whole documents take
the first way.

Null texts count as empty: no ids, and the digests of no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.llm.common import read_table, release
from vellumetry.llm.pieces import PieceEncoder, piece_ends

#: A word of more bytes is folded with a heap, whose cost is not quadratic.
LONG_WORD = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    joined = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
    while joined:
        least = min(joined)
        if least == 1 << 60:
            break
        i = joined.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del joined[i]
        if i < len(joined):
            joined[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            joined[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold over a linked list, with a heap of (rank, place)."""
    n = len(word)
    end = list(range(1, n + 1))  # a part begins at its place and ends here; 0: it is gone
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or j >= n or end[j] != k:
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Folder:
    """Folds many matches at once: arrays of matches of about equal length, each losing one part a round."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], "i4")
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, z = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and z is not None:
                    keys.append(a << 32 | z)
                    values.append(rank)
        # open addressing: a pair stands at its hash's slot or the next free one
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, "i8")
        self.values = np.full(len(self.keys), self.NONE, "i4")
        left, value = np.array(keys, "i8"), np.array(values, "i4")
        at = self._slot(left)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = left[free]
            mine = self.keys[at] == left
            self.values[at[mine]] = value[mine]
            left, value, at = left[~mine], value[~mine], (at[~mine] + 1) % len(self.keys)
        #: tokens that merges alone don't reach, which a whole match may still be
        tokens = [t for t in ranks if 1 < len(t) <= LONG_WORD]
        self.unreached: set[bytes] = set()
        if tokens:
            _, n = self.fold(np.frombuffer(b"".join(tokens), "u1"), np.cumsum([len(t) for t in tokens]))
            self.unreached = {tokens[i] for i in np.flatnonzero(n > 1)}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view("u8") * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype("i8")

    def pair_ranks(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs of ids make; NONE where there is none, or an id is negative."""
        keys = a.astype("i8") << 32 | z
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.NONE)
        todo = np.flatnonzero((found != keys) & (found != -1) & (a >= 0) & (z >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.keys)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        out[(a < 0) | (z < 0)] = self.NONE
        return out

    def _fold_block(self, parts: np.ndarray) -> np.ndarray:
        """Rows of ids of bytes, -1 behind the last, to rows of ids of tokens."""
        out = np.full_like(parts, -1)
        rows, width = np.arange(len(parts)), parts.shape[1]
        joined = self.pair_ranks(parts[:, :-1].reshape(-1), parts[:, 1:].reshape(-1)).reshape(len(parts), width - 1)
        while True:
            width = parts.shape[1]
            at = joined.argmin(1) if width > 1 else np.zeros(len(parts), "i8")
            least = joined[np.arange(len(parts)), at] if width > 1 else np.full(len(parts), self.NONE)
            on = least != self.NONE
            if not on.all():
                out[rows[~on], :width] = parts[~on]
                rows, parts, joined, at, least = rows[on], parts[on], joined[on], at[on], least[on]
            if not len(rows):
                return out
            n = np.arange(len(rows))
            parts[n, at] = least
            keep = np.ones(parts.shape, bool)
            keep[n, at + 1] = False
            parts = parts[keep].reshape(len(rows), width - 1)
            keep = np.ones(joined.shape, bool)
            keep[n, at] = False
            joined = joined[keep].reshape(len(rows), width - 2)
            after = np.flatnonzero(at < width - 2)
            joined[after, at[after]] = self.pair_ranks(parts[after, at[after]], parts[after, at[after] + 1])
            before = np.flatnonzero(at > 0)
            joined[before, at[before] - 1] = self.pair_ranks(parts[before, at[before] - 1], parts[before, at[before]])

    def fold(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches, given their bytes one after the other and their ends; and how many each has."""
        starts = np.append(0, ends[:-1])
        lengths = ends - starts
        counts = np.zeros(len(ends), "i8")
        got = []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 32), (32, LONG_WORD)):
            all_rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for rows in (all_rows[i : i + 16_384] for i in range(0, len(all_rows), 16_384)):  # bounds the memory of a block
                at = starts[rows, None] + np.arange(high)
                parts = np.where(at < ends[rows, None], self.single[raw[np.minimum(at, len(raw) - 1)]], -1)
                parts = self._fold_block(parts.astype("i4"))
                counts[rows] = (parts >= 0).sum(1)
                got.append((rows, parts[parts >= 0]))
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            ids = fold_merges(raw[starts[i] : ends[i]].tobytes(), self.ranks)
            counts[i] = len(ids)
            got.append((np.array([i]), np.array(ids, "i4")))
        first = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), "i4")
        for rows, ids in got:
            n = counts[rows]
            out[np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts


_folders: dict[str, Folder] = {}


def worker_folder(path: str) -> Folder:
    """The tables of one rank file, of a fixed size, for the tasks of a Python worker; another file's take their place."""
    if path not in _folders:
        _folders.clear()
        _folders[path] = Folder(load_ranks(path))
    return _folders[path]


class Bpe:
    """Encoder and decoder of one rank file for one task, with memos of bounded size."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.folder = worker_folder(path)
        self.ranks = self.folder.ranks
        self.match = regex.compile(pattern).findall
        self.words: dict[str, list[int]] = {}
        self.encoder = PieceEncoder(lambda texts: map(self.encode_one, texts), encode_pieces=self.encode_pieces)
        self.pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.pieces[rank] = token

    def encode_one(self, text: str) -> list[int]:
        words, out = self.words, []
        if len(words) > 100_000:
            words.clear()
        for w in self.match(text):
            ids = words.get(w)
            if ids is None:
                ids = fold_merges(w.encode("utf-8", "replace"), self.ranks)
                if len(w) <= 32:
                    words[w] = ids
            out += ids
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """All pieces as one text, all matches of which are folded together; None if a match crosses pieces."""
        if self.folder.single.min() < 0:
            return None
        joined = " " + " ".join(pieces)
        words = self.match(joined)
        if self.folder.unreached and not self.folder.unreached.isdisjoint(w.encode() for w in words):
            return None
        raw = np.frombuffer(joined.encode(), "u1")
        chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        last = np.cumsum(np.fromiter(map(len, words), "i8", len(words)))
        ends, cuts = chars[last], piece_ends(joined, len(pieces))
        at = np.searchsorted(ends, cuts)
        if last[-1] != len(joined) or not np.array_equal(ends[np.minimum(at, len(ends) - 1)], cuts):
            return None
        ids, counts = self.folder.fold(raw, ends)
        return ids, np.cumsum(counts)[at]

    def close(self) -> None:
        self.words = {}
        self.encoder.close()

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(df: DataFrame, ranks: str, pattern: str, *, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, and its ids if asked for."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(ranks, pattern)
        try:
            yield from encode_all(bpe, batches)
        finally:
            bpe.close()
            release()

    def encode_all(bpe: Bpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                coded = bpe.encoder.encode(b.column(1).to_pylist())
                cols = {
                    "doc_id": b.column(0),
                    "n_tokens": pa.array([len(x) // 4 for x in coded], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded],
                    "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded],
                }
                if keep_ids:
                    cols["ids"] = pa.array(coded, pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(encode, schema)


#: Slots of the literal rank map: places in an array, each a small map.
SLOTS = 1 << 14


def rank_literal(path: str) -> str:
    """The rank map as JSON, for a literal ``array<map<string,int>>`` with tokens in hexadecimal.

    Spark looks keys of a map up one by one, so the map is cut by the
    remainder of the key's crc32 into an array of small maps.
    """
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for token, rank in load_ranks(path).items():
        key = token.hex().upper()
        slots[zlib.crc32(key.encode()) % SLOTS][key] = rank
    return json.dumps(slots)


def encode_words_native(words: DataFrame, ranks: str, word: str = "word") -> DataFrame:
    """Adds ``ids`` to a table of distinct words (matches of the pattern) with higher-order functions only.

    A fold over the word's bytes: each step joins the pair of least rank.
    Empty and null words get no ids.
    """

    def rank(of: str) -> str:
        return f"element_at(from_json(:m, 'array<map<string,int>>'), cast(crc32({of}) % {SLOTS} as int) + 1)[{of}]"

    none = 2**31 - 1
    best = f"array_min(transform(sequence(0, size(p) - 2), i -> named_struct('r', coalesce({rank('concat(p[i], p[i + 1])')}, {none}), 'i', i)))"
    joined = "concat(slice(p, 1, b.i), array(concat(p[b.i], p[b.i + 1])), slice(p, b.i + 3, size(p)))"
    step = f"CASE WHEN size(p) < 2 THEN p ELSE transform(array({best}), b -> CASE WHEN b.r = {none} THEN p ELSE {joined} END)[0] END"
    n = f"octet_length(`{word}`)"
    chars = f"transform(sequence(1, {n}), i -> substring(hex(encode(`{word}`, 'UTF-8')), 2 * i - 1, 2))"
    folded = f"aggregate(sequence(2, greatest(2, {n})), {chars}, (p, _) -> {step})"
    ids = f"CASE WHEN {n} > 0 THEN transform({folded}, x -> {rank('x')}) ELSE cast(array() as array<int>) END"
    return words.sparkSession.sql(f"SELECT *, {ids} AS ids FROM {{words}}".replace("{words}", "{w}"), args={"m": rank_literal(ranks)}, w=words)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
