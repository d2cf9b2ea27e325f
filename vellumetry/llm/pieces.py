"""Encoding texts by way of their distinct pieces.

The pre-tokenizer that byte-level BPE vocabularies use never lets a token
cross a space that follows a visible character and precedes one. A text may
therefore be cut before each such space, and each distinct piece be encoded
once. Texts with runs of white space beside a space are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


def piece_ends(joined: str, n: int) -> np.ndarray:
    """Where each of n pieces, none with a space in it and each after one, ends in the UTF-8 bytes."""
    raw = np.frombuffer(joined.encode(), "u1")
    ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
    assert len(ends) == n, "a piece holds a space"
    return ends


class PieceEncoder:
    """Encodes batches of texts to little-endian ids.

    ``encode_many`` turns a list of strings into a list of id lists and defines
    the result; ``encode_pieces``, if there is a faster way for pieces that each
    follow a space, gives their ids in one array and where each piece's end, or
    None if it can't. The memo holds at most ``limit`` pieces of up to ``longest``
    characters; when it is full it starts anew, so memory is bounded. ``close`` gives
    the memory back; an encoder of one task is closed before that ends, since
    the process may go on to run others.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable], dtype: str = "<u4", limit: int = 200_000, longest: int = 48, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray] | None] | None = None):
        self.encode_many, self.dtype, self.limit, self.longest = encode_many, dtype, limit, longest
        self.encode_pieces = encode_pieces or (lambda pieces: None)
        self.inner: dict[str, bytes | None] = {}
        self.first: dict[str, bytes] = {}

    def close(self) -> None:
        self.inner, self.first = {}, {}

    def _bytes(self, coded: Iterable) -> list[bytes]:
        return [np.asarray(ids, self.dtype).tobytes() for ids in coded]

    def _follow_space(self, pieces: list[str]) -> list[bytes]:
        found = self.encode_pieces(pieces)
        if found is None:
            return self._bytes(self.encode_many([" " + p for p in pieces]))
        ids, ends = found
        raw = ids.astype(self.dtype).tobytes()
        ends = (ends * np.dtype(self.dtype).itemsize).tolist()
        return [raw[a:z] for a, z in zip([0, *ends], ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        inner, first = self.inner, self.first
        if len(inner) > self.limit:
            inner.clear()
        if len(first) > self.limit:
            first.clear()
        heads, rests = [], []
        for t in texts:
            head, *rest = t.split(" ")
            heads.append(head)
            rests.append(rest)
        new_first = list(set(heads).difference(first))
        new_inner = list(set().union(*rests).difference(inner))
        if new_first:
            first.update(zip(new_first, self._bytes(self.encode_many(new_first))))
        safe = [p for p in new_inner if p and p.strip() == p]
        if len(safe) < len(new_inner):
            inner.update(dict.fromkeys(new_inner))
        if safe:
            inner.update(zip(safe, self._follow_space(safe)))
        out, whole, known = [], [], inner.__getitem__
        for i, (head, rest) in enumerate(zip(heads, rests)):
            got = list(map(known, rest))
            if None in got or (got and head[-1:].isspace()):
                whole.append(i)
                out.append(b"")
            else:
                out.append(first[head] + b"".join(got))
        if whole:
            for i, b in zip(whole, self._bytes(self.encode_many([texts[i] for i in whole]))):
                out[i] = b
        for memo, new in ((first, new_first), (inner, new_inner)):
            for p in new:
                if len(p) > self.longest:
                    del memo[p]
        return out
