import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from vellumetry.llm import bpe
from vellumetry.llm import token_files as T
from vellumetry.llm.common import work_dir
from vellumetry.llm.pieces import PieceEncoder

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def strings():
    rng = random.Random(1)
    letters = " \n\t  \x85\x1c abé'sтест12日本!!…\r aaaa 'll  "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 3000 + " b" * 50, "x <|endoftext|>y", ""]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_pieces_give_what_the_library_gives():
    tok = Tokenizer.from_file(JSON)
    texts = strings()
    got = T.library_encoder(JSON, "<u4").encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_folds_give_what_the_library_gives(library):
    coder = bpe.Bpe(RANKS, PATTERN)
    texts = strings()
    got = [np.frombuffer(g, "<u4").tolist() for g in coder.encoder.encode(texts)]
    assert got == [library.encode_ordinary(t) for t in texts]
    assert all(coder.decode(np.array(g, "<u4").tobytes()).decode() == t for g, t in zip(got, texts))


def test_native_fold(spark, library):
    words = [" thonheth", "été", " idiot", "a", " zzqqx", "日本", ""]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.ids for r in bpe.encode_words_native(df, RANKS).collect()}
    assert got == {w: library.encode_ordinary(w) for w in words}


def test_documents_in_order_with_offsets(spark, odd_docs):
    tok = Tokenizer.from_file(JSON)
    files = T.write_token_files(odd_docs, JSON, work_dir(spark, "t"))
    assert files.dtype == "<u2"
    rows = T.read_token_files(spark, files, with_ids=True).orderBy("start").collect()
    docs = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for r, d in zip(rows, docs, strict=True):
        ids = tok.encode(d.text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (d.doc_id, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert files.n_tokens == start


def test_no_documents(spark, no_docs):
    files = T.write_token_files(no_docs, JSON, work_dir(spark, "t"))
    assert T.read_token_files(spark, files).count() == 0
    assert bpe.encode_documents(no_docs, RANKS, PATTERN).count() == 0


def test_digests(odd_docs, library):
    texts = [r.text or "" for r in odd_docs.collect()]
    want = sorted((len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts for i in [library.encode_ordinary(t)])
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(odd_docs, RANKS, PATTERN).collect())
    assert got == want


def test_a_batch_does_not_walk_the_memo():
    coder = PieceEncoder(lambda texts: [[len(t)] for t in texts], limit=1_000_000)
    coder.inner.update((f"w{i}", b"") for i in range(500_000))
    took = []
    for i in range(7):
        began = time.perf_counter()
        coder.encode([f"a b{i}"])
        took.append(time.perf_counter() - began)
    assert min(took) < 0.003


def test_many_folds_are_those_of_single_words():
    rng = random.Random(3)
    tokens = {bytes([i]) for i in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(150)}
    order = sorted(tokens)
    rng.shuffle(order)  # ranks that no training gave: longer tokens before their parts, tokens that merges don't reach
    ranks = {t: i for i, t in enumerate(order)}
    folder = bpe.Folder(ranks)
    assert folder.unreached
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.choice([1, 2, 3, 7, 20, 40, 64, 65, 200]))) for _ in range(3000)]
    words = [w for w in words if w not in folder.unreached]
    ids, counts = folder.fold(np.frombuffer(b"".join(words), "u1"), np.cumsum([len(w) for w in words]))
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [bpe.fold_merges(w, ranks) for w in words]


def test_pieces_are_not_folded_one_by_one(monkeypatch, library):
    calls = []
    fold = bpe.fold_merges
    monkeypatch.setattr(bpe, "fold_merges", lambda *a: calls.append(a) or fold(*a))
    text = "x " + " ".join(f"zq{chr(97 + i % 26)}x{i}é," for i in range(2000))
    coder = bpe.Bpe(RANKS, PATTERN)
    assert np.frombuffer(coder.encoder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
    assert len(calls) < 20
