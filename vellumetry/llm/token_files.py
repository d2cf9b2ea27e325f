"""Token-ID output: flat unsigned integer files plus 64-bit document offsets.

``write_token_files`` range-partitions the documents by id. Each partition
writes, in ascending id order,

* ``part-N.bin``: the ids of its documents, flat, little-endian, unsigned, of
  the narrowest of 16 or 32 bits that holds the vocabulary and the end id,
* ``part-N.off``: int64 offsets of its documents in ``part-N.bin`` counted in
  ids, one more than there are documents,
* ``part-N.doc`` / ``part-N.nul``: int64 doc ids and a byte that is 1 where the
  id is null.

A partition's place among all ids is its *base*, the prefix sum of the
partitions before it; one row a partition reaches the driver for that.
``read_token_files`` maps the files into memory and gives documents back.

Null texts count as empty and hold the end id alone. Null doc ids come first.
Equal doc ids stay beside each other, ordered by text. An empty table gives no
file and no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumetry.llm.common import AtomicFile, read_file, read_table, work_dir
from vellumetry.llm.pieces import PieceEncoder, piece_ends

END_ID = 2
#: Documents encoded at a time; bounds the memory of their pieces.
CHUNK = 512
#: Pieces that a worker remembers. Tasks of one worker share them: a memo for each task costs a half more.
MEMO = 1_000_000
#: New pieces that the library gets as one text.
JOINED = 500
_encoders: dict[tuple, PieceEncoder] = {}


def worker_encoder(path: str, dtype: str) -> PieceEncoder:
    """One encoder a Python worker, with a memo of bounded size; another tokenizer takes its place."""
    if (path, dtype) not in _encoders:
        _encoders.clear()
        _encoders[path, dtype] = library_encoder(path, dtype)
    return _encoders[path, dtype]


def library_encoder(path: str, dtype: str) -> PieceEncoder:
    """An encoder with the tokenizers library behind it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    lengths = _byte_lengths(tok)

    def encode_many(texts: list[str]):
        return (e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False))

    def encode_pieces(pieces: list[str]):
        """Pieces joined to texts, cut where the ids' bytes add up to a piece; None if a token crosses a cut."""
        joined = [" " + " ".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
        ids = np.concatenate([np.asarray(x, "i8") for x in encode_many(joined)])
        ends = piece_ends("".join(joined), len(pieces))
        covered = np.cumsum(lengths[ids])
        at = np.searchsorted(covered, ends) + 1
        if len(covered) == 0 or at[-1] > len(covered) or not np.array_equal(covered[at - 1], ends):
            return None
        return ids, at

    return PieceEncoder(encode_many, dtype, MEMO, encode_pieces=encode_pieces)


def _byte_lengths(tok) -> np.ndarray:
    """UTF-8 bytes of each id: a byte-level token has a character a byte; special tokens are plain text."""
    out = np.zeros(tok.get_vocab_size(True), "i8")
    special = {i: t.content for i, t in tok.get_added_tokens_decoder().items()}
    for token, i in tok.get_vocab(True).items():
        out[i] = len(special[i].encode()) if i in special else len(token)
    return out


def id_type(path: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(True) - 1, end_id) < 1 << 16 else "<u4"


@dataclass
class TokenFiles:
    """Where the files are, the width of an id, and the partitions' bases."""

    folder: str
    dtype: str
    #: (partition, documents, ids, base), in order of documents
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)

    @property
    def n_tokens(self) -> int:
        return sum(p[2] for p in self.parts)


def write_token_files(df: DataFrame, tokenizer: str, folder: str, *, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> TokenFiles:
    dtype = id_type(tokenizer, end_id)
    end = np.asarray([end_id], dtype).tobytes()
    width = len(end)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = worker_encoder(tokenizer, dtype)
        n_docs = at = 0
        first = next(batches, None)
        if first is None:
            return

        def rest():
            for b in chain([first], batches):
                for lo in range(0, b.num_rows, CHUNK):
                    yield b.slice(lo, CHUNK)

        names = [f"part-{part:06d}.{x}" for x in ("bin", "off", "doc", "nul")]
        with AtomicFile(folder, names[0]) as bin_, AtomicFile(folder, names[1]) as off, AtomicFile(folder, names[2]) as doc, AtomicFile(folder, names[3]) as nul:
            off.write(np.zeros(1, "<i8").tobytes())
            for b in rest():
                ids = b.column(0)
                doc.write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                nul.write(ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                coded = encoder.encode(b.column(1).to_pylist())
                lengths = np.fromiter((len(x) // width + 1 for x in coded), "<i8", len(coded))
                off.write((at + np.cumsum(lengths)).astype("<i8").tobytes())
                bin_.write(end.join(coded) + end if coded else b"")
                at += int(lengths.sum())
                n_docs += len(coded)
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_tokens": [at]})

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(n, F.col("d").asc_nulls_first()).sortWithinPartitions(F.col("d").asc_nulls_first(), "t")
    done = ordered.mapInArrow(write, "part long, n_docs long, n_tokens long").collect()
    out, base = TokenFiles(folder, dtype), 0
    for r in sorted(done):
        out.parts.append((r.part, r.n_docs, r.n_tokens, base))
        base += r.n_tokens
    return out


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document and, if asked for, its ids."""
    folder, dtype = files.folder, files.dtype
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = f"part-{part:06d}"
                ids = np.frombuffer(read_file(folder, f"{name}.bin"), dtype)
                off = np.frombuffer(read_file(folder, f"{name}.off"), "<i8")
                doc = np.frombuffer(read_file(folder, f"{name}.doc"), "<i8")
                nul = np.frombuffer(read_file(folder, f"{name}.nul"), "u1").astype(bool)
                for lo in range(0, len(doc), 4096):
                    o = off[lo : lo + 4097]
                    d = slice(lo, lo + 4096)
                    own = [ids[a:z] for a, z in zip(o[:-1], o[1:])]
                    cols = {
                        "doc_id": pa.array(doc[d], pa.int64(), mask=nul[d]),
                        "start": pa.array(base + o[:-1]),
                        "n_tokens": pa.array(np.diff(o)),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    }
                    if with_ids:
                        cols["ids"] = pa.array([x.astype("i8") for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    if not files.parts:
        return spark.createDataFrame([], schema)
    parts = spark.createDataFrame([(p, base) for p, _, _, base in files.parts], "part long, base long")
    return parts.repartition(len(files.parts)).mapInArrow(read, schema)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), work_dir(spark, "tokens"))
    return read_token_files(spark, files)
