"""What the operators share: shared storage, table reading, small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Read from ``spark.checkpoint.dir``. Only where the session names none and
    runs in one process (tests, local mode) is a temporary folder of this
    machine set; a cluster without shared storage is an error.
    """
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_root is None:
        folder = tempfile.mkdtemp(prefix="vellumetry-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_root = f"file://{folder}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_own_root)
    return _own_root


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder in the shared storage."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: For tables that only this session reads. Hadoop's local file system starts ``chmod`` for each file and folder, from a
#: fork of the JVM, and again for each file of checksums; the raw one has none. Other file systems don't look at the first two.
INTERNAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: Bytes of rows that a Python worker gets at a time.
BATCH_BYTES = 4 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared storage and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.options(**INTERNAL).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python by bytes, not by 10,000 rows of any length; a smaller limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Gives the memory that this process has freed back to the machine; else it stays with a worker until that ends."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fs_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain local path (usable on executors)."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


class AtomicFile:
    """A file that appears under its name only when whole.

    A task that is run again, or twice at a time, writes the same bytes under
    a name of its own and moves them over the first result.
    """

    def __init__(self, folder: str, name: str):
        self.fs, base = fs_of(folder)
        self.fs.create_dir(base, recursive=True)
        self.final = f"{base}/{name}"
        self.temp = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)

    def write(self, data) -> None:
        self.out.write(data)

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            if self.fs.get_file_info(self.final).type != pafs.FileType.NotFound:
                self.fs.delete_file(self.final)  # not every file system moves onto a file
            self.fs.move(self.temp, self.final)
        else:
            self.fs.delete_file(self.temp)


def read_file(folder: str, name: str):
    """A buffer over a whole file, memory-mapped where the file system is local."""
    fs, base = fs_of(folder)
    path = f"{base}/{name}"
    if isinstance(fs, pafs.LocalFileSystem):
        if os.path.getsize(path) == 0:
            return memoryview(b"")
        import numpy as np

        return memoryview(np.memmap(path, dtype="u1", mode="r"))
    with fs.open_input_file(path) as f:
        return memoryview(f.read_buffer())


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each led by underscores until none of the columns has it (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)), F.lit(0)).cast("long")


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int, spread: Column, how: str = "inner") -> DataFrame:
    """Equi-join in which a key's rows of ``left`` are dealt into ``salts`` parts.

    ``right`` has at most one row a key and is repeated ``salts`` times;
    ``spread`` is what deals rows that share a key. Null keys match nothing.
    """
    l = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in on}).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    match = F.col("__salt") == F.col("__s")
    for c in on:
        match = match & (F.col(c) == F.col(f"__r_{c}"))
    return l.join(r, match, how).drop("__salt", "__s", *(f"__r_{c}" for c in on))
