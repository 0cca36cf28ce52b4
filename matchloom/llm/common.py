"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Sides of at most so many narrow rows (under 64 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one of this machine only where none is named and Spark runs
    on this machine alone. On a cluster without one, executors would not find each other's files: that is an error."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="matchloom-checkpoints-")
        context.setCheckpointDir(named)
    return named


def stash(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and reads them back: lineage ends there, and a lost executor costs
    no more than the tasks that it ran."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stash/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Rows that later steps of one operator read, in the checkpoint folder until ``release``: what they lead to must be
    written by then, or nothing could make it again."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.tables = spark, [], []

    def path(self) -> str:
        self.paths.append(f"{checkpoint_dir(self.spark).rstrip('/')}/stash/{self.spark.sparkContext.applicationId}/{uuid.uuid4().hex}")
        return self.paths[-1]

    def __call__(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def by(self, df: DataFrame, key: str, parts: int, table: str | None = None) -> str:
        """The rows in buckets of the key, so that what groups by it needs no second shuffle of them; the table's name. With
        ``table`` they are added to one that was written so before."""
        parts = max(parts, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        writer = df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        if table is None:
            table = f"scratch_{uuid.uuid4().hex}"
            self.tables.append(table)
            writer = writer.option("path", self.path())
        writer.mode("append").saveAsTable(table)
        return table

    def release(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths, self.tables = [], []


class Held:
    """Rows that a few steps read more than once, on the executors' disks, until ``release``. Nothing depends on a copy:
    a lost block is computed again from what it came from. For short chains of steps; ``stash`` cuts longer ones."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist(StorageLevel.DISK_ONLY))
        return self.frames[-1]

    def release(self) -> None:
        for df in self.frames:
            df.unpersist()
        self.frames = []


def modest_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """``df`` itself; its session sends Python workers at most so many rows at once from now on. Texts make wide rows, and
    the default of 10,000 of them would be held several times over, in the executor and in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint if a count shows that the side is small enough, and none (a shuffle join) otherwise."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


class WordHashes(dict):
    """word (bytes) -> signed 64-bit hash, remembered for the words met lately; memory is bounded by ``limit`` words, which
    changes no hash."""

    LIMIT = 150_000

    def __init__(self, limit: int = LIMIT) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of n words; a shorter non-empty sequence counts as one gram."""
    if len(hashes) == 0:
        return np.empty(0, np.uint64)
    h, width = hashes.view(np.uint64), min(n, len(hashes))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
        out ^= out >> np.uint64(29)
    return mix(out)


def per_batch(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of at most ``rows`` rows and about ``size`` bytes of texts (one row at least), so that
    what a step derives from one stays small, however long the texts are."""
    for batch in batches:
        wide = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
                wide += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(wide), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


def fresh(columns: Iterable[str], *stems: str) -> list[str]:
    """Names made from the stems that none of the columns has, whatever its case: for columns that a step adds to a
    caller's table for a while."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        name, k = f"{stem}_", 0
        while name.lower() in taken:
            k += 1
            name = f"{stem}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def order_of(x: np.ndarray) -> np.ndarray:
    """Places of the values (whole numbers, none below 0) in their order, equal ones in any. The values' high bits are sorted
    together with the places, one number for both, which is several times quicker than ``argsort``; the few values that
    the low bits tell apart are put right after that."""
    if not len(x):
        return np.empty(0, np.int64)
    least, bits = x.min(), np.uint64(len(x).bit_length())
    own = (x - least).astype(np.uint64, copy=False)
    own = own << np.uint64(64 - max(1, int(own.max()).bit_length()))
    own >>= bits
    own <<= bits
    own |= np.arange(len(x), dtype=np.uint64)
    own.sort()
    own &= (np.uint64(1) << bits) - np.uint64(1)
    order = own.view(np.int64)
    met = x[order]
    return order if (met[1:] >= met[:-1]).all() else order[np.argsort(met, kind="stable")]  # quick for what is nearly sorted


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct value, the values in order; the number of each place's value; how often each occurs): as
    ``np.unique`` tells them, but any place of a value, not the first."""
    order = order_of(x)
    own = x[order]
    head = np.r_[True, own[1:] != own[:-1]] if len(x) else np.empty(0, bool)
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(head) - 1
    return order[head], back, np.diff(np.r_[np.flatnonzero(head), len(x)])


def trim(collect: bool = True) -> None:
    """Gives what was held and is free by now back to the system; without ``collect`` what no cycle holds."""
    import ctypes
    import gc

    if collect:
        gc.enable()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(run):
    """Gives what a finished task's memo held back to the system: a Python worker lives on for the next task, which may be
    another operator's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
