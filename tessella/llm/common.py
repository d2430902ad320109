"""What the operators of this subpackage share: columns, blocks of bytes, the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised scans; a single longer text is its own block.
BLOCK_BYTES = 512 << 10
#: Bits of ``maybe_in``'s filter, 64 in a row of the table that is broadcast: at most 131,072 rows.
FILTER_BITS = 1 << 23


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, matched by exact name.

    Extra columns are pruned, also those that differ from a wanted one in case alone,
    so they can clash with nothing an operator adds.
    """
    cols = df.columns
    at = [cols.index(n) for n in names]
    own = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    return own.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def by_place(df: DataFrame) -> DataFrame:
    """df with columns named by their place (``_c0`` ...), so that nothing an operator adds clashes with one.

    ``toDF(*df.columns)`` gives the names back.
    """
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where none is set a folder of this machine serves, but only if all executors are in this
    process (local mode, as in tests); else it is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tessella-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder; a folder that is gone already is as good."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    with suppress(Exception):  # what is left behind is a cost and no fault
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Shelf:
    """Tables of one computation in the shared folder, each deleted as soon as nothing reads it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """``written``; a table put under this name before is deleted afterwards."""
        old, path = self.paths.get(name), new_path(self.spark, name)
        df.write.parquet(path)
        self.paths[name] = path
        if old is not None:
            removed(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or tuple(self.paths):
            if (path := self.paths.pop(name, None)) is not None:
                removed(self.spark, path)


def maybe_in(rows: DataFrame, hashed: str, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """rows without most of those whose hash is not among the wanted: by a bitmap of fixed size over their hashes.

    Keeps the shuffle of texts near the wanted ones. The bitmap is a table of at most
    ``bits / 64`` rows, so it may be broadcast however many are wanted; with very many it
    lets more rows through, which the join after it removes. Both tables name the column alike.
    """
    place = lambda c: F.pmod(c, F.lit(bits))
    word = lambda c: F.floor(place(c) / 64)
    bit = lambda c: F.pmod(place(c), F.lit(64)).cast("int")
    own = wanted.select(F.col(hashed).alias("_h"))
    set_bits = own.groupBy(word(F.col("_h")).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("_h")))).alias("_bits"))
    is_set = F.call_function("shiftrightunsigned", F.col("_bits"), bit(F.col(hashed))).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(set_bits), (word(F.col(hashed)) == F.col("_word")) & is_set, "left_semi")


def as_bytes(column: pa.Array) -> pa.Array:
    """A text column as UTF-8 binary; null counts as empty."""
    return column.cast(pa.binary()).fill_null(b"")


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, past the last, bytes, row offsets), each of about ``most`` bytes."""
    column = as_bytes(column)
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; no run crosses a row's end."""
    n = len(is_word)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | cut[1:])) + 1
    return starts, ends


def ascii_fold(keep: np.ndarray) -> np.ndarray:
    """A byte table: A-Z to lower case, the bytes of ``keep`` as they are, 0 for all others."""
    fold = np.where(keep, np.arange(256), 0).astype(np.uint8)
    fold[65:91] = np.arange(97, 123) * keep[97:123]
    return fold


def letters_digits() -> np.ndarray:
    """Bytes of words made of 0-9, a-z and everything that isn't ASCII (after lower-casing A-Z)."""
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[128:] = True
    return keep


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of powers don't show in the low bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """base to the power of 0..n-1, modulo 2^64."""
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word's bytes (of its first ``longest`` bytes, if given)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    if longest is not None:
        lens = np.minimum(lens, longest)
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        values = (folded[np.repeat(starts, lens) + pos].astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[pos]
        return mixed(np.add.reduceat(values, first) + lens.astype(np.uint64))
