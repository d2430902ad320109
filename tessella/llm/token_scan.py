"""Token counts of the documents in flat token files, found by their separators alone.

A file is a run of little-endian token ids without an index; each document ends with the
end-of-document id. Tasks read blocks of bytes, cut without regard to documents, and search
them apart; a prefix scan over the blocks' small summaries tells each block how many
documents ended before it and how long the one is that it goes on with.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import bpe
from tessella.llm.common import pick

#: Bytes of a block; blocks that a task reads one after the other, and the most tasks.
BLOCK, BLOCKS_A_TASK, MOST_TASKS = 1 << 20, 8, 20_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store that an address names, and the path in it; Hadoop's ``file:/x`` is ``file:///x``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_files(docs: DataFrame, rank_file: str, pattern: str, separator: int, path: str, key: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """(file, doc, key): documents encoded to flat files under ``path``, one for each task, when the result is written.

    A text's ids are followed by the separator, which no text can give. Nothing but ids is in
    the files. The result tells which document stands where, as their producer knows; the
    scan doesn't read it. A task that is run again writes a file of another name, so files
    that the result doesn't name are left over and don't count. Null texts are empty
    documents, repeated rows are documents each, an empty table gives no files. Extra
    columns are left out. Memory: a block and one text's ids. The store must be one that
    pyarrow opens (local or shared folders, s3, gs, hdfs).
    """
    rows = pick(docs, key, text).select(F.col(key), text)
    coder = bpe._coder(rows, rank_file, pattern)
    kind = rows.schema[key].dataType.simpleString()
    store, root = _opened(path)
    store.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, stop = coder(), np.array([separator], f"<u{width}").tobytes()
        name, out, held, doc = f"{uuid.uuid4().hex}.bin", None, bytearray(), 0
        for batch in batches:
            if out is None:
                store, root = _opened(path)
                out = store.open_output_stream(f"{root}/{name}")
            for body in batch.column(1):
                held += bpe.encode_text(encoding, body.as_py() or "").astype(f"<u{width}").tobytes() + stop
                if len(held) >= BLOCK:
                    out.write(bytes(held))
                    held.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * batch.num_rows, pa.string()), pa.array(np.arange(doc, doc + batch.num_rows), pa.int64()), batch.column(0)],
                names=["file", "doc", key],
            )
            doc += batch.num_rows
        if out is not None:
            out.write(bytes(held))
            out.close()

    return rows.mapInArrow(run, f"file string, doc bigint, `{key}` {kind}")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, bytes) of the files in a folder: their names, addresses and lengths; nothing is read of them."""
    found = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "bytes")


def blocks_of_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, block, data): the blocks of flat files in any store Spark reads, cut in the JVM.

    For stores that pyarrow doesn't open. A file is one row at first, so it must be a shard
    that fits a task's memory (under 2 GB); an empty one has no blocks.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    starts = F.expr(f"case when length(content) > 0 then sequence(0L, (length(content) - 1) div {block}) else cast(array() as array<bigint>) end")
    cut = files.select("file", "content", F.explode(starts).alias("block"))
    return cut.select("file", "block", F.expr(f"substring(content, cast(block * {block} + 1 as int), {block})").alias("data"))


def _ends(data: bytes | pa.Buffer, separator: int, width: int) -> tuple[int, np.ndarray]:
    """How many ids a block has and after which of them documents end."""
    if len(data) % width:
        raise ValueError("a block's length is not a multiple of the id width")
    ids = np.frombuffer(data, f"<u{width}")
    return len(ids), np.flatnonzero(ids == separator).astype(np.int64)


def _summaries(files: pa.Array, numbers: pa.Array, found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    ends = [e for _, e in found]
    offsets = np.cumsum([0, *map(len, ends)]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *ends])))
    return pa.RecordBatch.from_arrays([files, numbers, pa.array([n for n, _ in found], pa.int64()), listed], names=["file", "block", "tokens", "ends"])


_SUMMARY = "file string, block bigint, tokens bigint, ends array<bigint>"


def _searched_files(files: DataFrame, separator: int, width: int, block: int) -> DataFrame:
    """Summaries of the blocks of (file, path, bytes); each task reads its blocks' bytes alone."""
    if block % width:
        raise ValueError("a block must hold whole ids")
    count = F.ceil(F.col("bytes") / F.lit(block)).cast("bigint")
    total = files.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    tasks = max(1, min(MOST_TASKS, -(-total // BLOCKS_A_TASK)))
    each = files.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("block"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCKS_A_TASK):
                part = batch.slice(at, BLOCKS_A_TASK)
                found = []
                for number, path in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    store, name = _opened(path)
                    with store.open_input_file(name) as f:
                        found.append(_ends(f.read_at(block, number * block), separator, width))
                yield _summaries(part.column(0), part.column(1), found)

    return each.repartition(tasks, "file", "block").mapInArrow(run, _SUMMARY)


def _searched(blocks: DataFrame, separator: int, width: int) -> DataFrame:
    """Summaries of blocks (file, block, data); null data is an empty block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _summaries(batch.column(0), batch.column(1), [_ends(x.as_buffer() or b"", separator, width) for x in batch.column(2)])

    return pick(blocks, "file", "block", "data").mapInArrow(run, _SUMMARY)


def count_tokens(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, doc, start, n_tokens) of blocks (file, block, data); see ``count_files``."""
    return _stitched(_searched(blocks, separator, width))


def count_files(files: DataFrame, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, doc, start, n_tokens): each document's place in its file and its ids, the separator not counted.

    files: (file, path, bytes), the names told apart. Ids after a file's last separator are a
    document too if there are any. Documents of no ids count 0, empty files have none; an
    empty table gives no rows. Rows that repeat a file (or a block of one) are an error of
    the input and are not looked for. Ids are of ``width`` bytes: 2 for vocabularies up to
    65,536. A file may have any length: a task holds one block.
    """
    return _stitched(_searched_files(pick(files, "file", "path", "bytes"), separator, width, block))


def _stitched(found: DataFrame) -> DataFrame:
    """Documents of the blocks' summaries. The window goes over summaries, never over tokens."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # the last end seen so far, as ids from the file's start
    last = F.max(F.when(F.size("ends") > 0, F.col("_first") + F.element_at("ends", -1) + 1)).over(before)
    placed = found.withColumn("_first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    placed = placed.select(
        "file",
        "_first",
        "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("_docs"),
        F.coalesce(last, F.lit(0)).alias("_open"),
        (F.lead("block").over(order).isNull()).alias("_final"),
        (F.col("_first") + F.col("tokens")).alias("_stop"),
    )
    stops = F.transform("ends", lambda e: e + F.col("_first"))
    tail = F.when(F.col("_final") & (F.col("_stop") > F.coalesce(F.when(F.size("ends") > 0, F.col("_first") + F.element_at("ends", -1) + 1), F.col("_open"))), F.array("_stop")).otherwise(F.expr("cast(array() as array<bigint>)"))
    each = placed.withColumn("_stops", F.concat(stops, tail)).select("file", "_docs", "_open", "_stops", F.posexplode("_stops").alias("_i", "_end"))
    start = F.when(F.col("_i") == 0, F.col("_open")).otherwise(F.element_at("_stops", F.greatest(F.col("_i"), F.lit(1))) + 1)
    return each.select("file", (F.col("_docs") + F.col("_i")).alias("doc"), start.alias("start"), (F.col("_end") - start).alias("n_tokens"))


def keyed(counts: DataFrame, placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, file, doc, start, n_tokens): counts beside the keys that the files' producer gave (see ``write_files``)."""
    return counts.join(placed.select("file", "doc", key), ["file", "doc"]).select(key, "file", "doc", "start", "n_tokens")
