"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius share a variant within half the radius of both. Every
distinct fingerprint emits its variants (65 for a radius of 2); those that meet on one are
chained, which links all of them, for all lie within the radius of each other. So no bucket
makes more links than it has members, and copies of a text count as one member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, checkpoint, pick
from tessella.llm.components import components

#: Words of a shingle, seed of its hash, and differing bits that still link.
WIDTH, SEED, RADIUS = 3, 42, 2


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The unsigned fingerprint of one text.

    Words are split at ASCII white space, A-Z lower-cased. Fewer words than ``width`` are
    one shingle; no words give zero. A bit is set if it is in over half the shingles' hashes.
    """
    words = text.lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens).tolist()
    ends = ends.tolist()
    n = max(len(words) - width + 1, 1)
    hashed = xxhash.xxh64_intdigest
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # so that a very long text takes little memory
        h = np.array([hashed(data[a:b], SEED) for a, b in zip(starts[at : min(n, at + (1 << 16))], last[at : at + (1 << 16)], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, fingerprint): the fingerprint as a signed 64-bit integer; null texts count as empty."""
    rows = pick(docs, key, text)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x.as_py(), width) for x in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], names=[key, "fingerprint"])

    return rows.mapInArrow(run, f"`{key}` {kind}, fingerprint bigint")


def masks(most: int) -> list[int]:
    """All 64-bit masks of up to ``most`` bits, as signed integers."""
    found = [sum(1 << i for i in bits) for n in range(most + 1) for bits in combinations(range(64), n)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in found]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints that together join all within the radius.

    The radius must be even: then a bucket's members, each within half of it, are all
    within the radius of each other and a chain through them loses nothing. Every link
    is verified and given once.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    variants = distinct.select(
        "fingerprint", F.explode(F.array(*map(F.lit, masks(radius // 2)))).alias("mask")
    ).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"))
    bucket = Window.partitionBy("variant").orderBy("fingerprint")
    chain = variants.select(F.lag("fingerprint").over(bucket).alias("a"), F.col("fingerprint").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return chain.where(F.col("a").isNotNull() & near).distinct()


def near_duplicates(prints: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) of rows (key, fingerprint): the least key reachable by links.

    Equal fingerprints are linked. Keys that are null are never the least one, unless all of
    a component's are. Repeated rows each come back. An empty table gives no rows.
    """
    prints = checkpoint(prints)  # read by three branches; the texts need hashing once
    own = prints.groupBy("fingerprint").agg(F.min(key).alias("least"))
    roots = components(links(own, radius)).withColumnsRenamed({"node": "fingerprint"})
    rooted = own.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id")
    return prints.join(known, "fingerprint", "left").select(key, "fingerprint", "component_id")


def hex_digits(column: str = "fingerprint") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
