"""Near copies: all texts that share 0.8 of their five-word shingles, found by prefix filtering.

A text's prefix is a fifth of its shingles, and one more, those first in an order that is the
same for all texts. Two texts that alike share a shingle of both their prefixes, wherever
they differ; so texts that meet on one are candidates, and none is lost. A candidate pair is
a link if its shingle sets are that alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import Shelf, blocks, by_place, maybe_in, pick, word_bounds, word_hashes
from tessella.llm.components import components
from tessella.llm.decontaminate import rolled
from tessella.llm.simhash import fingerprints, near_duplicates

#: Words of a shingle and the share of shingles in common that make a near copy.
WIDTH, SIMILARITY = 5, 0.8
#: Texts that may have one shingle before it is put late in the order, and the most shingles
#: put late. Any order finds all; a good one has few texts meet.
FEW, MOST_LATE = 16, 200_000
#: Rounds in which each text is compared with one other, before all that are still apart.
ROUNDS = 2

#: Words are runs of anything but ASCII white space, A-Z lower-cased.
FOLD = np.arange(256).astype(np.uint8)
FOLD[65:91] += 32
FOLD[[9, 10, 11, 12, 13, 32]] = 0
_IS_WORD = FOLD != 0
_IS_WORD[0] = True


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of each text's words."""
    for at, to, data, offsets in blocks(column):
        starts, ends = word_bounds(_IS_WORD[data], offsets)
        hashes = word_hashes(FOLD[data], starts, ends)
        yield from np.split(hashes, np.searchsorted(starts, offsets[1:-1])) if to - at > 1 else [hashes]


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of a text's shingles; fewer words than ``width`` are one."""
    return np.unique(rolled(words, min(width, len(words)))) if len(words) else np.zeros(0, np.uint64)


def _least(n: Column) -> Column:
    """How many of a text's ``n`` shingles a near copy has at least. Rounding never makes it more."""
    return F.ceil(n * SIMILARITY - 1e-6)


def _common(n: Column, m: Column) -> Column:
    """How many shingles near copies of ``n`` and ``m`` have in common at least."""
    return F.ceil((n + m) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)


def prefixes(rows: DataFrame, key: str, text: str = "text", late: np.ndarray | None = None) -> DataFrame:
    """(key, n, w, prefix): the number of shingles, how many of the prefix are late ones, and the prefix; no words, no row.

    The order is that of hashes, then the shingles of ``late`` in theirs.
    """
    own = pick(rows, key, text)
    kind = own.schema[key].dataType.simpleString()
    late = np.zeros(0, np.uint64) if late is None else late
    by_hash = np.argsort(late)
    sent = rows.sparkSession.sparkContext.broadcast((late[by_hash], by_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = sent.value
        for batch in batches:
            sizes, shared, got = [], [], []
            for words in _words(batch.column(1)):
                own, n_late = shingles(words), 0
                if len(late):
                    at = np.minimum(np.searchsorted(late, own), len(late) - 1)
                    is_late = late[at] == own
                    own = np.concatenate([own[~is_late], own[is_late][np.argsort(rank[at[is_late]])]])
                    n_late = int(is_late.sum())
                most = len(own) - math.ceil(len(own) * SIMILARITY - 1e-6) + 1
                sizes.append(len(own))
                shared.append(max(0, most - (len(own) - n_late)))
                got.append(own[:most].view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(shared, pa.int32()), pa.array(got, pa.list_(pa.int64()))], names=[key, "n", "w", "prefix"])

    return own.mapInArrow(run, f"`{key}` {kind}, n int, w int, prefix array<bigint>").where("prefix is not null")


def shared(made: DataFrame, key: str) -> DataFrame:
    """(i, s, x, n, w): for each shingle that several prefixes have, those texts and its place in their prefixes."""
    own = made.select(F.posexplode("prefix").alias("i", "s"), F.col(key).alias("x"), "n", "w")
    several = own.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    return own.join(several.select("s"), "s")


def counted(rows: DataFrame, text: str = "text") -> DataFrame:
    """(s, c): how many rows have each shingle; rows of one batch are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(words) for words in _words(batch.column(0))]
            s, c = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            for at in range(0, len(s), 1 << 16):
                to = at + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(s[at:to].view(np.int64)), pa.array(c[at:to], pa.int64())], names=["s", "c"])

    return pick(rows, text).mapInArrow(run, "s bigint, c bigint").groupBy("s").agg(F.sum("c").alias("c"))


def crowded(rows: DataFrame, text: str = "text") -> np.ndarray:
    """Shingles that more than a few texts have, those that most have last; ``MOST_LATE`` at most.

    With these late in the order, a prefix begins with what hardly another text has: unlike
    texts with a passage in common don't meet on it, nor do copies with many edits.
    Counts stay on the cluster; the driver gets how many shingles each power of two of
    counts has, which sets the bound, and then the shingles over the bound.
    """
    shelf = Shelf(rows.sparkSession)
    counts = shelf.put(counted(rows, text).where(F.col("c") > FEW), "counts")
    sizes = dict(counts.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).agg(F.count("*").alias("k")).collect())
    room, least = MOST_LATE, 64
    while least > 0 and (k := sizes.get(least - 1, 0)) <= room:
        room, least = room - k, least - 1
    got = counts.where(F.col("c") >= F.lit(2.0) ** least).toArrow()
    late, times = (got.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    shelf.drop()
    return late[np.lexsort((late, times))].view(np.uint64)


def possible(pairs: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """(a, b): the pairs whose sizes and prefixes allow them to be that alike.

    What two texts share is in both prefixes or past the end of the one that ends first.
    """
    p = made.select(F.col(key).alias("a"), F.col("n").alias("_n"), F.col("prefix").alias("_p"))
    q = made.select(F.col(key).alias("b"), F.col("n").alias("_m"), F.col("prefix").alias("_q"))
    n, m = F.col("_n"), F.col("_m")
    most = F.size(F.array_intersect("_p", "_q")) + F.greatest(n - F.size("_p"), m - F.size("_q"))
    alike = (F.least(n, m) >= _least(F.greatest(n, m))) & (most >= _common(n, m))
    return pairs.join(p, "a").join(q, "b").where(alike).select("a", "b")


def shingle_sets(nodes: DataFrame, rows: DataFrame, key: str, text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, _set): the sorted hashes of the nodes' shingles; fewer words than ``width`` are one shingle.

    Only the nodes' texts are shuffled. Keys are hashes of texts; equal texts have one set.
    """
    own = maybe_in(pick(rows, key, text), key, nodes).dropDuplicates([key]).join(nodes, key, "left_semi")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shingles(w, width).tobytes() for w in _words(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=[key, "_set"])

    return own.mapInArrow(run, f"`{key}` {kind}, _set binary")


def verified(pairs: DataFrame, sets: DataFrame, key: str, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): the pairs whose sets have that share in common, exactly."""
    a, b = sets.select(F.col(key).alias("a"), F.col("_set").alias("_x")), sets.select(F.col(key).alias("b"), F.col("_set").alias("_y"))
    kind = sets.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                low, high = sorted((len(p), len(q)))
                if low < similarity * high:
                    keep.append(False)
                    continue
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= similarity * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "_x", "_y").mapInArrow(run, f"a {kind}, b {kind}")


def groups(made: DataFrame, rows: DataFrame, key: str, text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(node, root): the components of all pairs of near copies, and of the known links (a, b).

    In a round each text that meets texts of other components is verified with one of those,
    the one it meets most often of one for each shingle, in the first round that of most late
    shingles, which has the fewest edits of its own; so a dense group verifies about as many
    pairs as it has members. Then all pairs that meet and are still apart are verified, unless
    the place of a shingle in either order leaves too few after it; the first shingle that near
    copies share never does.
    """
    shelf = Shelf(made.sparkSession)
    left = shelf.put(shared(made, key), "left")
    done = None if known is None else shelf.put(known, "done")
    for n in range(ROUNDS + 1):
        if done is not None:
            done = shelf.put(components(done), "done")
            left = _apart(left.select("s", "x", "n", "i", "w"), done)
        else:
            left = left.withColumn("root", F.col("x"))
        left = shelf.put(left, "left")
        if left.isEmpty():
            shelf.drop("left")
            return done if done is not None else _none(made, key)
        if n == ROUNDS:
            break
        hubs = left.groupBy("s").agg(F.max_by(F.struct("x", "root"), F.struct(F.col("w") if n == 0 else F.lit(0), F.xxhash64("x", F.lit(n)))).alias("h"))
        star = left.join(hubs, "s").where("root <> h.root").groupBy("x", F.col("h.x").alias("y")).agg(F.count("*").alias("k"))
        best = star.groupBy("x").agg(F.max_by("y", F.struct("k", "y")).alias("y"))
        done = _linked(shelf, done, best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), made, rows, key, text)
    left = left.select("s", "x", "n", "i", "root")
    p, q = left.toDF("s", "a", "n", "i", "r"), left.toDF("s", "b", "m", "j", "t")
    n, m = F.col("n"), F.col("m")
    size = F.least(n, m) >= _least(F.greatest(n, m))
    place = (F.col("i") <= n - _common(n, m)) & (F.col("j") <= m - _common(n, m))
    pairs = p.join(q, "s").where((F.col("a") < F.col("b")) & (F.col("r") != F.col("t")) & size & place).select("a", "b").distinct()
    found = components(_linked(shelf, done, pairs, made, rows, key, text))
    shelf.drop()  # components have their own copy of the links
    return found


def _apart(met: DataFrame, done: DataFrame) -> DataFrame:
    """``met`` with each text's root, without the shingles that only one component has."""
    rooted = met.join(done.withColumnRenamed("node", "x"), "x", "left").withColumn("root", F.coalesce("root", "x"))
    several = rooted.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return rooted.join(several.select("s"), "s", "left_semi").select("s", "x", "n", "i", "w", "root")


def _linked(shelf: Shelf, done: DataFrame | None, pairs: DataFrame, made: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b): what is done, and the pairs that verify."""
    pairs = shelf.put(possible(pairs, made, key), "pairs")
    nodes = shelf.put(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct(), "nodes")
    good = verified(pairs, shingle_sets(nodes, rows, key, text), key)
    links = shelf.put(good if done is None else done.toDF("a", "b").unionByName(good), "done")
    shelf.drop("pairs", "nodes")
    return links


def _none(made: DataFrame, key: str) -> DataFrame:
    return made.select(F.col(key).alias("node"), F.col(key).alias("root")).limit(0)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of copies: the one with the least key, a key before none.

    Linked are texts whose long fingerprints are within their radius (see ``simhash``) and
    near copies; a group is all that links reach. Rows are told apart by key and text, so
    different texts under one key are linked only if alike, and of rows equal in both one
    stays. Null texts count as empty. All columns are kept, whatever their names. Near copies
    are sought among all distinct texts, each known by a hash of 64 bits. An empty table
    gives no rows.
    """
    own, names = by_place(docs), docs.columns
    id_, text = F.col(f"_c{names.index(key)}"), f"_c{names.index(text)}"
    shelf = Shelf(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = own.withColumns({"_row": F.xxhash64(id_, body), "_text": F.xxhash64(body, id_), "_body": F.xxhash64(body)})
    whole = F.struct(id_.isNull().alias("none"), id_.alias("key"), "_row", "_text", "_body")
    found = shelf.put(near_duplicates(fingerprints(rows.select(whole.alias("key"), text), "key", text), "key"), "found")
    first = found.where("key = component_id").groupBy("key").agg(F.count("*").alias("_times")).select("key", "key._row", "key._text", "key._body", "_times")
    known = found.select(F.col("key._body").alias("a"), F.col("component_id._body").alias("b")).where("a <> b").distinct()
    made = shelf.put(prefixes(rows, "_body", text, crowded(rows, text)).dropDuplicates(["_body"]), "prefixes")
    near = groups(made, rows, "_body", text, known)
    shelf.drop("prefixes")
    grouped = first.join(near, F.col("_body") == F.col("node"))
    least = grouped.groupBy("root").agg(F.min("key").alias("least"))
    others = grouped.join(least, "root").where("key <> least").select("_row", "_text")
    keep = shelf.put(first.select("_row", "_text", "_times").join(others, ["_row", "_text"], "left_anti"), "keep")
    shelf.drop("found")
    # of rows equal in key and text each task keeps one, then one of those stays
    once, again = (rows.join(keep.where(c), ["_row", "_text"]) for c in ("_times = 1", "_times > 1"))
    for by in (["_row", "_text", "_task"], ["_row", "_text"]):
        best = Window.partitionBy(*by).orderBy(F.xxhash64(*own.columns))
        again = again.withColumn("_task", F.spark_partition_id()).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return once.select(*own.columns).unionByName(again.select(*own.columns)).toDF(*names)
