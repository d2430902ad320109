"""Document fingerprints: bottom-k sketches of word shingles, built from SQL functions only.

A sketch is the k least distinct 64-bit hashes of a text's shingles, in ascending order.
Sketches of parts merge into the sketch of the whole, and two sketches estimate the
resemblance, the containment and the number of distinct shingles of their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tessella.llm.common import pick

#: Words of a shingle; hashes of a sketch. The standard error of a resemblance r is sqrt(r (1 - r) / K).
WIDTH, K = 5, 128
#: Hashes are signed; as shares of their range: (h - least) / 2^64.
_LEAST, _RANGE = -(2.0**63), 2.0**64


def sketch(text: Column, width: int = WIDTH, k: int = K) -> Column:
    """The sketch of a text column, array<bigint>; null and empty texts have an empty one.

    Each word, lower-cased, ends one shingle: it and up to ``width - 1`` words before it. So
    a text has a shingle for each word, one of a few words too, and shares a prefix's
    shingles with that prefix. Words are split at white space.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _least(_shingled(hashes, width), k)


def _shingled(hashes: Column, width: int) -> Column:
    """For each position, a hash of the word hashes up to it, as many as width."""

    def shingles(bound: Column) -> Column:
        return F.transform(
            bound,
            lambda _, i: F.xxhash64(F.slice(bound, F.greatest(i + F.lit(2 - width), F.lit(1)), F.least(i + 1, F.lit(width)))),
        )

    # wrapped once, so that the words are hashed once and not for each shingle
    return F.element_at(F.transform(F.array(hashes), shingles), 1)


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together (of all their shingles)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """(by, sketch): the sketches of all parts of each group merged.

    The least k hashes of a group are found by ranking its distinct hashes, of which each
    task keeps k before the shuffle; no group is gathered in one row before that.
    """
    hashes = parts.select(*by, F.explode(column).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
    kept = hashes.withColumn("_rank", rank).where(F.col("_rank") <= k)
    found = kept.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(column))
    groups = parts.select(*by).distinct()
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    joined = groups.alias("g").join(found.alias("f"), same, "left")
    return joined.select(*[f"g.{c}" for c in by], F.coalesce(f"f.{column}", F.expr("cast(array() as array<bigint>)")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both; 1 for two empty sketches, 0 if one is."""
    both = merged(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both).cast("double"))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for fewer than k."""
    share = (F.element_at(a, -1).cast("double") - F.lit(_LEAST)) / F.lit(_RANGE)
    full = F.size(a) >= k
    return F.when(full, F.lit(k - 1.0) / F.when(full, share)).otherwise(F.size(a).cast("double"))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has; 1 if a has none."""
    common = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    share = F.when(F.size(a) == 0, F.lit(1.0)).otherwise(common / F.greatest(distinct_count(a, k), F.lit(1.0)))
    return F.least(F.lit(1.0), share)


def as_text(a: Column) -> Column:
    """The fingerprint as a string of 16 hex digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """(key, sketch, shingles): each text's sketch and its estimated number of distinct shingles.

    Null and empty texts have an empty sketch; equal texts have equal ones; repeated rows each come back.
    """
    rows = pick(docs, key, text).select(key, sketch(F.col(text), width, k).alias("sketch"))
    return rows.withColumn("shingles", distinct_count(F.col("sketch"), k))


#: Rows of a bucket of neighbouring keys, roughly, and the most buckets (cuts are literals of the plan).
BUCKET_ROWS, MOST_BUCKETS = 256, 4096


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, WindowSpec]:
    """(_bucket, _ghost, key, text) and the window in which the next row of each is the next document.

    Order: descending key, nulls last, equal keys by text; after the last comes the first.
    Rows are dealt by key ranges. The range's cuts are keys of the table, so the first row
    of each range is known and is also put, as a ghost, at the end of the range before it.
    """
    least = F.lit(-(2**63))
    rows = pick(docs, key, text).select(F.col(key), F.coalesce(F.col(key).cast("bigint"), least).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias(text))
    n, top = pick(docs, key).agg(F.count("*"), F.max(F.coalesce(F.col(key).cast("bigint"), least))).first()
    count = max(1, min(MOST_BUCKETS, n // bucket_rows))
    cuts: list[int] = []
    if count > 1:
        ids = pick(docs, key).select(F.coalesce(F.col(key).cast("bigint"), least).alias("i"))
        found = ids.agg(F.percentile_approx("i", [i / count for i in range(1, count)], 10 * count)).first()[0]
        cuts = sorted({int(x) for x in found if int(x) != top})
    bucket = _place(F.col("_id"), cuts)
    last = len(cuts)  # of the keys above all cuts, which come first
    ends = F.array(*map(F.lit, [*cuts, top if top is not None else 0]))
    # the largest key of a range is a cut: it ends the range above it as a ghost; the top key ends the lowest range
    ghost = F.when(F.col("_id") == F.element_at(ends, F.col("_b") + 1), F.array(F.col("_b"), F.when(F.col("_b") == last, F.lit(0)).otherwise(F.col("_b") + 1)))
    own = rows.withColumn("_b", bucket).withColumn("_to", F.coalesce(ghost, F.array("_b")))
    dealt = own.select(key, "_id", text, F.posexplode("_to").alias("_ghost", "_bucket"))
    window = Window.partitionBy("_bucket").orderBy("_ghost", F.col("_id").desc(), F.col(text))
    return dealt, window


def _place(value: Column, cuts: list[int]) -> Column:
    """The number of cuts below the value, found in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    every = F.array(*map(F.lit, cuts))
    coarse = F.array(*map(F.lit, cuts[step - 1 :: step])) if len(cuts) >= step else F.array()
    skip = F.size(F.filter(coarse, lambda c: c < value)) * F.lit(step)
    return (skip + F.size(F.filter(F.slice(every, skip + 1, step), lambda c: c < value))).cast("int")


def edited_and_next(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """Each document's sketch beside that of its edited text and of the next document.

    (key, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next). The edited
    text has its last third (floor, in code points) replaced by as many of the first of the
    next document, or all it has. Null is empty. The text crosses one shuffle; sketches none.
    """
    dealt, window = with_next(docs, key, text)
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    near = dealt.select("*", F.lead(text).over(window).alias("_next"))
    cut = near.select(
        "*",
        n.cast("bigint").alias("n_chars"),
        F.when(F.col("_ghost") == 0, F.concat(F.substring(text, F.lit(1), n - third), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), third))).alias("_edited"),
        sketch(F.col(text), width, k).alias("sketch"),
    )
    full = cut.select("*", F.lead("sketch").over(window).alias("_next_sketch")).where("_ghost = 0")
    done = full.select(key, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "sketch", "_next_sketch", sketch(F.col("_edited"), width, k).alias("edited_sketch"))
    return done.select(
        key,
        "n_chars",
        "edited_sha256",
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("_next_sketch"), k).alias("near_next"),
    )
