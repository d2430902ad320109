"""From documents and laid-out lines to opinions and ordered paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import BLOB_HEADER, HEADER, author_name, dehyphenate, is_junk, quote_share, role_type, squeeze, starts_footnote, title_case, word_count

# Type sizes and indents, in points, that tell lines apart; lengths in characters.
BODY_SIZE, FOOT_SIZE = 10.4, 8.0
INDENT, CENTRED = 4.0, 45.0
HEADING, LEAD, HEADER_SHOWN = 40, 500, 130
#: Integer keys of a block in ``prefix_sums``.
BLOCK = 4096
#: Matches of a text whose places are summed at once.
PLACES = 512


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, text, n_words, quote_share): a text's lines of more than one character, squeezed, from 0."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_line", "_t")).select(key, "_line", squeeze(F.col("_t")).alias("text"))
    kept = lines.where(F.length("text") > 1)
    pos = F.row_number().over(Window.partitionBy(key).orderBy("_line")) - 1
    return kept.select(key, pos.alias("pos"), "text", word_count(F.col("text")).alias("n_words"), quote_share(F.col("text")).alias("quote_share"))


def prefix_sums(counts: DataFrame, key: str, value: str, block: int = BLOCK) -> DataFrame:
    """counts with ``before``: the sum of the values of all smaller integer keys, which are unique.

    In two steps, inside blocks of keys and over the blocks' sums, so that no task sorts
    more than the blocks.
    """
    own = counts.withColumn("_b", F.floor(F.col(key) / block))
    sums = own.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(bases, "_b")
    return placed.withColumn("before", F.col("_base") + F.col("_in")).drop("_b", "_in", "_base")


def number(rows: DataFrame, key: str = "doc_id", pos: str = "pos", out: str = "para_id") -> DataFrame:
    """rows with a dense id from 0 in the order of (key, pos), pos counting each key's rows from 0."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    starts = prefix_sums(counts, key, "_n").select(key, F.col("before").alias("_start"))
    return rows.join(starts, key).withColumn(out, F.col("_start") + F.col(pos)).drop("_start")


def page_margins(lines: DataFrame) -> DataFrame:
    """(doc, page, margin): the commonest whole-point indent of a page's body lines; the first seen of a tie."""
    body = lines.where((F.col("sz") >= BODY_SIZE) & (F.trim("t") != "")).select("doc", "page", "line_no", F.bround("x0", 0).alias("_x"))
    counts = body.groupBy("doc", "page", "_x").agg(F.count("*").alias("_n"), F.min("line_no").alias("_first"))
    return counts.groupBy("doc", "page").agg(F.max_by("_x", F.struct("_n", -F.col("_first"))).alias("margin"))


def laid_out_paragraphs(lines: DataFrame) -> DataFrame:
    """(doc, para_no, text, is_footnote, n_lines) from lines (doc, page, line_no, x0, sz, t).

    A paragraph begins at an indented line, at a footnote's number, where type changes
    between body and footnote, after a running head or heading, and on each page. Tiny
    lines are skipped. Pages without body lines are skipped whole. All by looking at the
    line before; a document's lines are one window.
    """
    t = F.trim("t")
    own = lines.join(page_margins(lines), ["doc", "page"]).where((F.col("sz") >= FOOT_SIZE) & (t != ""))
    dx = F.col("x0") - F.col("margin")
    breaks = is_junk(t) | ((dx > CENTRED) & (F.length(t) <= HEADING))
    marked = own.withColumns({"_break": breaks, "_foot": F.col("sz") < BODY_SIZE, "_in": dx})
    order = Window.partitionBy("doc").orderBy("page", "line_no")
    marked = marked.withColumn("_after", F.lag("_break", 1, False).over(order)).where(~F.col("_break"))
    starts = (F.col("_in") > INDENT) & (F.col("_in") <= CENTRED) | (F.col("_foot") & starts_footnote(t))
    new = starts | F.col("_after") | (F.col("_foot") != F.lag("_foot", 1, False).over(order)) | (F.col("page") != F.lag("page", 1).over(order)).eqNullSafe(True) | (F.row_number().over(order) == 1)
    placed = marked.withColumn("_new", new.cast("int")).withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.groupBy("doc", "_no").agg(F.sort_array(F.collect_list(F.struct("page", "line_no", "t"))).alias("_l"), F.bool_or("_foot").alias("is_footnote"), F.count("*").alias("n_lines"))
    made = joined.withColumn("text", squeeze(dehyphenate(F.array_join(F.transform("_l", lambda x: x["t"]), " ")))).where(F.length("text") > 1)
    return made.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("_no")) - 1).alias("para_no"), "text", "is_footnote", "n_lines")


def matches(rows: DataFrame, text: str, pattern: str, groups: list[int], keys: list[str]) -> DataFrame:
    """keys with (i, start, end, g0...): places of a pattern's matches and some of their groups.

    A text split at its matches has one part more than matches; running lengths give the places.
    """
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), *[f.alias(f"g{i}") for i, f in enumerate(found)])
    each = rows.where(F.col(text).rlike(pattern)).select(*keys, F.posexplode(zipped).alias("i", "x")).where("x.match is not null")
    window = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("x.gap") + F.length("x.match")).over(window)
    return each.select(*keys, "i", (end - F.length("x.match")).alias("start"), end.alias("end"), *[f"x.g{i}" for i in range(len(groups))])


def places(text: str, pattern: str, group: int) -> Column:
    """An array of (end, g0): where a text's matches end and one of their groups, without leaving the text's row.

    Lengths are summed over parts of PLACES matches, then inside them, so that many matches do not take their square of steps.
    """
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(every)), F.transform(every, F.length), lambda g, m: g + m)
    parts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PLACES).cast("int")), lambda i: F.slice(x, i * PLACES + 1, PLACES))
    sums = lambda x, first: F.aggregate(x, F.array(first), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  computed once
    ends = bound(parts(sizes), lambda p: F.flatten(F.zip_with(F.slice(sums(F.transform(p, total), F.lit(0)), 1, F.size(p)), p, lambda base, own: F.slice(sums(own, base), 2, PLACES))))
    return F.arrays_zip(ends.alias("end"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g0"))


def split_blobs(blobs: DataFrame, key: str = "doc_id", text: str = "text", author: Column | None = None, kind: Column | None = None) -> DataFrame:
    """(key, piece, start, end, author, type, header): texts that bundle several opinions, cut at their headers.

    Text before the first header is a piece of the parent's author and kind if it has more
    than LEAD characters. A text with fewer than two headers is one piece.
    """
    author, kind = author if author is not None else F.lit(""), kind if kind is not None else F.lit("majority")
    rows = blobs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"), author.alias("_author"), kind.alias("_kind"))
    found = rows.withColumn("_all", F.when(F.col("_t").rlike(BLOB_HEADER), places("_t", BLOB_HEADER, 1)))
    marks = F.transform("_all", lambda m: F.struct((m["end"] - F.length(m["g0"])).cast("bigint").alias("start"), m["g0"].alias("_h")))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("string").alias("_h")))
    cut = found.withColumn("_m", marks).withColumn("_m", F.when(F.coalesce(F.size("_m") > 1, F.lit(False)), F.when(F.col("_m")[0]["start"] > LEAD, F.concat(whole, "_m")).otherwise(F.col("_m"))).otherwise(whole))
    ends = F.concat(F.transform(F.slice("_m", 2, 2_000_000_000), lambda m: m["start"]), F.array(F.length("_t").cast("bigint")))
    lead = F.substring("_t", 1, HEADER_SHOWN)
    each = cut.select(key, lead.alias("_lead"), "_author", "_kind", F.posexplode(F.arrays_zip(F.col("_m").alias("p"), ends.alias("end"))).alias("piece", "_p")).select(key, "_lead", "_author", "_kind", "piece", "_p.p", "_p.end")
    start, end = F.col("p.start"), F.col("end")
    header = F.regexp_replace(F.coalesce("p._h", "_lead"), r"(?U)\s+", " ")
    role = F.regexp_extract(header, r"(delivered the opinion|announced the judgment|concurring[^.]*|dissenting[^.]*)", 1)
    own = F.col("p._h").isNotNull()
    return each.select(
        key, "piece", start.alias("start"), end.alias("end"),
        F.when(own, F.regexp_extract(header, r"Justice\s+([A-Z][a-zA-Z’']+)", 1)).otherwise(F.col("_author")).alias("author"),
        F.when(own, role_type(role)).otherwise(F.col("_kind")).alias("type"),
        F.substring(header, 1, HEADER_SHOWN).alias("header"),
    )


def split_laid_out(paras: DataFrame) -> DataFrame:
    """(doc, opinion_idx, author, opinion_type, header, para_no, text, is_footnote): paragraphs dealt to opinions.

    Headers are sought in a document's paragraphs joined by line feeds; a paragraph belongs
    to the last header at or before its first character, so one that a header is found inside
    of stays with the opinion before. Paragraphs before the first header (the syllabus) go.
    """
    order = Window.partitionBy("doc").orderBy("para_no")
    placed = paras.withColumn("_o", F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blobs = paras.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("para_no", "text"))).alias("_l")).select("doc", F.array_join(F.transform("_l", lambda x: x["text"]), "\n").alias("_t"))
    found = matches(blobs, "_t", HEADER, [1, 3, 0], ["doc"])
    heads = found.select("doc", F.col("start").alias("_o"), F.lit(0).alias("_k"), F.struct(F.col("i").alias("i"), title_case(F.col("g0")).alias("author"), role_type(F.col("g1")).alias("type"), F.substring(F.regexp_replace("g2", r"(?U)\s+", " "), 1, HEADER_SHOWN).alias("header")).alias("_h"), F.lit(None).cast("int").alias("para_no"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("is_footnote"))
    lines = placed.select("doc", "_o", F.lit(1).alias("_k"), F.lit(None).cast(heads.schema["_h"].dataType).alias("_h"), F.col("para_no").cast("int").alias("para_no"), "text", "is_footnote")
    events = Window.partitionBy("doc").orderBy("_o", "_k").rowsBetween(Window.unboundedPreceding, 0)
    dealt = heads.unionByName(lines).withColumn("_own", F.last("_h", True).over(events)).where("_k = 1 and _own is not null")
    return dealt.select("doc", F.col("_own.i").alias("opinion_idx"), F.col("_own.author").alias("author"), F.col("_own.type").alias("opinion_type"), F.col("_own.header").alias("header"), "para_no", "text", "is_footnote")


def opinion_inventory(paras: DataFrame, keys: list[str]) -> DataFrame:
    """keys with (n_body, n_foot)."""
    return paras.groupBy(*keys).agg(F.count_if(~F.col("is_footnote")).alias("n_body"), F.count_if(F.col("is_footnote")).alias("n_foot"))


def archive_opinions(raw: DataFrame) -> DataFrame:
    """(case_key, case_name, year, opinion_idx, author, type, source, header, text) from nested case records.

    Records are read by ``sources.cases.read_cases``; bundled texts are cut into their opinions.
    """
    subs = raw.select("key", "case_name", "year", F.posexplode_outer("sub_opinions").alias("sub", "o")).where("o is not null")
    rows = subs.select("key", "case_name", "year", "sub", author_name(F.coalesce("o.author_str", F.lit(""))).alias("_a"), F.col("o.type").alias("_k"), F.coalesce("o.author_str", F.lit("")).alias("_raw"), F.coalesce("o.text", F.lit("")).alias("text"))
    keyed = rows.withColumn("_id", F.concat_ws("\x1f", "key", "sub"))
    pieces = split_blobs(keyed, "_id", "text", F.col("_a"), F.col("_k"))
    several = F.count("*").over(Window.partitionBy("_id")) > 1
    joined = keyed.join(pieces.withColumn("_many", several), "_id")
    order = Window.partitionBy("key").orderBy("sub", "piece")
    return joined.select(
        F.col("key").alias("case_key"), "case_name", "year", (F.row_number().over(order) - 1).alias("opinion_idx"), "author", "type", F.lit("cap").alias("source"),
        F.when(F.col("_many"), F.col("header")).otherwise(F.substring("_raw", 1, HEADER_SHOWN)).alias("header"),
        F.expr("substring(text, cast(start as int) + 1, cast(end - start as int))").alias("text"),
    )


