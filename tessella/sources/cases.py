"""Readers of cases, paragraphs and vectors, and the choices made among candidate sources.

Fetching over HTTP is not part of the engine: whatever fetches leaves files, which these read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import first_long
from tessella.schema import LAYOUT, OPINIONS, PARAGRAPHS, RAW_CASE, VECTORS

# Fields that may hold an opinion's text, in order of choice; least lengths; what merits say.
TEXT_FIELDS = ["plain_text", "html_with_citations", "html", "xml_harvard", "html_lawbox", "html_columbia"]
LEAST_FIELD, LEAST_OPINION = 500, 400
MERITS = "(?i)delivered the opinion of the Court"
CLUSTER = r"/opinion/(\d+)/"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One nested record for each case file."""
    return spark.read.schema(RAW_CASE).option("multiLine", True).json(path)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).parquet(path)


def read_paragraphs(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    return spark.read.schema(PARAGRAPHS).format(form).load(path)


def read_opinions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OPINIONS).option("multiLine", True).json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, embedding) of two-dimensional .npy arrays of floats in any store Spark reads; each under 2 GB."""

    def run(parts: Iterator) -> Iterator:
        import io

        import numpy as np
        import pandas as pd

        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(array), 10_000):
                    own = array[at : at + 10_000].astype(np.float32)
                    yield pd.DataFrame({"file": name, "row": np.arange(at, at + len(own)), "embedding": list(own)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row bigint, embedding array<float>")


def with_vectors(paragraphs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Paragraphs and their vectors (v, array<double>), matched by id."""
    return paragraphs.join(vectors.select("para_id", F.col("embedding").cast("array<double>").alias("v")), "para_id")


def pdf_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): pages joined by line feeds; an empty text for files that cannot be read, or without a PDF library."""

    def text_of(content: bytes) -> str:
        try:
            import io

            from pypdf import PdfReader

            return "\n".join((p.extract_text() or "") for p in PdfReader(io.BytesIO(content)).pages)
        except Exception:  # noqa: BLE001 - a broken file is an empty text
            return ""

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            yield pd.DataFrame({"path": pdf["path"], "text": [text_of(x) for x in pdf["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def layout_lines(spans: DataFrame) -> DataFrame:
    """(doc, page, line_no, x0, y0, sz, t) from lines (doc, page, line_no, x0, y0, spans array<struct<text, size>>).

    A line's text is its spans' joined, its size the largest of spans that are not blank; blank lines go.
    """
    shown = F.filter("spans", lambda s: F.trim(s["text"]) != "")
    size = F.array_max(F.transform(shown, lambda s: s["size"]))
    text = F.array_join(F.transform("spans", lambda s: s["text"]), "")
    return spans.where(F.size(shown) > 0).select("doc", "page", "line_no", "x0", "y0", size.alias("sz"), text.alias("t"))


def find_page(index: DataFrame, page: str | int) -> DataFrame:
    """The first record whose first page is this one, compared as text; none or one row."""
    return index.where(F.col("first_page").cast("string") == str(page)).orderBy("pos").limit(1)


def kept_opinions(records: DataFrame, least: int = LEAST_OPINION) -> DataFrame:
    """(key, pos, type, author_str, text): nested opinions one by one, those of at least so many characters."""
    each = records.select("key", F.posexplode_outer("opinions").alias("pos", "o")).select("key", "pos", "o.*")
    return each.where(F.length("text") >= least)


def best_field(rows: DataFrame, fields: list[str] | None = None, least: int = LEAST_FIELD) -> DataFrame:
    """rows with (text, text_field) of the first field that is long enough; rows without one go."""
    text, name = first_long(fields or TEXT_FIELDS, least)
    return rows.withColumns({"_text": text, "text_field": name}).where(F.col("_text").isNotNull()).withColumn("text", F.col("_text")).drop("_text")


def cluster_id(url: Column) -> Column:
    """The number in an opinion's address; null if there is none."""
    found = F.regexp_extract(url, CLUSTER, 1)
    return F.when(found != "", found).cast("bigint")


def first_success(tries: DataFrame, key: str = "key", pos: str = "pos", result: str = "result") -> DataFrame:
    """(key, pos, result): each key's first try, in order, that gave something; keys without one have no row."""
    made = tries.where(F.col(result).isNotNull()).groupBy(key).agg(F.min(F.struct(pos, result)).alias("r"))
    return made.select(key, f"r.{pos}", f"r.{result}")


def preferred_citation(cases: DataFrame, reporter: str = "us") -> DataFrame:
    """(key, reporter, volume, page): a case's first citation in the preferred reporter; none: no row."""
    own = F.filter("cites", lambda c: F.lower(c["reporter"]) == reporter)
    return cases.where(F.size(own) > 0).select("key", own[0].alias("c")).select("key", "c.*")


def best_candidate(candidates: DataFrame, tokens: Column, key: str = "key", pos: str = "pos", text: str = "text", merits: str = MERITS) -> DataFrame:
    """(key, pos, score): each key's longest text that shows merits and holds all tokens, the first of a tie."""
    low = F.lower(text)
    fits = F.col(text).rlike(merits) & F.forall(tokens, lambda t: F.contains(low, t))
    scored = candidates.select(key, pos, F.when(fits, F.length(text)).otherwise(-1).alias("score"))
    first = Window.partitionBy(key).orderBy(F.desc("score"), pos)
    return scored.withColumn("_n", F.row_number().over(first)).where("_n = 1 and score > 0").drop("_n")


def with_priority(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of first, and those of second whose key first has none of."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def quality_counts(texts: DataFrame, key: str, words: list[str]) -> DataFrame:
    """key with how often each word occurs, as n_<word>."""
    return texts.select(key, *[F.regexp_count("text", F.lit(w)).alias(f"n_{w}") for w in words])


def type_counts(opinions: DataFrame, by: str = "type") -> DataFrame:
    return opinions.groupBy(by).agg(F.count("*").alias("n"))
