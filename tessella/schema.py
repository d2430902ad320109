"""The tables of the engine (as DDL) and the fixed dimensions that results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CASES = "key string, name string, year int, cites array<struct<reporter:string,volume:string,page:string>>"
RAW_CASE = "key string, case_name string, year int, source string, cap_id string, cluster_id bigint, cl_case_name string, date_filed string, sub_opinions array<struct<opinion_id:bigint,type:string,author_str:string,text_field:string,text:string>>"
LAYOUT = "doc string, page int, line_no int, x0 double, y0 double, sz double, t string"
PARAGRAPHS = "para_id bigint, case_key string, case_name string, year int, opinion_idx int, author string, opinion_type string, source string, is_footnote boolean, n_words int, quote_share double, text string"
OPINIONS = "case_key string, case_name string, year int, opinion_idx int, author string, type string, source string, header string, n_body int, n_foot int"
VECTORS = "para_id bigint, embedding array<float>"
LABELS = "case_key string, author string, label int"
DOMAINS = "case_key string, domain string"
SECTIONS = "name string, lo int, hi int"
ANCHORS = "pole string, idx int, text string"

# How many passages the reference text has, and its sections as half-open
# ranges of passage numbers; passages outside all of them are footnotes.
REFERENCE_SIZE = 38
SECTION_RANGES = [
    ("Framework preamble", 0, 3),
    ("Zone 1 - maximum power", 3, 4),
    ("Zone 2 - twilight", 4, 5),
    ("Zone 3 - lowest ebb", 5, 6),
    ("Applying the zones", 6, 9),
    ("Rejecting Art. II claims", 9, 22),
    ("Inherent power / emergency", 22, 33),
    ("Structural warning", 33, 38),
]
OUTSIDE = "Footnotes"
ZONES = ["Zone 1 - maximum power", "Zone 2 - twilight", "Zone 3 - lowest ebb"]
WARNING = ["Structural warning"]
MIN_WORDS = 25
MIN_PARA = 10


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(rows, schema)


def sections(spark: SparkSession) -> DataFrame:
    return dimension(spark, SECTION_RANGES, SECTIONS)
