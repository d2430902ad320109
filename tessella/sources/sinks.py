"""Writers: records, texts, paragraphs, vectors, metrics and the data of figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_cases(records: DataFrame, path: str, key: str = "key", mode: str = "ignore") -> None:
    """JSON records in a folder for each key; by default nothing is done if the path exists."""
    records.write.mode(mode).partitionBy(key).json(path)


def write_texts(texts: DataFrame, path: str, key: str = "key", mode: str = "ignore") -> None:
    texts.select(key, F.col("text").alias("value")).write.mode(mode).partitionBy(key).text(path)


def write_rows(rows: DataFrame, path: str, form: str = "json", mode: str = "overwrite") -> None:
    """Paragraphs, opinions or scored rows, as JSON lines or Parquet."""
    rows.write.mode(mode).format(form).save(path)


def write_vectors(vectors: DataFrame, path: str, v: str = "embedding", mode: str = "overwrite") -> None:
    vectors.withColumn(v, F.col(v).cast("array<float>")).write.mode(mode).parquet(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A result document: one row, one JSON file."""
    metrics.coalesce(1).write.mode(mode).json(path)


def heatmap_data(section_means: DataFrame, names: list[str]) -> DataFrame:
    """(case, role, author, one column a section): the panel of relative engagement."""
    return section_means.groupBy("case", "role", "author").pivot("section", names).agg(F.first("affinity"))


def lollipop_data(deltas: DataFrame, order: str = "delta") -> DataFrame:
    """Deltas in the order they are drawn, with the height of each."""
    from pyspark.sql import Window

    return deltas.withColumn("y", F.row_number().over(Window.orderBy(order, "case")) - 1)
