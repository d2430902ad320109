import json

import numpy as np
from pyspark.sql import functions as F

from tessella import schema
from tessella.sources import cases as sc
from tessella.sources import sinks


def test_cases_round_trip(spark, tmp_path):
    record = {"key": "k", "case_name": "Name", "year": 1990, "source": "s", "cap_id": "7", "sub_opinions": [{"type": "majority", "author_str": "Roe", "text_field": "t", "text": "x\ny"}]}
    (tmp_path / "k.json").write_text(json.dumps(record, indent=1))
    row = sc.read_cases(spark, str(tmp_path)).first()
    assert row["sub_opinions"][0]["text"] == "x\ny" and row["cluster_id"] is None
    out = str(tmp_path / "out")
    df = sc.read_cases(spark, str(tmp_path))
    sinks.write_cases(df, out)
    sinks.write_cases(df.limit(0), out)  # exists: nothing is done
    assert spark.read.json(out).count() == 1


def test_paragraphs_vectors(spark, tmp_path):
    para = spark.createDataFrame([(1, "k", "N", 1990, 0, "Roe", "majority", "cap", False, 2, 0.0, "a b"), (2, "k", "N", 1990, 0, "Roe", "majority", "cap", True, 2, 0.0, "c d")], schema.PARAGRAPHS)
    sinks.write_rows(para, str(tmp_path / "p"))
    sinks.write_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0])], "para_id bigint, embedding array<double>"), str(tmp_path / "v"))
    joined = sc.with_vectors(sc.read_paragraphs(spark, str(tmp_path / "p")), sc.read_vectors(spark, str(tmp_path / "v"))).collect()
    assert [(r["para_id"], r["v"]) for r in joined] == [(1, [1.0, 0.0])]


def test_npy(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    rows = sc.read_npy(spark, str(tmp_path / "a.npy")).orderBy("row").collect()
    assert [(r["row"], r["embedding"]) for r in rows] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]


def test_broken_pdf_is_empty(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"no pdf")
    assert [r["text"] for r in sc.pdf_texts(spark, str(tmp_path / "x.pdf")).collect()] == [""]


def test_layout_lines(spark):
    rows = [("d", 0, 0, 1.0, 2.0, [("a ", 9.0), ("b", 11.0), ("  ", 20.0)]), ("d", 0, 1, 1.0, 2.0, [(" ", 9.0)])]
    df = spark.createDataFrame(rows, "doc string, page int, line_no int, x0 double, y0 double, spans array<struct<text:string,size:double>>")
    assert [(r["t"], r["sz"]) for r in sc.layout_lines(df).collect()] == [("a b  ", 11.0)]


def test_choices(spark):
    index = spark.createDataFrame([(0, 12, "a"), (1, 7, "b"), (2, 7, "c")], "pos int, first_page int, name string")
    assert [r["name"] for r in sc.find_page(index, "7").collect()] == ["b"] and sc.find_page(index, 99).count() == 0
    nested = spark.createDataFrame([("k", [("m", "A", "x" * 400), ("d", "B", "x" * 399)]), ("e", [])], "key string, opinions array<struct<type:string,author_str:string,text:string>>")
    assert [r["type"] for r in sc.kept_opinions(nested).collect()] == ["m"]
    urls = spark.createDataFrame([("https://x/opinion/123/name/",), ("https://x/c/",)], "u string")
    assert [r[0] for r in urls.select(sc.cluster_id(F.col("u"))).collect()] == [123, None]
    fields = spark.createDataFrame([(1, None, "b" * 501), (2, "a" * 500, "")], "k int, plain_text string, html string")
    assert [(r["k"], r["text_field"]) for r in sc.best_field(fields, ["plain_text", "html"]).collect()] == [(1, "html")]
    cites = spark.createDataFrame([("k", [("F", "1", "2"), ("US", "3", "4")]), ("n", [])], schema.CASES.replace("name string, year int, ", ""))
    assert [tuple(r) for r in sc.preferred_citation(cites).collect()] == [("k", "US", "3", "4")]
    tries = spark.createDataFrame([("k", 0, None), ("k", 1, "b"), ("k", 2, "c"), ("n", 0, None)], "key string, pos int, result string")
    assert [tuple(r) for r in sc.first_success(tries).collect()] == [("k", 1, "b")]
    said = "X delivered the opinion of the Court in Roe. "
    texts = [("k", 0, said), ("k", 1, said + "y"), ("k", 2, said + "z"), ("k", 3, "roe " * 99), ("n", 0, "nothing")]
    best = sc.best_candidate(spark.createDataFrame(texts, "key string, pos int, text string"), F.array(F.lit("roe")))
    assert [(r["key"], r["pos"]) for r in best.collect()] == [("k", 1)]


def test_figure_data(spark):
    means = spark.createDataFrame([("c", "majority", 0, "A", 1.0), ("c", "majority", 0, "B", 2.0)], "case string, role string, author int, section string, affinity double")
    row = sinks.heatmap_data(means, ["A", "B", "C"]).first()
    assert (row["A"], row["B"], row["C"]) == (1.0, 2.0, None)
    drawn = sinks.lollipop_data(spark.createDataFrame([("a", 2.0), ("b", 1.0)], "case string, delta double"))
    assert {r["case"]: r["y"] for r in drawn.collect()} == {"a": 1, "b": 0}
