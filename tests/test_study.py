"""The whole analyses, from nested records to results."""

import random

import pytest
from pyspark.sql import functions as F

from tessella import schema
from tessella.operators import encode as en
from tessella.plans import study as st


@pytest.fixture(scope="module")
def study(spark):
    rng = random.Random(8)
    said = lambda n: " ".join(rng.choice("power law act court president congress statute duty claim order text rule".split()) for _ in range(n))
    records = [("ref", "Reference", 1952, [{"author_str": "Justice Roe", "type": "concurrence", "text": "\n".join(said(30) for _ in range(40))}])]
    for c in range(6):
        subs = [{"author_str": a, "type": t, "text": "\n".join(said(30) + ' and "a quoted span of text" too' for _ in range(5))} for a, t in (("Justice Poe", "majority"), ("Justice Doe", "dissent"), ("Justice Loe", "dissent"))]
        records.append((f"c{c}", f"Case {c}", 1980 + c, subs))
    raw = spark.createDataFrame(records, "key string, case_name string, year int, sub_opinions array<struct<author_str:string,type:string,text:string>>")
    lines = [("new", 0, i, 72.0 if i else 80.0, 11.0, t) for i, t in enumerate(["JUSTICE POE delivered the opinion of the Court. " + said(20), said(30)])] + [("c0", 0, 0, 72.0, 11.0, "not used, its case has a record")]
    layout = spark.createDataFrame(lines, "doc string, page int, line_no int, x0 double, sz double, t string")
    paragraphs = st.corpus(raw, layout).cache()
    vectors = en.hashed_encoder(paragraphs, "para_id", "text", 16).select("para_id", F.col("embedding").cast("array<double>").alias("v"))
    labels = spark.createDataFrame([(f"c{c}", a, y) for c in range(6) for a, y in (("Poe", 1), ("Doe", 0), ("Loe", None))], "case string, author string, label int")
    domains = spark.createDataFrame([(f"c{c}", "ab"[c % 2]) for c in range(5)], "case string, domain string")
    reps = {"boot": 50, "placebo": 50, "role": 20, "slope": 20, "gap": 50, "perm": 3}
    return st.Study(paragraphs.join(vectors, "para_id"), "ref", "Roe", schema.sections(spark), domains, labels, None, 20, 3, reps)


def test_corpus(study):
    rows = study.paragraphs.orderBy("para_id").collect()
    assert [r["para_id"] for r in rows] == list(range(len(rows))) and len(rows) == 40 + 6 * 15 + 1
    assert {r["source"] for r in rows if r["case_key"] == "new"} == {"scotus-pdf"} and {r["source"] for r in rows if r["case_key"] == "c0"} == {"cap"}
    assert all(r["quote_share"] > 0 for r in rows if r["case_key"] == "c1")


def test_headline(study):
    out = {k: v.collect() for k, v in st.headline(study).items()}
    assert len(out["within"]) == 6 and out["summary"][0]["n"] == 6
    assert out["interval"][0]["lo"] <= out["summary"][0]["mean"] <= out["interval"][0]["hi"]
    assert {r["domain"]: r["n"] for r in out["by_domain"]} == {"a": 3, "b": 2, "?": 1}
    assert 0 < out["wilcoxon"][0]["p"] <= 1 and len(out["gap_null"]) == 50


def test_robustness_and_stance(study, tmp_path):
    made = st.robustness(study)
    assert all(len(df._jdf.queryExecution().toString()) < 200_000 for df in made.values())
    out = {k: v.collect() for k, v in made.items()}
    assert 0 <= out["placebo"][0]["p"] <= 1 and len(out["dropped"]) == 8 and len(out["quotations"]) == 12
    results = st.stance(study)
    assert results["opinions"].first()["n"] == 12 and results["permutations"].count() == 3
    st.write({"auc": results["auc"]}, str(tmp_path))
