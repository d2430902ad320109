"""Text and statistical functions against Python's own, on odd cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.functions import stats, text, vectors

TEXTS = [
    "He said “12345678” and \"1234567\" and “mixed\" x”.", '“1234567”', '"12345678"', "“abcdefgh\"", "", "   ", "be­ half and co-\nop and a b c\x1cd", "no quotes at all",
    "O’CONNOR", "DE LA CRUZ", "McDONALD-smith", "éCOLE o'brien", "1\tnote", "12 x", "“a\nb c d e f g h”", "🙂 “🙂🙂🙂🙂🙂🙂🙂🙂” z",
]


def run(spark, rows, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", fn(F.col("t")).alias("x"))
    return [r["x"] for r in df.orderBy("i").collect()]


def test_text(spark):
    quoted = re.compile('[“"][^”"]{8,}[”"]')
    squeezed = lambda t: re.sub(r"\s+", " ", t).strip()
    plain = [t for t in TEXTS if "\x1c" not in t]  # Java's white space lacks the information separators
    assert run(spark, plain, text.squeeze) == [squeezed(t) for t in plain]
    assert run(spark, plain, text.strip_quotes) == [squeezed(quoted.sub(" ", t)) for t in plain]
    assert run(spark, TEXTS, text.quote_share) == [round(sum(map(len, quoted.findall(t))) / max(len(t), 1), 4) for t in TEXTS]
    assert run(spark, plain, text.word_count) == [len(t.split()) for t in plain]
    assert run(spark, TEXTS, text.title_case) == [t.title() for t in TEXTS]
    assert run(spark, TEXTS, text.dehyphenate) == [re.sub(r"(\w)-\n(\w)", r"\1\2", re.sub("­\\s*", "", t)) for t in TEXTS]
    assert run(spark, TEXTS, text.starts_footnote) == [bool(re.match(r"\d+\s", t)) for t in TEXTS]


def test_names_and_roles(spark):
    names = ["Mr. Chief Justice Roe, ", "Justice Poe", "Chief Justice A. Doe.", "", " ,.", "Mr. Justice Van Loe", "Roe"]
    assert run(spark, names, text.author_name) == ["Roe", "Poe", "A.", "", "", "Van", "Roe"]
    roles = ["delivered the opinion", "announced the judgment", "concurring in the judgment in part and dissenting in part", "concurring in part and dissenting in part", "concurring", "Dissenting", "x"]
    assert run(spark, roles, text.role_type) == ["majority", "majority", "concurrence", "mixed", "concurrence", "dissent", "other"]
    junk = ["12", "Cite as: 1", "Opinion of the Court", "Opinion of Roe, J.", "Roe, J., dissenting", "ROE COUNTY v. POE", "NOTICE: x", "Syllabus", "A sentence.", "12345", "Opinions differ"]
    assert run(spark, junk, text.is_junk) == [True] * 8 + [False] * 3


def test_first_long(spark):
    df = spark.createDataFrame([(None, "b" * 9, "c"), ("a" * 3, None, "c" * 9), ("", "", "")], "a string, b string, c string")
    t, n = text.first_long(["a", "b", "c"], 5)
    assert [tuple(r) for r in df.select(t.alias("t"), n.alias("n")).collect()] == [("b" * 9, "b"), ("c" * 9, "c"), (None, None)]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_stats(spark):
    assert one(spark, stats.binomial_tail(F.lit(20), F.lit(16))) == pytest.approx(0.005909, abs=1e-6)
    assert one(spark, stats.binomial_tail(F.lit(4000), F.lit(2000))) == pytest.approx(0.5063, abs=1e-4)
    assert one(spark, stats.binomial_tail(F.lit(0), F.lit(0))) == 1.0
    counts = [1, 1, 1, 2, 2, 2, 2, 2, 1, 1, 1]  # sums of signed ranks of four values
    for w in range(11):
        assert one(spark, stats.signed_rank_tail(F.lit(4), F.lit(float(w)))) == pytest.approx(sum(counts[w:]) / 16)
    for x in (-7.0, -3.3, -1.0, -0.1, 0.0, 0.5, 2.2, 5.5):
        assert one(spark, stats.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=1e-13)
    # values from tables of Student's t and of Grubbs' test
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6) and stats.t_quantile(0.025, 1) == pytest.approx(-12.706205, abs=1e-5)
    assert stats.grubbs_critical(20) == pytest.approx(2.7082, abs=1e-3) and math.isnan(stats.grubbs_critical(2))


def test_draws_depend_on_the_key_alone(spark):
    df = spark.range(1000).select(stats.hashed("7", F.col("id")).alias("h"))
    first = [r["h"] for r in df.collect()]
    assert first == [r["h"] for r in df.repartition(7).sort("h").select("h").collect()] or sorted(first) == sorted(r["h"] for r in df.repartition(7).collect())
    assert min(first) >= 0 and max(first) < 2**32 and len(set(first)) > 990


def test_vectors(spark):
    rng = random.Random(1)
    rows = [(g, [rng.gauss(0, 1) for _ in range(5)]) for g in (1, 1, 1, 2)]
    df = spark.createDataFrame(rows, "g int, v array<double>")
    means = {r["g"]: r["m"] for r in df.groupBy("g").agg(vectors.mean_vector(F.col("v")).alias("m")).collect()}
    assert means[2] == pytest.approx(rows[3][1]) and means[1] == pytest.approx([sum(r[1][i] for r in rows[:3]) / 3 for i in range(5)])
    units = [r["u"] for r in df.select(vectors.unit(F.col("v")).alias("u")).collect()]
    assert all(sum(x * x for x in u) == pytest.approx(1) for u in units)
    assert one(spark, vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, vectors.angle(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == pytest.approx(90)


def test_upper_each_keeps_lengths(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [*text.CAPITALS, "straße ﬁn\nœuvre ŉ ǰ", "ßß", "", "âge 🙂", None]
    made = run(spark, rows, text.upper_each)
    assert made == [duckdb.execute("SELECT upper(?)", [t]).fetchall()[0][0] for t in rows]
    assert [c for c in map(chr, range(0x10000)) if re.match(text.WIDE, c)] == list(text.CAPITALS)
    assert [t and len(t) for t in made] == [t and len(t) for t in rows]
