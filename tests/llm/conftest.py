import random

import pytest

TEXT = "doc_id bigint, text string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta.", "épsilon", "zeta,", "eta", "Theta", "iota", "kappa"]) for _ in range(n))


@pytest.fixture(scope="session")
def sample():
    """(doc_id, text) rows with nulls, empties, ties, repeated rows, odd characters and a very long text."""
    rng = random.Random(5)
    rows = [(i, words(rng, rng.choice([1, 2, 3, 9, 10, 11, 40, 300]))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "   \n\t "), (43, "a"), (43, "a"), (44, rows[3][1]), (45, rows[3][1]), (None, "no id here at all"), (None, None)]
    rows += [(50, words(rng, 20_000)), (51, "x" * 5000), (52, " " * 3000 + "y"), (53, "ÀÉÎ ſK  em nbsp 漢字テスト 🙂🙂 é"), (-7, "\x00ctl \x1f\x7f end"), (2**60, "large id")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, sample):
    return spark.createDataFrame(sample, TEXT)


def clashing(df, case=True):
    """The same rows with extra columns named as operators name theirs, and one differing in case alone."""
    from pyspark.sql import functions as F

    names = ["fingerprint", "component_id", "ids", "n_tokens", "sketch", "spans", "kind", "start", "end", "root", "score", "window", "h", "a", "b", "u", "v", "m"]
    wide = df.withColumns({n: F.lit("x") for n in names})
    return wide.select("*", F.lit(1).alias("TEXT")) if case else wide
