"""The pipeline's stages against brute force, each over what the stage before it kept."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, near_copies, secrets, toxicity
from tests.llm.conftest import clashing
from tests.llm.test_models import toxic_rows
from tests.llm.test_ops import PATTERN, RANKS, SECRETS, brute_fingerprint, brute_hits, brute_spans, items_for, lower

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def inputs(spark, sample, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    toxic = toxic_rows(300)
    rows = [(i + 10_000, t) for i, t, _ in toxic] + sample + [(None if k is None else k + 20_000, t) for k, t in SECRETS] + [(3, "another text under an id that is taken")]
    documents = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in rows], DOCUMENTS)
    documents.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i + 10_000, y, 1) for i, _, y in toxic], "doc_id bigint, toxic int, quality int").write.parquet(f"{where}/labels.parquet")
    items = items_for(sample)
    spark.createDataFrame([x for x in items if x[1] != "Alpha"], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, toxic, [x for x in items if x[1] != "Alpha"]


def ids_texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages(spark, inputs):
    where, rows, toxic, items = inputs
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for df in (docs, clashing(docs, case=False)):
        kept = df
        after = []
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, where).cache()
            after.append(kept)
            if len(after) < 5:
                assert kept.columns == df.columns
        # 1: toxic documents go, and nothing else
        scorer = toxicity.trained(docs, spark.read.parquet(f"{where}/labels.parquet"))
        bad = {r["doc_id"] for r in toxicity.score(docs, scorer).where(F.col("_score") >= 0.7).collect()}
        first = [(k, t) for k, t in rows if k not in bad]
        assert ids_texts(after[0]) == sorted(first, key=str)
        # 2: one of each group
        second = ids_texts(after[1])
        groups = brute_groups(first)
        assert len(second) == len(groups)
        for members in groups:
            least = min((k for k, _ in members if k is not None), default=None)
            assert sum((k, t) in second for k, t in set(members) if k == least) >= 1
        # 3: documents with benchmark passages go
        third = sorted(((k, t) for k, t in second if not brute_hits(t, items)[-1]), key=str)
        assert ids_texts(after[2]) == third and len(third) < len(second)
        # 4: secrets are replaced
        fourth = ids_texts(after[3])
        assert [k for k, _ in fourth] == [k for k, _ in third] or len(fourth) == len(third)
        assert not any(re.search(r"AKIA[A-Z0-9]{16}|hunter22|[0-9a-f]{24}", t or "") for _, t in fourth)
        untouched = {(k, t) for k, t in third if not brute_spans(t, secrets.RULES)}
        assert untouched <= set(fourth)
        assert all(r["n_chars"] == len(r["text"]) for r in after[3].collect() if r["text"] is not None)
        # 5: ids decode to the texts
        with open(RANKS, "rb") as f:
            encoding = bpe._encoding(f.read(), PATTERN)
        want = sorted(((k, len(encoding.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in fourth), key=str)
        assert sorted(((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in after[4].collect()), key=str) == want


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    """Rows (id, text) by the components of: fingerprints within two bits, or 0.8 of all shingles in common."""
    sets, marks = [shingles(t) for _, t in rows], [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if alike or (marks[i] ^ marks[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return list(groups.values())


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_copies(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["ba", "ko", "li", "mu", "ne", "ta", "ri", "so"]) for _ in range(rng.randint(1, 4)))
    rows, n = [], 0
    for _ in range(60):
        text = " ".join(word() for _ in range(rng.choice([40, 120, 400])))
        for k in range(rng.choice([1, 2, 4, 30])):
            rows.append((n, edited(rng, text, rng.randint(0, max(1, len(text.split()) // 45))) if k else text))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "one"), (n + 4, "a b c d"), (n + 5, "a b c d e"), (None, "one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in near_copies.one_of_each(docs).collect()}
    groups = brute_groups(rows)
    least = {min((k for k, _ in g if k is not None), default=None) for g in groups}
    assert least <= kept  # nothing is removed that has no copy kept
    assert len(kept) <= len(least) + 0.02 * len(rows)  # nearly all copies are found
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_run(spark, inputs):
    where, *_ = inputs
    found = corpus_pipeline.run(spark, where)
    assert found.count() > 100 and found.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_empty_tables(spark, inputs):
    where, *_ = inputs
    docs = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where)
        assert docs.count() == 0
