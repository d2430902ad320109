"""Near copies of every kind are found, all of them: against brute force over all pairs."""

import random

from tessella.llm import near_copies
from tests.llm.conftest import TEXT
from tests.llm.test_pipeline import brute_fingerprint, brute_groups, edited, shingles


def vocabulary(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def whole(spark, rows):
    """One of each group is kept, and it is the one with the least id."""
    kept = sorted(r["doc_id"] for r in near_copies.one_of_each(spark.createDataFrame(rows, TEXT)).collect())
    assert kept == sorted(min(k for k, _ in g) for g in brute_groups(rows))
    return kept


def on_template(rng, texts, template, own):
    """Texts on one template, most unlike each other, of every fifth a near copy with other words at the end."""
    passage, rows = vocabulary(rng, template), []
    for i in range(texts):
        body = passage + vocabulary(rng, own)
        rows.append(" ".join(body))
        if i % 5 == 0:
            rows.append(" ".join(body[:-20] + vocabulary(rng, 20)))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_template(spark):
    rows = on_template(random.Random(1), 250, 160, 40)
    assert 150 < len(whole(spark, rows)) <= 250


def contiguous(rng, words):
    """(kind, a, b): pairs that are 0.8 to 0.84 alike, by one edit in one place."""
    text = vocabulary(rng, words)
    more, less, block = int(words * rng.uniform(0.19, 0.24)), int(words * rng.uniform(0.16, 0.19)), int(words * rng.uniform(0.06, 0.08))
    at = rng.randrange(words - block)
    for kind, other in (("appended", text + vocabulary(rng, more)), ("cut", text[: words - less]), ("replaced", text[:at] + vocabulary(rng, block) + text[at + block :])):
        if similarity(a := " ".join(text), b := " ".join(other)) >= 0.8:
            yield kind, a, b
        text = vocabulary(rng, words)


def test_contiguous_edits(spark):
    rng = random.Random(2)
    pairs = [p for _ in range(40) for p in contiguous(rng, rng.choice([200, 400]))]
    fresh = [(similarity(a, b), a, b) for _, a, b in pairs]
    fresh = [(a, b) for s, a, b in fresh if 0.8 <= s < 0.88]
    assert len(fresh) >= 30
    assert len(whole(spark, list(enumerate(t for p in fresh for t in p)))) == len(fresh)


def drifting(rng):
    """Versions in a chain of long-fingerprint links, and a near copy of the last one that is none of the first."""
    chain = [" ".join(vocabulary(rng, 300))]
    while similarity(chain[0], chain[-1]) > 0.75:
        new = edited(rng, chain[-1], 1)
        if (brute_fingerprint(new) ^ brute_fingerprint(chain[-1])).bit_count() <= 2:
            chain.append(new)
    while True:
        new = edited(rng, chain[-1], 8)
        if similarity(chain[-1], new) >= 0.8 > similarity(chain[0], new) and min((brute_fingerprint(new) ^ brute_fingerprint(t)).bit_count() for t in chain) > 2:
            return [*chain, new]


def test_links_of_any_member(spark):
    rng = random.Random(3)
    rows = [t for _ in range(3) for t in drifting(rng)]
    assert len(whole(spark, list(enumerate(rows)))) == 3


def test_full_bucket(spark):
    """All meet on shingles of the template, whatever the order, for there are too few others."""
    rows = on_template(random.Random(4), 60, 180, 26)
    assert 30 < len(whole(spark, rows)) <= 60
